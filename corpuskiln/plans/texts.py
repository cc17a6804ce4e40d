"""Queries on documents, pages and conversations as texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuskiln.functions import text as T
from corpuskiln.functions.masking import MASKS, mask_pii
from corpuskiln.operators import checks, lexicons, lines
from corpuskiln.plans.sft import _EMAIL, _PHONE, _RESIDENT, mask_sql
from corpuskiln.sources.logs import blob_key, blobs
from corpuskiln.sources.tables import table

#: A small lexicon of the driver's languages, in place of the Korean ones.
CLASSES = {"english": {"the ": 2, " and ": 2, "tion": 1}, "german": {" der ": 2, " und ": 2, "ung": 1}, "french": {" la ": 2, " de ": 1, "eux": 2}, "spanish": {" el ": 2, " que ": 1, "ción": 2}}
AREAS = {
    "contact": {"mail": ["@"], "phone": ["+"], "web": ["http"], "host": ["10.", "192."]},
    "layout": {"cells": [" | "], "shout": ["!!"], "quote": ['"'], "key": [" = "]},
}


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def pii_mask_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data masked."""
    return _docs(spark, sf_dir).select("doc_id", mask_pii(F.col("text")).alias("masked"))


def pii_candidate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and matches of each kind of masking candidate."""
    kinds = F.array(*(F.struct(F.lit(token).alias("kind"), F.regexp_count("text", F.lit(p)).alias("n")) for p, token in MASKS))
    found = _docs(spark, sf_dir).select(F.explode(kinds).alias("x")).select("x.*")
    return found.groupBy("kind").agg(F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_matches"))


def secret_scan_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rule and doc_id of each document in which a secret's pattern occurs, where its hexadecimal tokens have been made keys of the rules' services."""
    n = F.col("doc_id") % 4
    token = r'"([0-9a-f]{40})"'
    made = F.coalesce(*(F.when(n == i, F.regexp_replace("text", token, f"{prefix}$1")) for i, prefix in enumerate(("sk-", "AIza", "ghp_"))), F.col("text"))
    docs = _docs(spark, sf_dir).select("doc_id", made.alias("text"))
    rules = F.filter(F.array(*(F.when(F.col("text").rlike(p), r) for r, p in T.SECRETS.items())), lambda r: r.isNotNull())
    return docs.select("doc_id", F.explode(rules).alias("rule"))


def content_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """digest and size of each distinct text."""
    return blobs(_docs(spark, sf_dir)).select("digest", F.char_length("text").alias("n_chars"))


def unique_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's distinct lines, joined."""
    found = T.unique_lines(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(found, "\n").alias("lines"), F.size(found).alias("n_lines"))


def bullet_and_space_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each document cleaning changes; null texts have no row."""
    own = F.split("text", "\n")
    changed = F.size(F.filter(own, lambda x: T.bullet_spacing(x) != x))
    return _docs(spark, sf_dir).filter("text is not null").select("doc_id", changed.cast("long").alias("n_changed"), F.size(own).cast("long").alias("n_lines"))


def line_scan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of blank, long, cell and shouting lines of each document; null texts have no row."""
    tests = {
        "n_blank": lambda x: T.bare(x) == "",
        "n_long": lambda x: F.char_length(x) > 120,
        "n_cells": lambda x: F.contains(x, F.lit(" | ")),
        "n_shout": lambda x: F.contains(x, F.lit("!!")),
    }
    own = F.split("text", "\n")
    return _docs(spark, sf_dir).filter("text is not null").select("doc_id", *(F.size(F.filter(own, t)).cast("long").alias(n) for n, t in tests.items()))


def repeated_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two or more short lines."""
    return lines.runs(lines.lines(_docs(spark, sf_dir)), F.char_length("line") < 40)


def label_value_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and values of cells in pairs."""
    return lines.paired_cells(lines.lines(_docs(spark, sf_dir)))


def first_value_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first value of each label of a document that is not blank."""
    pairs = lines.paired_cells(lines.lines(_docs(spark, sf_dir))).withColumn("key", T.normal_label(F.col("label")))
    return lines.first_per_key(pairs.filter("key <> '' and value <> ''"), ["doc_id", "key"], ["pos", "pair"]).select("doc_id", "key", "value")


def doc_type_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's class by lexicon."""
    return lexicons.classify(_docs(spark, sf_dir), CLASSES)


def structure_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many items of each area each document covers."""
    return lexicons.coverage(_docs(spark, sf_dir), AREAS)


def acceptance_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failing and warning checks of each document, and whether it may be submitted."""
    return checks.rolled_up(_docs(spark, sf_dir), checks.CHECKS)


def acceptance_rollup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roll-up with the checks on lines and cells as well."""
    return checks.rolled_up(_docs(spark, sf_dir), checks.CHECKS + checks.LINE_CHECKS)


def volume_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters, paragraphs and pages (of 900 and of 1500 characters) of each document."""
    n = F.coalesce(F.char_length("text"), F.lit(0))
    return _docs(spark, sf_dir).select("doc_id", n.alias("chars"), F.coalesce(F.size(T.unique_lines(F.col("text"))), F.lit(0)).alias("paragraphs"), F.round(n / 900, 1).alias("pages"), F.greatest(F.lit(1), F.ceil(n / 1500)).cast("long").alias("page_estimate"))


def url_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's normalised address."""
    return table(spark, sf_dir, "pages").select("page_id", T.normal_url(F.col("url")).alias("url"))


def citation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thing that a page lacks as a citation: title, organisation, year, address, or a place on the list of plain http addresses."""
    pages = table(spark, sf_dir, "pages").select(
        "page_id",
        T.bare(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"),
        F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("organisation"),
        T.first_year(F.col("html")).alias("year"),
        T.normal_url(F.col("url")).alias("url"),
    )
    allowed = pages.filter("page_id % 3 = 0").select("url").distinct().withColumn("listed", F.lit(True))
    status = F.when(F.col("title") == "", "MISSING_TITLE").when(F.col("organisation") == "", "MISSING_ORGANIZATION").when(F.col("year") == "", "MISSING_YEAR").when(F.col("url") == "", "MISSING_URL")
    return pages.join(allowed, "url", "left").select("page_id", status.when(F.col("listed").isNull(), "MISMATCH").otherwise("VERIFIED").alias("status"))


def trace_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as traces: attempt, references to the system's, the question's and the answer's blob, previews, and whether the answer is empty."""
    order = W.partitionBy("conv_id").orderBy("turn")
    system = F.max(F.when(F.col("role") == "system", F.col("text"))).over(W.partitionBy("conv_id"))
    rows = table(spark, sf_dir, "conversations").withColumn("question", F.lag("text").over(order)).withColumn("system", system).filter("role = 'assistant'")
    return rows.select(
        "conv_id",
        "turn",
        F.row_number().over(order).alias("attempt"),
        blob_key(F.col("system")).alias("system_ref"),
        blob_key(F.col("question")).alias("user_ref"),
        blob_key(F.col("text")).alias("response_ref"),
        F.substring(F.coalesce("question", F.lit("")), 1, 200).alias("user_preview"),
        F.substring(F.coalesce("text", F.lit("")), 1, 200).alias("response_preview"),
        (T.bare(F.col("text")) == "").alias("empty"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        pii_mask_documents,
        pii_candidate_counts,
        secret_scan_findings,
        content_blobs,
        unique_lines,
        bullet_and_space_cleanup,
        line_scan_counts,
        repeated_line_runs,
        label_value_pairs,
        first_value_per_label,
        doc_type_argmax,
        structure_coverage,
        acceptance_rollup,
        acceptance_rollup_lines,
        volume_metrics,
        url_normalise,
        citation_status,
        trace_records,
    )
}

_BARE = r"regexp_replace({}, '^[\s\pZ]+|[\s\pZ]+$', '', 'g')"
_LINES = r"(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)"
_TRIMMED = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\s\pZ]+|[\s\pZ]+$', '', 'g')), lambda x: x <> '')"
_DISTINCT = f"list_filter(list_transform(range(1, len({_TRIMMED}) + 1), lambda i: CASE WHEN list_position({_TRIMMED}, {_TRIMMED}[i]) = i THEN {_TRIMMED}[i] END), lambda x: x IS NOT NULL)"


def _n(pattern: str, column: str = "text") -> str:
    return f"len(regexp_extract_all({column}, '{pattern}'))"


def _weights(words: dict[str, int]) -> str:
    return " + ".join(f"CASE WHEN contains(lower(coalesce(text, '')), '{w}') THEN {n} ELSE 0 END" for w, n in words.items())


_PAIRS = f"""
    SELECT doc_id, pos, i AS pair, {_BARE.format('cells[2 * i + 1]')} AS label, {_BARE.format('cells[2 * i + 2]')} AS value
    FROM (SELECT doc_id, pos, cells, unnest(range(len(cells) // 2)) AS i FROM (SELECT doc_id, pos, string_split(line, '|') AS cells FROM {_LINES} WHERE contains(line, '|')))"""
_URL = r"regexp_extract(u, '^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?', {})"
_NORMAL = f"""CASE WHEN u = '' THEN '' ELSE (CASE WHEN {_URL.format(1)} = '' THEN 'https' ELSE lower({_URL.format(1)}) END) || '://' || lower({_URL.format(2)})
    || regexp_replace(regexp_replace({_URL.format(3)}, ';[^/]*$', ''), '/+$', '') || (CASE WHEN {_URL.format(4)} = '?' THEN '' ELSE {_URL.format(4)} END) END"""

ORACLES = {
    "pii_mask_documents": f"SELECT doc_id, {mask_sql('text')} AS masked FROM documents",
    "pii_candidate_counts": " UNION ALL ".join(
        f"SELECT '{t}' AS kind, cast(sum(CASE WHEN {_n(p)} > 0 THEN 1 ELSE 0 END) AS bigint) AS n_docs, cast(coalesce(sum({_n(p)}), 0) AS bigint) AS n_matches FROM documents" for p, t in ((_EMAIL, '[이메일]'), (_RESIDENT, '[주민번호]'), (_PHONE, '[전화]'))
    ),
    "secret_scan_findings": r"""
        WITH d AS (
            SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN text ELSE regexp_replace(text, '"([0-9a-f]{40})"', CASE doc_id % 4 WHEN 0 THEN 'sk-\1' WHEN 1 THEN 'AIza\1' ELSE 'ghp_\1' END, 'g') END AS t FROM documents)
        """
    + " UNION ALL ".join(f"SELECT doc_id, '{r}' AS rule FROM d WHERE regexp_matches(t, '{p}')" for r, p in T.SECRETS.items()),
    "content_blobs": "SELECT DISTINCT sha1(text)[1:16] AS digest, length(text) AS n_chars FROM documents WHERE text <> ''",
    "unique_lines": f"SELECT doc_id, array_to_string({_DISTINCT}, chr(10)) AS lines, cast(len({_DISTINCT}) AS integer) AS n_lines FROM documents",
    "bullet_and_space_cleanup": rf"""
        SELECT doc_id, cast(sum(CASE WHEN regexp_replace(regexp_replace(line, '^([ \t]*)([{T.LINE_BULLETS}]+)[ \t]{{2,}}', '\1\2 '), ' {{2,}}', ' ', 'g') <> line THEN 1 ELSE 0 END) AS bigint) AS n_changed,
               count(*) AS n_lines FROM {_LINES} GROUP BY 1""",
    "line_scan_counts": f"""
        SELECT doc_id, cast(sum(CASE WHEN regexp_matches(line, '^[\\s\\pZ]*$') THEN 1 ELSE 0 END) AS bigint) AS n_blank, cast(sum(CASE WHEN length(line) > 120 THEN 1 ELSE 0 END) AS bigint) AS n_long,
               cast(sum(CASE WHEN contains(line, ' | ') THEN 1 ELSE 0 END) AS bigint) AS n_cells, cast(sum(CASE WHEN contains(line, '!!') THEN 1 ELSE 0 END) AS bigint) AS n_shout
        FROM {_LINES} GROUP BY 1""",
    "repeated_line_runs": f"""
        SELECT doc_id, min(pos) AS first, count(*) AS size
        FROM (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM {_LINES} WHERE length(line) < 40)
        GROUP BY doc_id, island HAVING count(*) >= 2""",
    "label_value_pairs": _PAIRS,
    "first_value_per_label": rf"""
        SELECT doc_id, key, value FROM (
            SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY pos, pair) AS nth
            FROM (SELECT *, lower(regexp_replace(label, '[^\p{{L}}\p{{N}}]+', '', 'g')) AS key FROM ({_PAIRS})) WHERE key <> '' AND value <> '') WHERE nth = 1""",
    "doc_type_argmax": f"""
        WITH s AS ({" UNION ALL ".join(f"SELECT doc_id, '{c}' AS label, {i} AS ord, {_weights(w)} AS score FROM documents" for i, (c, w) in enumerate(CLASSES.items()))}),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS nth, lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS runner_up FROM s)
        SELECT doc_id, CASE WHEN score >= 4 THEN label ELSE 'unknown' END AS label, score, runner_up,
               cast(round(CASE WHEN score >= 4 THEN least(0.99::double, 0.4::double + 0.4::double * (score / greatest(1, total)) + 0.2::double * least(1, (score - runner_up) / greatest(1, score))) ELSE 0.3 END, 6) AS double) AS confidence
        FROM (SELECT *, sum(score) OVER (PARTITION BY doc_id) AS total FROM r) WHERE nth = 1""",
    "structure_coverage": " UNION ALL ".join(
        f"SELECT doc_id, '{a}' AS area, n_hit, {len(items)} AS n_items, round(n_hit / {len(items)}, 4) AS ratio FROM (SELECT doc_id, "
        + " + ".join("CASE WHEN " + " OR ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in ws) + " THEN 1 ELSE 0 END" for ws in items.values())
        + " AS n_hit FROM documents)"
        for a, items in AREAS.items()
    ),
    "acceptance_rollup": rf"""
        WITH c AS (
            SELECT doc_id, {_n(r"\[(TODO|TBD|CHECK)\]|lorem ipsum", "t")} AS a, {_n(r"_{3,}|\{\{[^}]*\}\}|O{2,}", "t")} AS b,
                   {_n(r"(?m)^[ \t]*\|[ \t|]*$", "t")} AS d, {_n(r"[!?*%#]{3,}", "t")} AS e, CASE WHEN greatest(1, ceil(length(t) / 1500)) > 10 THEN 1 ELSE 0 END AS f
            FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
        SELECT doc_id, cast((a > 0)::int + (b > 0)::int AS bigint) AS n_fail, cast((d > 0)::int + (e > 0)::int + (f > 0)::int AS bigint) AS n_warn,
               cast(a + b + d + e + f AS bigint) AS defects, a = 0 AND b = 0 AS submittable FROM c""",
    "volume_metrics": f"""
        SELECT doc_id, cast(coalesce(length(text), 0) AS integer) AS chars, cast(coalesce(len({_DISTINCT}), 0) AS integer) AS paragraphs,
               round(coalesce(length(text), 0) / 900, 1) AS pages, cast(greatest(1, ceil(coalesce(length(text), 0) / 1500)) AS bigint) AS page_estimate FROM documents""",
    "url_normalise": rf"SELECT page_id, {_NORMAL} AS url FROM (SELECT page_id, regexp_replace(coalesce(url, ''), '^[\s\pZ]+|[\s\pZ]+$', '', 'g') AS u FROM pages)",
    "citation_status": rf"""
        WITH p AS (
            SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS org,
                   regexp_extract(html, '(?:^|[^0-9])((?:19|20)[0-9][0-9])(?:[^0-9]|$)', 1) AS year, {_NORMAL} AS url
            FROM (SELECT *, regexp_replace(coalesce(url, ''), '^[\s\pZ]+|[\s\pZ]+$', '', 'g') AS u FROM pages))
        SELECT page_id, CASE WHEN title = '' THEN 'MISSING_TITLE' WHEN org = '' THEN 'MISSING_ORGANIZATION' WHEN year = '' THEN 'MISSING_YEAR' WHEN url = '' THEN 'MISSING_URL'
               WHEN url NOT IN (SELECT url FROM p WHERE page_id % 3 = 0) THEN 'MISMATCH' ELSE 'VERIFIED' END AS status FROM p""",
    "trace_records": """
        SELECT conv_id, turn, cast(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS integer) AS attempt, CASE WHEN coalesce(sys, '') = '' THEN '' ELSE sha1(sys)[1:16] END AS system_ref,
               substring(coalesce(q, ''), 1, 200) AS user_preview, CASE WHEN coalesce(q, '') = '' THEN '' ELSE sha1(q)[1:16] END AS user_ref, CASE WHEN coalesce(text, '') = '' THEN '' ELSE sha1(text)[1:16] END AS response_ref,
               substring(coalesce(text, ''), 1, 200) AS response_preview, trim(coalesce(text, '')) = '' AS empty
        FROM (
            SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS q, max(CASE WHEN role = 'system' THEN text END) OVER (PARTITION BY conv_id) AS sys FROM conversations) WHERE role = 'assistant'""",
}
#: The driver's documents hold none of the words that the checks on lines ask for, so only the first five count.
ORACLES["acceptance_rollup_lines"] = ORACLES["acceptance_rollup"]
