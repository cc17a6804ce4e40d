"""Queries on blocks of lines, scores, matches and ranks; the driver's tables stand in for forms, files and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.operators import checks, lines, matching, quality, ranking
from corpuskiln.plans import forms
from corpuskiln.sources.tables import table

AXES = {"urgent": ("1-URGENT", "2-HIGH"), "other": ("3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")}


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.lines(table(spark, sf_dir, "documents"))


def toggled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every document that lie in blocks which lines with a comma and a vowel at the end switch on and off."""
    return lines.inside_blocks(_lines(spark, sf_dir), F.col("line").rlike("^[AE].*,")).filter("inside").select("doc_id", "pos")


def heading_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first stretch of every document between a line with a comma and a short one."""
    line = F.col("line")
    return lines.spans(_lines(spark, sf_dir), line.contains(","), F.char_length(line) < 40)


def keyword_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section of every line: the beginning of the nearest line that begins with an article for the first time."""
    word = F.regexp_extract("line", "^(The|Th|La|Le|De|Die|El|É)", 1)
    return lines.first_sections(_lines(spark, sf_dir), F.when(word != "", word)).select("doc_id", "pos", "section")


def key_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first lines of every document with a frequent syllable and a digit, as many as its length allows."""
    return lines.key_sentences(_lines(spark, sf_dir), ["tion", "ment", "the", "ein", "la"], 0.2, 1, 3).select("doc_id", "pos", "nth")


def lines_without_guides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without its lines of up to 120 characters with a comma."""
    return lines.without_guides(_lines(spark, sf_dir), F.contains("line", F.lit(","))).select("doc_id", "pos")


def axis_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's scores by two axes of priorities."""
    items = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderpriority").alias("item"), ((F.col("o_orderkey") % 10) / 2).alias("score"))
    return quality.axis_sums(items, AXES)


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as criteria: totals, ratio and the weak sections in order."""
    k = F.col("o_orderkey")
    scores = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), (k % 7).alias("score"), F.lit(6).alias("max_score"), F.when(k % 5 != 0, F.col("o_orderpriority")).alias("section"), k.alias("seq"))
    return quality.evaluation(scores).withColumn("weak_sections", F.array_join("weak_sections", ","))


def defect_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of work each open check of every form is, where forms have been run up to four times."""
    found = checks.with_remedies(forms._acceptance_results(spark, sf_dir)).withColumn("n_runs", F.col("doc_id") % 5)
    return checks.categories(found).select("doc_id", "check_id", "category")


def severity_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The open checks of every form, failing ones first."""
    found = forms._acceptance_results(spark, sf_dir).withColumn("seq", F.col("check_id"))
    return ranking.severity_first(found, "doc_id").select("doc_id", "check_id", "rank")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    suffix = F.element_at(F.array(*map(F.lit, (".hwp", ".TXT", ".docx", ".pdf", ""))), (i % 5 + 1).cast("int"))
    name = F.concat(F.when(i % 4 == 0, "공고문 ").when(i % 6 == 1, "모집-").otherwise(""), (i % 60).cast("string"), F.when(i % 3 == 0, " plan").otherwise(""))
    return table(spark, sf_dir, "pages").select((i % 40).alias("folder"), F.concat(F.lit("d/"), name, suffix).alias("path"), (i % 9).alias("mtime"), i.alias("page_id"))


def announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The announcement of each folder of files."""
    return ranking.best_announcement(_files(spark, sf_dir), ["plan", "1"])


def stem_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file of each stem."""
    files = _files(spark, sf_dir).select("path").distinct()
    return ranking.one_per_stem(files).select("stem", "path")


def required_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five items of each customer, required ones first."""
    k = F.col("o_orderkey")
    items = table(spark, sf_dir, "orders").select("o_custkey", k.alias("seq"), F.when(k % 4 != 0, k % 3 == 0).alias("required"))
    return ranking.required_first(items, "o_custkey", 5).select("o_custkey", "seq", "rank")


def part_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many parts each brand and type has, and the names of the five smallest keys."""
    found = ranking.samples(table(spark, sf_dir, "part"), ["p_brand", "p_type"], "p_name", ["p_partkey"])
    return found.withColumn("samples", F.array_join("samples", "|"))


def demoted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's form whose fields are orders' priorities: the matches that are taken back, and why."""
    o, k, p = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_orderpriority")
    fields = o.select(F.col("o_custkey").alias("form"), p.alias("key"), F.concat(p, F.when(k % 4 == 0, "(a)").when(k % 4 == 1, " ( b )").otherwise("")).alias("label"), k.alias("pos"), F.lit(None).cast("string").alias("cluster"))
    keys, low = o.select(p.alias("target")).distinct(), F.col("target").startswith("4")
    matched = keys.select("target", F.when(~low, F.concat(F.lit("s"), F.col("target"))).alias("source"), F.when(low, "low").otherwise("high").alias("confidence"), F.array().cast("array<string>").alias("candidates"))
    values = keys.select(F.concat(F.lit("s"), F.col("target")).alias("source"), F.concat(F.col("target"), F.when(F.col("target").startswith("1"), "(b)").otherwise("")).alias("label"), F.when(F.col("target").startswith("5"), "a, b").otherwise("홍길동").alias("value"))
    found = matching.demoted(fields, matched, values, "form", F.col("key").rlike("^[25]"))
    return found.select("form", "key", "pos", "value", "confidence", F.array_join("candidates", ",").alias("candidates"))


QUERIES = {
    f.__name__: f
    for f in (
        toggled_lines, heading_spans, keyword_sections, key_sentences, lines_without_guides, axis_scores, evaluations, defect_categories, severity_ranks, announcements, stem_references, required_items, part_samples, demoted_fields,
    )
}

_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, cast(unnest(range(len(string_split(text, chr(10))))) AS integer) AS pos FROM documents)"
_BARE = r"regexp_replace({}, '^[\s\pZ]+|[\s\pZ]+$', '', 'g')"
_FILES = """
    f AS (
        SELECT page_id % 40 AS folder, page_id % 9 AS mtime, CASE WHEN page_id % 4 = 0 THEN '공고문 ' WHEN page_id % 6 = 1 THEN '모집-' ELSE '' END || page_id % 60 || CASE WHEN page_id % 3 = 0 THEN ' plan' ELSE '' END AS stem,
               ['.hwp', '.TXT', '.docx', '.pdf', ''][page_id % 5 + 1] AS suffix FROM pages)"""

ORACLES = {
    "toggled_lines": f"SELECT doc_id, pos FROM (SELECT doc_id, pos, sum(regexp_matches(line, '^[AE].*,')::int) OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM {_LINES}) WHERE n % 2 = 1",
    "heading_spans": f"""
        WITH l AS (SELECT *, contains(line, ',') AS o, length(line) < 40 AND NOT contains(line, ',') AS c FROM {_LINES}),
        b AS (SELECT *, sum(o::int) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS began FROM l),
        e AS (SELECT *, sum(c::int) OVER (PARTITION BY doc_id ORDER BY pos) AS ended FROM b WHERE began > 0)
        SELECT doc_id, min(pos) AS first, cast(sum(length({_BARE.format("line")})) AS bigint) AS n_chars FROM e WHERE ended = 0 GROUP BY 1""",
    "keyword_sections": f"""
        WITH k AS (SELECT doc_id, pos, nullif(regexp_extract(line, '^(The|Th|La|Le|De|Die|El|É)', 1), '') AS k FROM {_LINES}),
        n AS (SELECT *, CASE WHEN k IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, k ORDER BY pos) = 1 THEN k END AS fresh FROM k)
        SELECT doc_id, pos, last_value(fresh IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM n""",
    "key_sentences": rf"""
        WITH l AS (SELECT doc_id, pos, {_BARE.format("line")} AS line FROM {_LINES}),
        b AS (SELECT doc_id, least(3, greatest(1, floor(count(*) FILTER (WHERE line <> '') * 0.2))) AS budget FROM l GROUP BY 1),
        f AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM l WHERE length(line) >= 8 AND regexp_matches(line, '[0-9]') AND regexp_matches(line, 'tion|ment|the|ein|la'))
        SELECT doc_id, pos, cast(nth AS integer) AS nth FROM f JOIN b USING (doc_id) WHERE nth <= budget""",
    "lines_without_guides": f"SELECT doc_id, pos FROM (SELECT *, max(pos) OVER (PARTITION BY doc_id) AS last FROM {_LINES}) WHERE NOT contains(line, ',') OR length(line) > 120 OR pos = last",
    "axis_scores": """
        SELECT o_custkey AS doc, cast(round_even(sum(o_orderkey % 10 / 2), 1) AS double) AS total, cast(round_even(coalesce(sum(o_orderkey % 10 / 2) FILTER (WHERE o_orderpriority < '3'), 0), 1) AS double) AS urgent,
               cast(round_even(coalesce(sum(o_orderkey % 10 / 2) FILTER (WHERE o_orderpriority >= '3'), 0), 1) AS double) AS other FROM orders GROUP BY 1""",
    "evaluations": """
        WITH o AS (SELECT o_custkey AS run, o_orderkey % 7 AS s, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS sec, o_orderkey AS k FROM orders),
        w AS (SELECT run, string_agg(sec, ',' ORDER BY k) AS weak FROM (SELECT run, sec, min(k) AS k FROM o WHERE s < 6 * 0.6 AND sec IS NOT NULL GROUP BY ALL) GROUP BY 1)
        SELECT run, cast(sum(s) AS bigint) AS total, cast(6 * count(*) AS bigint) AS most, cast(round_even(sum(s) / (6 * count(*)), 4) AS double) AS ratio, coalesce(any_value(weak), '') AS weak_sections FROM o LEFT JOIN w USING (run) GROUP BY run""",
    "defect_categories": f"""
        WITH {forms._ACCEPTANCE}, w AS (SELECT doc_id, x.check_id AS check_id, x.severity AS s, {forms._KINDS} AS kind FROM r WHERE x.defects > 0)
        SELECT doc_id, check_id, CASE WHEN doc_id % 5 >= 3 AND (kind = 'manual' OR (kind = 'auto' AND s = 'warn')) THEN 'code_improvement' WHEN kind = 'auto' THEN 'auto_fix' WHEN kind = 'human' THEN 'human_input' ELSE 'manual_review' END AS category FROM w""",
    "severity_ranks": f"""
        WITH {forms._ACCEPTANCE} SELECT doc_id, x.check_id AS check_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY (x.severity <> 'fail')::int, x.check_id) AS integer) AS rank FROM r WHERE x.defects > 0""",
    "announcements": f"""
        WITH {_FILES}, r AS (
            SELECT folder, 'd/' || stem || suffix AS path, row_number() OVER (PARTITION BY folder ORDER BY contains(stem, '공고문') OR contains(stem, '모집') DESC, contains(stem, 'plan')::int + contains(stem, '1')::int DESC, mtime DESC, 'd/' || stem || suffix) AS nth FROM f)
        SELECT folder, path FROM r WHERE nth = 1""",
    "stem_references": f"""
        WITH {_FILES}, d AS (SELECT DISTINCT trim(lower(stem)) AS stem, 'd/' || stem || suffix AS path FROM f),
        r AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY lower(path) NOT LIKE '%.docx', lower(path) NOT LIKE '%.txt', lower(path), path) AS nth FROM d)
        SELECT stem, path FROM r WHERE nth = 1""",
    "required_items": """
        SELECT o_custkey, o_orderkey AS seq, cast(rank AS integer) AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderkey % 4 <> 0 AND o_orderkey % 3 = 0) DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 5""",
    "part_samples": """
        SELECT p_brand, p_type, count(*) AS n, string_agg(p_name, '|' ORDER BY p_partkey) FILTER (WHERE nth <= 5) AS samples
        FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS nth FROM part) GROUP BY ALL""",
    "demoted_fields": """
        WITH o AS (
            SELECT o_custkey AS form, o_orderpriority AS key, o_orderkey AS pos, o_orderpriority NOT LIKE '4%' AS high,
                   CASE WHEN o_orderpriority LIKE '1%' AND o_orderkey % 4 = 0 THEN 'bracket' WHEN o_orderpriority LIKE '5%' THEN 'value_type' END AS why FROM orders),
        b AS (SELECT *, count(*) FILTER (WHERE high AND why IS NULL) OVER (PARTITION BY form, key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o),
        w AS (SELECT *, CASE WHEN high AND coalesce(why, '') <> 'bracket' AND before > 0 THEN 'duplicate' ELSE why END AS y FROM b)
        SELECT form, key, pos, CASE WHEN high AND y IS NULL THEN '홍길동' END AS value, coalesce(y, CASE WHEN high THEN 'high' ELSE 'low' END) AS confidence, CASE WHEN y IS NOT NULL THEN 's' || key ELSE '' END AS candidates FROM w""",
}
