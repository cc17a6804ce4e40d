"""Queries of reports; the driver's tables stand in for forms, rules and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.functions import parsing
from corpuskiln.operators import lines, reports, tables, templates
from corpuskiln.plans import templates as plans
from corpuskiln.sources.tables import table

RULES = (("(?i)tion", "PROBLEM", 0.9), ("ing|ung", "SOLUTION", 1.0), ("ment", "MARKET", 0.9), (r"[0-9]", "BM", 1.0), ("^La|^Le", "TEAM", 0.95))
REQUIRED = ("PROBLEM", "SOLUTION", "MARKET", "BM", "TEAM", "SCALEUP")
AREAS = {"problem": ("tion", "ment"), "scale": ("heit", "scale"), "team": ("xyz",)}
GUIDE, SAMPLE = "!!|%%%", "###|00"
KINDS = {".docx": "word", ".hwpx": "hangul"}


def _headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.lines(table(spark, sf_dir, "documents"))
    return rows.filter((F.char_length("line") < 60) & ~F.contains("line", F.lit("|"))).select("doc_id", "pos", F.col("line").alias("heading"))


def heading_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The short lines of every document by what they are about."""
    groups, _ = reports.heading_coverage(_headings(spark, sf_dir), RULES, REQUIRED)
    return groups.withColumn("headings", F.array_join("headings", "~"))


def heading_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the short lines of every document leave out."""
    _, report = reports.heading_coverage(_headings(spark, sf_dir), RULES, REQUIRED)
    return report.withColumn("missing", F.array_join("missing", ","))


def form_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document asks for as a form."""
    docs = table(spark, sf_dir, "documents")
    rows = lines.lines(docs)
    cells = tables.cells(rows).filter(F.char_length("cell") < 5).select("doc_id", "table", "row", "col", F.concat_ws("_", "table", "row", "col").alias("cell_id"), F.col("cell").alias("label"), F.lit("text").alias("field_type"), (F.col("col") % 2 == 0).alias("required"))
    images = rows.filter(F.contains("line", F.lit("###"))).select("doc_id", F.col("pos").alias("place"), F.concat(F.lit("slot_"), F.col("pos").cast("string")).alias("slot_id"), F.lit("p").alias("label"))
    found = templates.sections(rows, plans.RULES)
    asked = templates.questions(docs, found, cells, images)
    return reports.form_summaries(docs, found, cells, images, asked, AREAS).withColumn("items", F.array_join("items", "~"))


def completed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of every document, and whether it is filled in."""
    found = reports.document_metrics(table(spark, sf_dir, "documents"), GUIDE, SAMPLE)
    return found.withColumn("completed", reports.is_completed())


def benchmark_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against the one before it as its benchmark, or as its template."""
    found = reports.document_metrics(table(spark, sf_dir, "documents"), GUIDE, SAMPLE)
    i = F.col("doc_id")
    benchmark = found.filter(i % 10 != 9).withColumn("is_template", i % 4 == 0).withColumn("doc_id", i + 1)
    return reports.benchmark_gaps(found.withColumn("errors", i % 3), benchmark, "doc_id")


def rule_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rules, suppliers as runs and what they delivered as guards: what each run may finalise."""
    p, s = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    rules = p.select(F.col("p_partkey").alias("rule_id"), F.when(F.col("p_size") % 3 == 0, "all").otherwise(F.col("p_brand")).alias("domain"), (F.col("p_size") % 2 == 0).alias("automated"))
    runs = s.select(F.col("s_suppkey").alias("run_id"), F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 7).cast("string")).alias("domain"))
    guards = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("run_id"), F.col("l_partkey").alias("rule_id"), (F.col("l_quantity") > 10).alias("passed"))
    return reports.rule_decisions(rules, guards, runs)


def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs, with reports on some of them: their records."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    run = k.alias("run_id")
    runs = o.select(run, F.concat(F.lit("out/f"), k.cast("string"), F.element_at(F.array(*map(F.lit, (".docx", ".HWPX", ".pdf", ""))), (k % 4 + 1).cast("int"))).alias("file"))
    part = lambda where, *c: o.filter(where).select(run, *c)
    accepted = part("o_orderkey % 4 <> 3 or o_orderkey % 5 = 0", (k % 3 == 0).alias("submittable"), (k % 6).alias("fail_defects"), (k % 5).alias("warn_defects"), F.array(F.col("o_orderpriority")).alias("needs_input"), F.when(k % 8 == 1, "broken").alias("error"))
    found = reports.run_records(runs, part("o_orderkey % 2 = 0", F.when(k % 3 != 0, k % 100).alias("score"), F.lit(100).alias("max")), part("o_orderkey % 3 = 0", (k % 50).alias("score")), part("o_orderkey % 5 = 0", (k % 90).alias("eval_score"), F.lit(90).alias("eval_max"), (k % 80).alias("quality_score")), accepted, KINDS)
    return found.withColumn("needs_input", F.array_join("needs_input", ","))


def preview_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a preview of its lines."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(parsing.preview_text(F.col("html"), breaks=True)).alias("digest"), F.char_length(parsing.preview_text(F.col("html"))).alias("n_plain"))


def download_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as runs and orders as logs of downloads: what went wrong."""
    o, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("c_custkey")
    pick = lambda i, *xs: F.element_at(F.array(*map(F.lit, xs)), (i % len(xs) + 1).cast("int"))
    runs = table(spark, sf_dir, "customer").select(c.alias("run_id"), pick(c, "https://Wall.one/a", "https://always.two/b", "https://open.org/c", None, "https://open.org/d").alias("url"), (c % 3).alias("exit_code"), F.when(c % 7 == 0, "TLS alert").alias("errors"), (c % 4 != 0).alias("folder_found"))
    few = o.filter("o_orderkey % 13 < 3")
    logs = few.select(F.col("o_custkey").alias("run_id"), k.alias("seq"), pick(k, "OK", "NO_ATTACHMENTS", "PAGE_FETCH_FAILED", "EXTRACT_FAILED", "DOWNLOAD_FAILED", "OK", "OK").alias("status"), F.when(k % 3 == 0, "bad SSL").alias("error"), F.when(k % 17 == 0, "http://WALL.one/x").alias("detail_url"))
    return reports.download_failures(runs, logs, ("wall.one", "always.two"), ("always.two",))


QUERIES = {f.__name__: f for f in (heading_groups, heading_coverage, form_summaries, completed_documents, benchmark_gaps, rule_decisions, run_records, preview_texts, download_failures)}

_BARE = r"regexp_replace({}, '^[\s\pZ]+|[\s\pZ]+$', '', 'g')"
_HEADINGS = rf"""
    h AS (SELECT * FROM {plans._LINES} WHERE length(line) < 60 AND NOT contains(line, '|')),
    g AS (SELECT doc_id, pos, line, CASE WHEN {_BARE.format("line")} = '' THEN 'UNKNOWN' WHEN regexp_matches(line, 'ing|ung') THEN 'SOLUTION' WHEN regexp_matches(line, '[0-9]') THEN 'BM'
        WHEN regexp_matches({_BARE.format("line")}, '^La|^Le') THEN 'TEAM' WHEN regexp_matches(line, '(?i)tion') THEN 'PROBLEM' WHEN contains(line, 'ment') THEN 'MARKET' ELSE 'UNKNOWN' END AS category FROM h)"""
_METRICS = rf"""
    l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    x AS (
        SELECT doc_id, list_filter(list_transform(list_filter(ls, lambda x: NOT contains(x, '|')), lambda x: {_BARE.format("x")}), lambda x: x <> '') AS p,
               list_transform(flatten(list_transform(list_filter(ls, lambda x: contains(x, '|')), lambda x: string_split(x, '|'))), lambda x: {_BARE.format("x")}) AS c FROM l),
    m AS (
        SELECT doc_id, len(p) AS paragraphs, cast(coalesce(list_sum(list_transform(p, lambda x: length(x))), 0) AS bigint) AS chars, len(list_filter(p, lambda x: length(x) >= 80)) AS long, len(list_filter(p, lambda x: regexp_matches(x, '{GUIDE}'))) AS guides,
               len(c) AS cells, len(list_filter(c, lambda x: x = '')) AS empty, cast(coalesce(list_sum(list_transform(c, lambda x: length(x))), 0) AS bigint) AS table_chars,
               cast(CASE WHEN len(c) > 0 THEN round_even(len(list_filter(c, lambda x: x <> '')) / len(c), 4) ELSE 0 END AS double) AS fill,
               len(list_filter(list_concat(p, c), lambda x: regexp_matches(x, '{GUIDE}'))) AS marks, len(list_filter(list_concat(p, c), lambda x: regexp_matches(x, '{SAMPLE}'))) AS samples FROM x)"""
_REQUIRED = ", ".join(f"'{c}'" for c in REQUIRED)

ORACLES = {
    "preview_texts": r"""
        WITH t AS (SELECT page_id, regexp_replace(replace(coalesce(html, ''), chr(0), ''), '\r\n?', chr(10), 'g') AS t FROM pages),
        l AS (SELECT page_id, string_split(regexp_replace(t, '<br ?/>|<br>', chr(10), 'g'), chr(10)) AS a, string_split(t, chr(10)) AS b FROM t)
        SELECT page_id, md5(array_to_string(list_filter(list_transform(a, lambda x: regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '^[\s\pZ]+|[\s\pZ]+$', '', 'g')), lambda x: x <> ''), chr(10))) AS digest,
               cast(length(array_to_string(list_filter(list_transform(b, lambda x: regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '^[\s\pZ]+|[\s\pZ]+$', '', 'g')), lambda x: x <> ''), chr(10))) AS integer) AS n_plain FROM l""",
    "download_failures": """
        WITH l AS (SELECT o_custkey AS run, o_orderkey AS k, o_orderkey % 7 AS s FROM orders WHERE o_orderkey % 13 < 3),
        g AS (SELECT run, bool_or(k % 17 = 0) AS w, bool_or(s IN (1, 2, 3)) AS bad, bool_or(s BETWEEN 1 AND 4) AS failed FROM l GROUP BY 1),
        r AS (
            SELECT c_custkey AS run, (c_custkey % 5 < 2 OR coalesce(w, false)) AND (coalesce(bad, false) OR c_custkey % 5 = 1) AS wall, coalesce(failed, false) AS failed FROM customer LEFT JOIN g ON run = c_custkey)
        SELECT run AS run_id, 0::bigint AS seq, 'LOGIN_WALL' AS code, '' AS cause FROM r WHERE wall
        UNION ALL SELECT l.run, k, CASE s WHEN 1 THEN 'DOWNLOAD_NO_ATTACHMENTS' WHEN 2 THEN 'DOWNLOAD_PAGE_FAILED' WHEN 3 THEN 'DOWNLOAD_EXTRACT_FAILED' ELSE 'DOWNLOAD_HTTP_FAILED' END,
            CASE WHEN s = 2 THEN CASE WHEN l.run % 7 = 0 OR k % 3 = 0 THEN 'connection' ELSE 'page' END ELSE '' END FROM l JOIN r ON r.run = l.run AND NOT wall WHERE s BETWEEN 1 AND 4
        UNION ALL SELECT run, 0, CASE WHEN run % 3 <> 0 THEN 'DOWNLOAD_UNKNOWN' ELSE 'DOWNLOAD_FOLDER_UNKNOWN' END, '' FROM r WHERE NOT wall AND NOT failed AND (run % 3 <> 0 OR run % 4 = 0)""",
    "heading_groups": f"WITH {_HEADINGS} SELECT doc_id, category, count(*) AS n, string_agg(line, '~' ORDER BY pos) AS headings FROM g GROUP BY ALL",
    "heading_coverage": f"""
        WITH {_HEADINGS}, s AS (SELECT doc_id, list(DISTINCT category) AS held FROM g GROUP BY 1), r AS (SELECT doc_id, list_filter([{_REQUIRED}], lambda x: NOT list_contains(held, x)) AS missing FROM s)
        SELECT doc_id, array_to_string(missing, ',') AS missing, cast(round_even((6 - len(missing)) / 6, 2) AS double) AS coverage FROM r""",
    "completed_documents": f"""
        WITH {_METRICS}, r AS (SELECT *, CASE WHEN cells > 0 THEN empty / cells ELSE 0 END AS blank, CASE WHEN paragraphs > 0 THEN guides / paragraphs ELSE 0 END AS guided FROM m)
        SELECT * EXCLUDE (blank, guided), (long >= 8 AND blank <= 0.18 AND guides <= 12) OR (paragraphs >= 40 AND chars >= 1800 AND blank <= 0.12 AND guided <= 0.25) AS completed FROM r""",
    "benchmark_gaps": f"""
        WITH {_METRICS}, j AS (
            SELECT a.doc_id, b.doc_id % 4 = 0 AS template, b.doc_id IS NOT NULL AS there, a.chars - b.chars AS chars_gap, a.table_chars - b.table_chars AS table_gap, cast(round_even(a.fill - b.fill, 4) AS double) AS fill_gap, a.marks - b.marks AS marks_gap,
                   cast(CASE WHEN b.doc_id IS NULL THEN NULL WHEN b.table_chars > 0 THEN round_even(abs(a.table_chars - b.table_chars) / b.table_chars, 4) ELSE 0 END AS double) AS table_ratio, a.doc_id % 3 = 0 AS sound
            FROM m a LEFT JOIN m b ON b.doc_id = a.doc_id - 1 AND b.doc_id % 10 <> 9)
        SELECT doc_id, CASE WHEN NOT there THEN 'benchmark_missing' WHEN template THEN 'template_reference' ELSE 'benchmark_document' END AS mode, chars_gap, table_gap, fill_gap, marks_gap, table_ratio,
               coalesce(CASE WHEN NOT there THEN false WHEN template THEN sound ELSE sound AND fill_gap >= -0.02 AND table_ratio <= 0.05 END, false) AS passed FROM j""",
    "rule_decisions": """
        WITH r AS (SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'all' ELSE p_brand END AS d, p_size % 2 = 0 AS auto FROM part),
        s AS (SELECT s_suppkey AS run, 'Brand#' || s_suppkey % 7 AS d FROM supplier),
        g AS (SELECT l_suppkey AS run, l_partkey AS id, bool_and(l_quantity > 10) AS ok FROM lineitem GROUP BY ALL),
        e AS (
            SELECT s.run, CASE WHEN r.d NOT IN ('all', s.d) THEN 'na' WHEN ok THEN 'passed' WHEN NOT ok THEN 'failed' WHEN auto THEN 'unverifiable' ELSE 'review' END AS st
            FROM s CROSS JOIN r LEFT JOIN g ON g.run = s.run AND g.id = r.id),
        c AS (
            SELECT run AS run_id, count(*) AS total, count(*) FILTER (WHERE st = 'passed') AS passed, count(*) FILTER (WHERE st = 'na') AS na, count(*) FILTER (WHERE st = 'failed') AS failed,
                   count(*) FILTER (WHERE st = 'review') AS review_required, count(*) FILTER (WHERE st = 'unverifiable') AS unverifiable FROM e GROUP BY 1)
        SELECT *, failed + review_required + unverifiable = 0 AS can_finalize,
               CASE WHEN failed > 0 THEN failed || ' FAIL rules' WHEN review_required > 0 THEN review_required || ' REVIEW_REQUIRED rules' WHEN unverifiable > 0 THEN unverifiable || ' UNVERIFIABLE rules' ELSE '' END AS blocked FROM c""",
    "run_records": """
        WITH o AS (SELECT o_orderkey AS k, o_orderpriority AS p, o_orderkey % 4 <> 3 OR o_orderkey % 5 = 0 AS checked FROM orders),
        x AS (SELECT *, checked AND k % 8 = 1 AS broken FROM o)
        SELECT k AS run_id, CASE k % 4 WHEN 0 THEN 'word' WHEN 1 THEN 'hangul' WHEN 2 THEN 'pdf' ELSE '' END AS template_type,
               coalesce(CASE WHEN k % 2 = 0 AND k % 3 <> 0 THEN k % 100 END, CASE WHEN k % 5 = 0 THEN k % 90 END) AS eval_score, cast(CASE WHEN k % 2 = 0 THEN 100 WHEN k % 5 = 0 THEN 90 END AS integer) AS eval_max,
               CASE WHEN k % 3 = 0 THEN k % 50 WHEN k % 5 = 0 THEN k % 80 END AS quality_score, CASE WHEN checked AND NOT broken THEN k % 6 END AS acceptance_fail, CASE WHEN checked AND NOT broken THEN k % 5 END AS acceptance_warn,
               CASE WHEN broken THEN '검사불능' WHEN NOT checked THEN '미검사' WHEN k % 3 = 0 THEN '제출가능' ELSE '제출불가' END AS verdict, CASE WHEN checked AND NOT broken AND k % 4 = 0 THEN p ELSE '' END AS needs_input FROM x""",
}
