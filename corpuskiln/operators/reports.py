"""Reports on forms, documents and runs: coverage of headings, summaries, gaps to a benchmark, decisions by rules, and records of runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuskiln.functions.text import bare, holds_any

UNKNOWN = "UNKNOWN"


def category(heading: Column, rules: Sequence[tuple[str, str, float]]) -> Column:
    """struct<category, confidence>: of the rules (pattern, category, confidence) that match a heading the surest, the first of equal ones; UNKNOWN with 0 without one."""
    t = bare(heading)
    ordered = sorted(enumerate(rules), key=lambda r: (-r[1][2], r[0]))
    found = [F.when(t.rlike(p), F.struct(F.lit(c).alias("category"), F.lit(float(s)).alias("confidence"))) for _, (p, c, s) in ordered]
    return F.when(t != "", F.coalesce(*found, F.lit(None).cast("struct<category:string,confidence:double>"))) if found else F.lit(None).cast("struct<category:string,confidence:double>")


def heading_coverage(headings: DataFrame, rules: Sequence[tuple[str, str, float]], required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """What the headings (doc_id, pos, heading) of documents are about.

    groups: doc_id, category, n and headings (in order) of each category that a document has. report: doc_id, missing (the
    required categories without a heading, in their order) and coverage (the share of those with one, to two places).
    """
    named = headings.withColumn("x", category(F.col("heading"), rules)).withColumn("category", F.coalesce("x.category", F.lit(UNKNOWN)))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("pos", "heading"))), lambda x: x["heading"])
    groups = named.groupBy("doc_id", "category").agg(F.count("*").alias("n"), in_order.alias("headings"))
    missing = F.array_except(F.array(*map(F.lit, required)), F.collect_set("category"))
    report = named.groupBy("doc_id").agg(missing.alias("missing"))
    return groups, report.withColumn("coverage", F.bround((len(required) - F.size("missing")) / F.lit(len(required)), 2))


def form_summaries(docs: DataFrame, sections: DataFrame, cells: DataFrame, images: DataFrame, questions: DataFrame, areas: Mapping[str, Sequence[str]], most: int = 30) -> DataFrame:
    """doc_id, n_sections, n_tables, n_images, n_questions, n_required, n_required_cells, items and a column for each area, of every document.

    Inputs as in `templates.questions`, and its result. items: the labels of the first `most` questions that have one, required
    ones first and marked, in their order. An area is there if one of its words stands in a label of a question or section.
    """
    count = lambda df, name, c=F.lit(1): df.groupBy("doc_id").agg(F.count(c).alias(name))
    parts = [
        count(sections, "n_sections"),
        cells.groupBy("doc_id").agg(F.count_distinct("table").alias("n_tables"), F.count(F.when(F.col("required"), 1)).alias("n_required_cells")),
        count(images, "n_images"),
        questions.groupBy("doc_id").agg(F.count("*").alias("n_questions"), F.count(F.when(F.col("required"), 1)).alias("n_required")),
    ]
    out = docs.select("doc_id").distinct()
    for p in parts:
        out = out.join(p, "doc_id", "left")
    counts = ["n_sections", "n_tables", "n_images", "n_questions", "n_required", "n_required_cells"]
    asked = questions.filter(bare(F.col("label")) != "").select("doc_id", "nth", F.coalesce("required", F.lit(False)).alias("required"), bare(F.col("label")).alias("label"))
    item = F.when(F.col("required"), F.concat(F.lit("[필수] "), F.col("label"))).otherwise(F.col("label"))
    first = F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("required").desc(), "nth"))
    listed = asked.withColumn("at", first).filter(F.col("at") <= most).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", item.alias("item")))), lambda x: x["item"]).alias("items"))
    labels = questions.select("doc_id", "label").unionByName(sections.select("doc_id", "label"))
    held = labels.groupBy("doc_id").agg(*(F.max(holds_any(F.col("label"), words)).alias(area) for area, words in areas.items()))
    out = out.join(listed, "doc_id", "left").join(held, "doc_id", "left").fillna(0, counts)
    return out.select("doc_id", *counts, F.coalesce("items", F.array().cast("array<string>")).alias("items"), *(F.coalesce(a, F.lit(False)).alias(a) for a in areas))


def document_metrics(docs: DataFrame, guide: str, sample: str, separator: str = "|") -> DataFrame:
    """doc_id and the metrics of every document, in one pass over its lines.

    Lines with a separator are rows of tables, other lines that are not blank paragraphs. paragraphs, chars (of paragraphs),
    long (of 80 characters or more), guides (paragraphs that match the pattern `guide`), cells, empty (cells), table_chars,
    fill (the share of cells that are not blank, to four places; 0 without any), marks (paragraphs and cells that match
    `guide`) and samples (those that match `sample`). A null text has none.
    """
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    is_row = lambda x: F.contains(x, F.lit(separator))
    told = docs.select(
        "doc_id",
        F.filter(F.transform(F.filter(lines, lambda x: ~is_row(x)), bare), lambda x: x != "").alias("p"),
        F.flatten(F.transform(F.filter(lines, is_row), lambda x: F.transform(F.split(x, f"[{separator}]"), bare))).alias("c"),
    )
    n = lambda xs, test: F.size(F.filter(xs, test)).cast("long")
    chars = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + F.char_length(x))
    matches = lambda pattern: n("p", lambda x: x.rlike(pattern)) + n("c", lambda x: x.rlike(pattern))
    size, empty = F.size("c").cast("long"), n("c", lambda x: x == "")
    return told.select(
        "doc_id",
        F.size("p").cast("long").alias("paragraphs"),
        chars("p").alias("chars"),
        n("p", lambda x: F.char_length(x) >= 80).alias("long"),
        n("p", lambda x: x.rlike(guide)).alias("guides"),
        size.alias("cells"),
        empty.alias("empty"),
        chars("c").alias("table_chars"),
        F.when(size > 0, F.bround((size - empty) / size, 4)).otherwise(0.0).alias("fill"),
        matches(guide).alias("marks"),
        matches(sample).alias("samples"),
    )


def is_completed() -> Column:
    """Whether metrics are those of a document filled in: much running text, few blank cells and few guides."""
    blank = F.when(F.col("cells") > 0, F.col("empty") / F.col("cells")).otherwise(0.0)
    guided = F.when(F.col("paragraphs") > 0, F.col("guides") / F.col("paragraphs")).otherwise(0.0)
    told = (F.col("long") >= 8) & (blank <= 0.18) & (F.col("guides") <= 12)
    return told | ((F.col("paragraphs") >= 40) & (F.col("chars") >= 1800) & (blank <= 0.12) & (guided <= 0.25))


def benchmark_gaps(made: DataFrame, benchmark: DataFrame, key: str) -> DataFrame:
    """key, mode, chars_gap, table_gap, fill_gap, marks_gap, table_ratio and passed of every document made.

    made: key, errors, and the metrics; benchmark: key, is_template and the metrics. Gaps are made minus benchmark; table_ratio
    is the distance of the tables' characters, as a share of the benchmark's (0 if it has none). Against its own template a
    document passes without errors; against a benchmark it must also fill its tables to within 0.02 and hold their characters
    to within 0.05. Without a benchmark the mode is benchmark_missing, and it does not pass.
    """
    columns = ("chars", "table_chars", "fill", "marks")
    both = made.join(benchmark.select(key, "is_template", *(F.col(c).alias(f"b_{c}") for c in columns), F.lit(True).alias("there")), key, "left")
    gap = lambda c: F.col(c) - F.col(f"b_{c}")
    fill = F.bround(gap("fill"), 4)
    ratio = F.when(F.col("there"), F.when(F.col("b_table_chars") > 0, F.bround(F.abs(gap("table_chars")) / F.col("b_table_chars"), 4)).otherwise(0.0))
    sound = F.coalesce("errors", F.lit(0)) == 0
    mode = F.when(F.col("there").isNull(), "benchmark_missing").when(F.col("is_template"), "template_reference").otherwise("benchmark_document")
    passed = F.when(mode == "benchmark_missing", False).when(mode == "template_reference", sound).otherwise(sound & (fill >= -0.02) & (ratio <= 0.05))
    return both.select(key, mode.alias("mode"), gap("chars").alias("chars_gap"), gap("table_chars").alias("table_gap"), fill.alias("fill_gap"), gap("marks").alias("marks_gap"), ratio.alias("table_ratio"), passed.alias("passed"))


def rule_decisions(rules: DataFrame, guards: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, total, passed, na, failed, review_required, unverifiable, can_finalize and blocked of every run (run_id, domain).

    rules: rule_id, domain (all, or one) and automated; guards: run_id, rule_id and passed, of which a rule's must all pass. A
    rule of another domain does not apply; one with a guard passes or fails; one without is unverifiable if automated, else to
    be reviewed. The first of failed, to be reviewed and unverifiable rules blocks. Rules without a guard are counted by domain
    and not met with every run.
    """
    by = rules.groupBy("domain").agg(F.count("*").alias("n"), F.count(F.when(F.col("automated"), 1)).alias("auto"))
    every = rules.agg(F.count("*").alias("total"), F.count(F.when(F.col("domain") == "all", 1)).alias("n_all"), F.count(F.when((F.col("domain") == "all") & F.col("automated"), 1)).alias("auto_all")).first()
    own = by.filter("domain <> 'all'")
    told = guards.groupBy("run_id", "rule_id").agg(F.min(F.coalesce("passed", F.lit(False))).alias("ok"))
    told = told.join(rules, "rule_id").join(runs.select("run_id", F.col("domain").alias("asked")), "run_id").filter("domain = 'all' or domain = asked")
    count = lambda c: F.sum(c.cast("long"))
    auto = F.coalesce("automated", F.lit(False))
    told = told.groupBy("run_id").agg(count(F.col("ok")).alias("passed"), count(~F.col("ok")).alias("failed"), count(auto).alias("told_auto"), count(~auto).alias("told_other"))
    rows = runs.join(own, "domain", "left").join(told, "run_id", "left").fillna(0, ["n", "auto", "passed", "failed", "told_auto", "told_other"])
    n, automated = F.col("n") + every.n_all, F.col("auto") + every.auto_all
    rows = rows.withColumns({"na": every.total - n, "unverifiable": automated - F.col("told_auto"), "review_required": n - automated - F.col("told_other")})
    blocked = F.coalesce(*(F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {name} rules"))) for c, name in (("failed", "FAIL"), ("review_required", "REVIEW_REQUIRED"), ("unverifiable", "UNVERIFIABLE"))), F.lit(""))
    return rows.select("run_id", F.lit(every.total).cast("long").alias("total"), "passed", "na", "failed", "review_required", "unverifiable", (blocked == "").alias("can_finalize"), blocked.alias("blocked"))


#: What a status of a download means, and what in an error speaks of the connection.
DOWNLOAD_CODES = {"NO_ATTACHMENTS": "DOWNLOAD_NO_ATTACHMENTS", "PAGE_FETCH_FAILED": "DOWNLOAD_PAGE_FAILED", "EXTRACT_FAILED": "DOWNLOAD_EXTRACT_FAILED", "DOWNLOAD_FAILED": "DOWNLOAD_HTTP_FAILED"}
BEHIND_LOGIN = ("PAGE_FETCH_FAILED", "NO_ATTACHMENTS", "EXTRACT_FAILED")
CONNECTION = "(?i)ssl|certificate|unexpected_eof|tls"


def download_failures(runs: DataFrame, logs: DataFrame, walled: Sequence[str], always: Sequence[str]) -> DataFrame:
    """run_id, seq, code and cause of what went wrong with each run's downloads.

    runs: run_id, url, exit_code, errors (a text) and folder_found; logs: run_id, seq, status, error and detail_url. A run on a
    site behind a login (a domain of `walled` in its address or in one of its logs' addresses) has LOGIN_WALL alone, if one of
    its logs says so or its own address is of `always`. Else each failed log has its code in order, a page that could not be
    fetched with the cause connection or page; without any, DOWNLOAD_UNKNOWN for an exit code other than 0, else
    DOWNLOAD_FOLDER_UNKNOWN for a folder that was not found. Runs without failures have no row.
    """
    lower = lambda c: F.lower(F.coalesce(c, F.lit("")))
    of = lambda c, domains: holds_any(lower(F.col(c)), [d.lower() for d in domains])
    told = logs.groupBy("run_id").agg(F.max(of("detail_url", walled)).alias("log_walled"), F.max(F.col("status").isin(*BEHIND_LOGIN)).alias("bad"))
    rows = runs.join(told, "run_id", "left")
    wall = (of("url", walled) | F.coalesce("log_walled", F.lit(False))) & (F.coalesce("bad", F.lit(False)) | of("url", always))
    rows = rows.withColumn("wall", wall)
    login = rows.filter("wall").select("run_id", F.lit(0).cast("long").alias("seq"), F.lit("LOGIN_WALL").alias("code"), F.lit("").alias("cause"))
    codes = F.create_map(*(F.lit(x) for kv in DOWNLOAD_CODES.items() for x in kv))
    failed = logs.withColumn("code", F.try_element_at(codes, F.col("status"))).filter("code is not null").join(rows.filter(~F.col("wall")).select("run_id", "errors"), "run_id")
    broken = lower(F.col("errors")).rlike(CONNECTION) | lower(F.col("error")).rlike(CONNECTION)
    cause = F.when(F.col("status") == "PAGE_FETCH_FAILED", F.when(broken, "connection").otherwise("page")).otherwise("")
    failed = failed.select("run_id", F.col("seq").cast("long").alias("seq"), "code", cause.alias("cause"))
    other = rows.filter(~F.col("wall")).join(failed.select("run_id"), "run_id", "left_anti")
    code = F.when(F.col("exit_code") != 0, "DOWNLOAD_UNKNOWN").when(~F.coalesce("folder_found", F.lit(True)), "DOWNLOAD_FOLDER_UNKNOWN")
    other = other.select("run_id", F.lit(0).cast("long").alias("seq"), code.alias("code"), F.lit("").alias("cause")).filter("code is not null")
    return login.unionByName(failed).unionByName(other)


#: What is said of a run's result.
VERDICTS = {"error": "검사불능", "unchecked": "미검사", "submittable": "제출가능", "not submittable": "제출불가"}


def run_records(runs: DataFrame, evals: DataFrame, quality: DataFrame, submissions: DataFrame, acceptance: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """run_id, template_type, eval_score, eval_max, quality_score, acceptance_fail, acceptance_warn, verdict and needs_input of every run (run_id, file).

    Scores come from the run's own reports (evals: run_id, score, max; quality: run_id, score) and, each where it is null, from
    its submission (run_id, eval_score, eval_max, quality_score). acceptance: run_id, submittable, fail_defects, warn_defects,
    needs_input and error; needs_input counts for .docx files alone. A file's type is that of its suffix in `kinds`, else the
    suffix itself. Each report has one row for a run at most.
    """
    suffix = F.lower(F.regexp_extract(F.coalesce("file", F.lit("")), r"[^/\\](\.[^./\\]*)$", 1))
    types = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))
    rows = runs.select("run_id", suffix.alias("suffix"))
    rows = rows.join(evals.select("run_id", F.col("score").alias("e"), F.col("max").alias("m")), "run_id", "left")
    rows = rows.join(quality.select("run_id", F.col("score").alias("q")), "run_id", "left")
    rows = rows.join(submissions.select("run_id", *(F.col(c).alias(f"s_{c}") for c in ("eval_score", "eval_max", "quality_score"))), "run_id", "left")
    rows = rows.join(acceptance.select("run_id", "submittable", "fail_defects", "warn_defects", F.col("needs_input").alias("asks"), "error", F.lit(True).alias("checked")), "run_id", "left")
    failed = F.col("error").isNotNull()
    verdict = F.when(failed, VERDICTS["error"]).when(F.col("checked").isNull(), VERDICTS["unchecked"]).when(F.coalesce("submittable", F.lit(False)), VERDICTS["submittable"]).otherwise(VERDICTS["not submittable"])
    none = F.array().cast("array<string>")
    return rows.select(
        "run_id",
        F.coalesce(F.try_element_at(types, F.col("suffix")), F.regexp_replace("suffix", r"^\.+", "")).alias("template_type"),
        F.coalesce("e", "s_eval_score").alias("eval_score"),
        F.coalesce("m", "s_eval_max").alias("eval_max"),
        F.coalesce("q", "s_quality_score").alias("quality_score"),
        F.when(~failed, F.col("fail_defects")).alias("acceptance_fail"),
        F.when(~failed, F.col("warn_defects")).alias("acceptance_warn"),
        verdict.alias("verdict"),
        F.when((F.col("suffix") == ".docx") & ~failed, F.coalesce("asks", none)).otherwise(none).alias("needs_input"),
    )
