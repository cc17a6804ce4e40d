"""Operators on records: merging with conflicts, recurrence, gates, coverage, dominant values, grids and scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuskiln.functions.text import bare


def merge_sources(rows: DataFrame, entity: str, field: str, value: str, source: str, priority: str, norm: Column) -> DataFrame:
    """One row for each entity and field: the first value by priority, how far the sources agree, and the candidates.

    confidence: conflict if normalised values differ, high if two or more sources agree, medium otherwise. Blank and null
    values are no values.
    """
    held = rows.filter(bare(F.col(value)) != "").withColumn("norm", norm)
    return (
        held.groupBy(entity, field)
        .agg(
            F.min_by(value, F.struct(priority, value)).alias("value"),
            F.count_distinct("norm").alias("n_values"),
            F.count_distinct(source).alias("n_sources"),
            F.array_sort(F.collect_set(value)).alias("candidates"),
        )
        .withColumn("confidence", F.when(F.col("n_values") > 1, "conflict").when(F.col("n_sources") > 1, "high").otherwise("medium"))
    )


def recent(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The last n rows by `order`."""
    return rows.orderBy(F.col(order).desc()).limit(n)


def recurrence(defects: DataFrame, runs: DataFrame, check: str, run: str, seq: str) -> DataFrame:
    """check, n_runs and runs (in the order first seen) of the defects whose run is among `runs`; blank run ids are left out."""
    known = runs.select(run).filter(bare(F.col(run).cast("string")) != "").distinct()
    met = defects.join(known, run, "left_semi").groupBy(check, run).agg(F.min(seq).alias("first"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("first", run))), lambda x: x[run])
    return met.groupBy(check).agg(F.count("*").alias("n_runs"), ordered.alias("runs"))


def promote(found: DataFrame, check: str, kind: str, severity: Column, least: int = 3, stored: DataFrame | None = None) -> DataFrame:
    """Defects of `least` or more runs as candidates, with a stable id and a priority; those whose id is `stored` (candidate_id) already are left out."""
    priority = F.when((severity == "fail") & (F.col("n_runs") >= least), "high").when((severity != "fail") & (F.col("n_runs") >= 2), "medium").otherwise("low")
    identity = F.substring(F.sha1(F.concat_ws(":", F.col(check), F.lit(kind)).cast("binary")), 1, 12)
    fresh = found.filter(F.col("n_runs") >= least).select(check, "n_runs", identity.alias("candidate_id"), priority.alias("priority"))
    return fresh if stored is None else fresh.join(stored.select("candidate_id"), "candidate_id", "left_anti").select(fresh.columns)


def gate(current: DataFrame, baseline: DataFrame, key: str, value: str, slack: float = 1e-9) -> DataFrame:
    """key, was, now and status of every key of either: SEED without a baseline, DROPPED without a current value, FAIL if lower, else OK or IMPROVED."""
    now, was = current.select(key, F.col(value).alias("now")), baseline.select(key, F.col(value).alias("was"))
    status = F.when(F.col("was").isNull(), "SEED").when(F.col("now").isNull(), "DROPPED").when(F.col("now") < F.col("was") - slack, "FAIL")
    return now.join(was, key, "full_outer").select(key, "was", "now", status.when(F.col("now") > F.col("was") + slack, "IMPROVED").otherwise("OK").alias("status"))


def macro_f1(rows: DataFrame, truth: str, said: str) -> DataFrame:
    """One row: the mean of the labels' F1 over all labels of either column, rounded to 9 places; 0 for a label never right."""
    both = rows.groupBy(truth, said).agg(F.count("*").alias("n"))
    per = both.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t")), F.struct(F.col(said).alias("label"), F.lit(0).alias("t")))).alias("x"), "n", (F.col(truth) == F.col(said)).alias("right"))
    per = per.groupBy("x.label").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("right"), F.col("n")).otherwise(0)).alias("right"))
    return per.agg(F.round(F.avg(F.col("right") / F.col("all")), 9).alias("macro_f1"), F.count("*").alias("n_labels"))


def dominant(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Each key's most frequent value, nulls left out, ties to the one first seen."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("n").desc(), "first"))
    return counted.withColumn("nth", nth).filter("nth = 1").select(*keys, value, "n")


def tiling(cells: DataFrame, tables: DataFrame, grid: str = "grid_id") -> DataFrame:
    """How often each place of a grid is covered, where that is not once: gap, overlap or out_of_bounds.

    cells: grid, row, col, row_span, col_span; tables: grid, n_rows, n_cols.
    """
    rows = F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1)
    cols = F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1)
    covered = cells.select(grid, F.explode(rows).alias("r"), "col", "col_span").select(grid, "r", F.explode(cols).alias("c"))
    covered = covered.groupBy(grid, "r", "c").agg(F.count("*").alias("n"))
    wanted = tables.select(grid, "n_cols", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("r"))
    wanted = wanted.select(grid, "r", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("c"), F.lit(True).alias("inside"))
    fault = F.when(F.col("inside").isNull(), "out_of_bounds").when(F.col("n").isNull(), "gap").when(F.col("n") > 1, "overlap")
    found = covered.join(wanted, [grid, "r", "c"], "full_outer").withColumn("fault", fault)
    return found.filter("fault is not null").select(grid, "r", "c", F.coalesce("n", F.lit(0)).alias("n"), "fault")


def overlay(primary: DataFrame, secondary: DataFrame, key: str, value: str) -> DataFrame:
    """All keys of either; a blank or missing value is filled from the secondary."""
    def set_(c: str) -> Column:
        return F.when(bare(F.col(c)) != "", F.col(c))

    both = primary.select(key, F.col(value).alias("first")).join(secondary.select(key, F.col(value).alias("second")), key, "full_outer")
    return both.select(key, F.coalesce(set_("first"), set_("second"), F.lit("")).alias(value))


def union_distinct(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of the rows with one natural key (nulls are equal) the first in the given order."""
    nth = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return rows.withColumn("nth", nth).filter("nth = 1").drop("nth")


#: How final a degree's state is, by the first word that occurs, and the levels of degrees.
DEGREE_STATES = (("졸업", 3), ("졸", 3), ("수료", 2), ("휴학", 1), ("재학", 1), ("중퇴", 0))
DEGREE_LEVELS = ("박사", "석사", "학사", "전문학사")


def consolidated_education(rows: DataFrame, person: str, order: str) -> DataFrame:
    """The rows (person, school, major, degree) with level and kept: of one person's rows of a school, major and level the most final state, the first of equal ones.

    A degree without a state counts as final. Rows without a degree of a known level, or without school and major, all stay.
    """
    bare = F.regexp_replace(F.coalesce("degree", F.lit("")), " ", "")
    level = F.coalesce(*(F.when(F.contains(bare, F.lit(x)), F.lit(x)) for x in DEGREE_LEVELS))
    rank = F.coalesce(*(F.when(F.contains(bare, F.lit(w)), F.lit(n)) for w, n in DEGREE_STATES), F.lit(3))
    loose = F.col("level").isNull() | (F.coalesce("school", "major").isNull())
    ranked = rows.withColumn("level", level).withColumn("state_rank", rank)
    nth = F.row_number().over(W.partitionBy(person, "school", "major", "level").orderBy(F.col("state_rank").desc(), order))
    return ranked.withColumn("kept", loose | (nth == 1)).drop("state_rank")


def first_edits(drafts: DataFrame, stored: DataFrame, posted: DataFrame, keys: list[str]) -> DataFrame:
    """keys, action, before and after of the answers that a person has changed for the first time.

    All three have keys and value. What is stored must still be the draft, and what is posted must differ; a blank one rejects
    the draft. Answers without a draft, and those not posted, are left out; a missing stored value is empty.
    """
    d, p = drafts.select(*keys, F.coalesce("value", F.lit("")).alias("draft")), posted.select(*keys, F.coalesce("value", F.lit("")).alias("after"))
    both = d.join(p, keys).join(stored.select(*keys, F.col("value").alias("held")), keys, "left").withColumn("before", F.coalesce("held", F.lit("")))
    changed = both.filter((F.col("before") == F.col("draft")) & (F.col("after") != F.col("before")))
    action = F.when(F.col("after").rlike(r"^[\s\p{Z}]*$"), "draft_rejected").otherwise("edited")
    return changed.select(*keys, action.alias("action"), "before", "after")


def missing_questions(questions: DataFrame, answers: DataFrame, excluded: DataFrame, required_only: bool = False) -> DataFrame:
    """The questions (question_id, kind, field_id, required) on sections and cells without an answer (question_id, value) that is not blank; excluded sections (field_id) ask nothing."""
    asked = questions.filter(F.col("kind").isin("section", "table_cell"))
    asked = asked.filter(F.coalesce("required", F.lit(False))) if required_only else asked
    held = answers.filter(~F.coalesce("value", F.lit("")).rlike(r"^[\s\p{Z}]*$")).select("question_id")
    gone = asked.filter("kind = 'section'").join(excluded.select("field_id").distinct(), "field_id", "left_semi").select("question_id")
    return asked.join(held, "question_id", "left_anti").join(gone, "question_id", "left_anti")


def fidelity(pairs: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """pair_id, a column for each metric and overall: how much of the larger of a's and b's counts the smaller is, in percent.

    pairs: pair_id, and structs a and b of counts. Two zeros agree wholly. The metric text is the mean of those of chars and
    tokens; overall is the weighted sum of the metrics in `weights`.
    """

    def ratio(c: str) -> Column:
        a, b = F.col(f"a.{c}"), F.col(f"b.{c}")
        return F.when(F.greatest(a, b) == 0, 100.0).otherwise(F.bround(F.least(a, b) / F.greatest(a, b) * 100.0, 2))

    metrics = {c: F.bround((ratio("chars") + ratio("tokens")) / 2.0, 2) if c == "text" else ratio(c) for c in weights}
    rows = pairs.select("pair_id", *(m.alias(c) for c, m in metrics.items()))
    return rows.withColumn("overall", F.bround(sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0)), 2))


def rule_status(rules: DataFrame, guards: DataFrame, domain: str) -> DataFrame:
    """rule_id and status of every rule (rule_id, domain, automated): NA outside its domain, PASS or FAIL by its guard (rule_id, passed), else UNVERIFIABLE if automated and REVIEW_REQUIRED if not."""
    rows = rules.join(guards.select("rule_id", "passed"), "rule_id", "left")
    outside = ~F.col("domain").isin("all", domain)
    status = F.when(outside, "NA").when(F.col("passed"), "PASS").when(~F.col("passed"), "FAIL").when(F.coalesce("automated", F.lit(False)), "UNVERIFIABLE").otherwise("REVIEW_REQUIRED")
    return rows.select("rule_id", status.alias("status"))


def facets(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: for each column its distinct values that are not blank, sorted."""
    return rows.agg(*(F.array_sort(F.collect_set(F.when(bare(F.col(c)) != "", F.col(c)))).alias(c) for c in columns))


def filtered(rows: DataFrame, query: str, text: Sequence[str], equal: Mapping[str, str]) -> DataFrame:
    """The rows whose text columns, joined, hold the query without regard to case, and whose other columns equal the given values; blank ones ask nothing."""
    joined = F.lower(F.concat_ws(" ", *text))
    out = rows.filter(F.contains(joined, F.lit(query.strip().lower()))) if query.strip() else rows
    for column, value in equal.items():
        out = out.filter(F.col(column) == value) if value else out
    return out


def golden(assertions: DataFrame, docs: DataFrame, found: Column) -> DataFrame:
    """assertion_id, doc_id and status of golden assertions (assertion_id, doc_id, terms and what else `found` asks for).

    FILE_MISSING without the document (doc_id, text), READ_MISS if a term is not in its text, else FOUND; without terms SKIPPED.
    `found` is an expression of text and terms.
    """
    rows = assertions.join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(True).alias("held")), "doc_id", "left")
    status = F.when(F.col("held").isNull(), "FILE_MISSING").when(F.size("terms") == 0, "SKIPPED").when(found, "FOUND").otherwise("READ_MISS")
    return rows.select("assertion_id", "doc_id", status.alias("status"))


def status_report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n, missing, read, found and found_rate (of the assertions that ask for terms in documents that are there; null without any)."""
    is_ = lambda *s: F.sum(F.col("status").isin(*s).cast("long"))
    counts = found.groupBy(key).agg(F.count("*").alias("n"), is_("FILE_MISSING").alias("missing"), is_("FOUND", "READ_MISS").alias("read"), is_("FOUND").alias("found"))
    return counts.withColumn("found_rate", F.when(F.col("read") > 0, F.bround(F.col("found") / F.col("read"), 4)))


def duplicate_ids(rows: DataFrame, key: str) -> DataFrame:
    """key and n of the ids that stand more than once, and of blank ones: what breaks a contract of unique ids."""
    counted = rows.groupBy(bare(key).alias(key)).agg(F.count("*").alias("n"))
    return counted.filter((F.col("n") > 1) | (F.col(key) == ""))


def unlisted(emitted: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """The emitted keys, each once, that are not allowed; blank ones are none."""
    return emitted.select(key).filter(bare(F.col(key)) != "").distinct().join(allowed.select(key), key, "left_anti")
