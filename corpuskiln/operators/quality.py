"""Scores of runs: axes, averages, the ratchet against a baseline, plateaus and growth."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuskiln.functions.text import bare

EPS = 1e-9


def axis_sums(items: DataFrame, axes: Mapping[str, Sequence[str]], doc: str = "doc") -> DataFrame:
    """doc, total and a column for each axis: the sums of its items' scores, to one place.

    items: doc, item, score. An item of no axis fails the query, so that a new one is not left out unseen.
    """
    known = [i for own in axes.values() for i in own]
    checked = F.when(F.col("item").isin(known), F.col("score")).otherwise(F.raise_error(F.concat(F.lit("item of no axis: "), F.coalesce("item", F.lit("null")))).cast("double"))
    rows = items.withColumn("score", checked)
    sums = [F.bround(F.coalesce(F.sum(F.when(F.col("item").isin(list(own)), F.col("score"))), F.lit(0.0)), 1).alias(axis) for axis, own in axes.items()]
    return rows.groupBy(doc).agg(F.bround(F.sum("score"), 1).alias("total"), *sums)


def run_summary(docs: DataFrame, axes: Sequence[str], run: str = "run", doc: str = "doc") -> DataFrame:
    """run, n_docs, doc_set (sorted) and the averages of total and axes, to two places, of each run; rows without a document give an empty set and null averages."""
    averages = [F.bround(F.avg(c), 2).alias(f"avg_{c}") for c in ("total", *axes)]
    return docs.groupBy(run).agg(F.count(doc).alias("n_docs"), F.array_sort(F.collect_list(doc)).alias("doc_set"), *averages)


def ratchet(summary: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """key, status, passed and failures of each current summary against its baseline.

    Both have n_docs, doc_set, avg_total, tests_passed and tests_failed (null where the tests were not run). Without a baseline
    the status is SEED. Failures: failed tests, fewer passed tests, and for the same set of documents a lower average; then
    FAIL. Else RESET where the set has changed, IMPROVED where tests or average have risen, OK otherwise.
    """
    was = baseline.select(key, *(F.col(c).alias(f"b_{c}") for c in ("doc_set", "avg_total", "tests_passed")), F.lit(True).alias("known"))
    rows = summary.join(was, key, "left")
    some, had = F.col("n_docs") > 0, F.coalesce(F.size("b_doc_set") > 0, F.lit(False))
    same = some & had & (F.col("doc_set") == F.col("b_doc_set"))
    failures = F.array_compact(
        F.array(
            F.when(F.col("tests_failed") > 0, "tests_failed"),
            F.when(F.col("tests_passed") < F.col("b_tests_passed"), "tests_passed"),
            F.when(same & (F.col("avg_total") < F.col("b_avg_total") - EPS), "avg_total"),
        )
    )
    more_tests = F.col("tests_passed").isNotNull() & (F.col("b_tests_passed").isNull() | (F.col("tests_passed") > F.col("b_tests_passed")))
    better = F.coalesce(same & (F.col("avg_total") > F.col("b_avg_total") + EPS), F.lit(False)) | (some & F.col("b_avg_total").isNull())
    seeded = F.col("known").isNull()
    failed = F.when(seeded, F.array().cast("array<string>")).otherwise(failures)
    status = F.when(seeded, "SEED").when(F.size(failed) > 0, "FAIL").when(some & had & ~same, "RESET").when(more_tests | better, "IMPROVED").otherwise("OK")
    return rows.select(key, status.alias("status"), (F.size(failed) == 0).alias("passed"), failed.alias("failures"))


def next_baseline(summary: DataFrame, baseline: DataFrame, gate: DataFrame, key: str) -> DataFrame:
    """The baseline after the gate: the old one where it failed; else the current values, the old ones where an axis was not run."""
    columns = ("n_docs", "doc_set", "avg_total", "tests_passed", "tests_failed")
    old = baseline.select(key, *(F.col(c).alias(f"b_{c}") for c in columns))
    now = summary.join(gate.select(key, "passed"), key).join(old, key, "left")

    def kept(c: str) -> Column:
        run = F.col("n_docs") > 0 if c in columns[:3] else F.col("tests_passed").isNotNull()
        return F.when(F.col("passed") & run, F.col(c)).otherwise(F.col(f"b_{c}")).alias(c)

    return now.select(key, *map(kept, columns))


def plateaus(runs: DataFrame, key: str, order: str, total: str, least: float = 2.0) -> DataFrame:
    """The runs with their gain over the one before (null for the first) and whether that is a plateau: a gain below `least`."""
    gain = F.col(total) - F.lag(total).over(W.partitionBy(key).orderBy(order))
    return runs.withColumn("gain", gain).withColumn("plateau", F.coalesce(F.col("gain") < least, F.lit(False)))


def first_drop(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, at, was and now of the first row of each key whose value is below the one before; keys that only grow have none."""
    before = F.lag(value).over(W.partitionBy(key).orderBy(order))
    drops = rows.withColumn("was", before).filter(F.col(value) < F.col("was"))
    return drops.groupBy(key).agg(F.min(F.struct(F.col(order).alias("at"), "was", F.col(value).alias("now"))).alias("x")).select(key, "x.*")


def lowest_pass(passes: DataFrame, key: str, total: str, order: str) -> DataFrame:
    """The row of the lowest total of each key, the first of equal ones."""
    nth = F.row_number().over(W.partitionBy(key).orderBy(total, order))
    return passes.withColumn("nth", nth).filter("nth = 1").drop("nth")


def evaluation(scores: DataFrame, key: str = "run", weak: float = 0.6) -> DataFrame:
    """key, total, most, ratio and weak_sections of scored criteria (score, max_score, section, seq): sections below `weak` of their maximum, each once, in order."""
    low = F.col("score") < F.col("max_score") * weak
    sections = F.transform(F.array_sort(F.collect_list(F.when(low & F.col("section").isNotNull(), F.struct("seq", "section")))), lambda x: x["section"])
    found = scores.groupBy(key).agg(F.sum("score").alias("total"), F.sum("max_score").alias("most"), F.array_distinct(sections).alias("weak_sections"))
    return found.select(key, "total", "most", F.when(F.col("most") > 0, F.bround(F.col("total") / F.col("most"), 4)).otherwise(0.0).alias("ratio"), "weak_sections")


def criterion_scores(said: DataFrame, criteria: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, name, score and max_score of what a judge said (key, name, score) about criteria (key, name, max_score, seq).

    A name is that of a criterion, else of the first one that it holds or that holds it; else it is left out. Scores are held
    between 0 and the maximum. Criteria whose own name was not said get half of theirs, rounded down.
    """
    c = criteria.select(key, F.col("name").alias("criterion"), "max_score", "seq")
    named = said.select(key, bare(F.col("name")).alias("name"), "score")
    near = (F.col("name") == F.col("criterion")) | F.contains("name", F.col("criterion")) | F.contains("criterion", F.col("name"))
    # The criteria of a call for proposals are few, so a document's names meet them all.
    met = named.join(c, key).filter(near)
    best = F.row_number().over(W.partitionBy(key, "name", "score").orderBy((F.col("name") != F.col("criterion")).cast("int"), "seq"))
    held = met.withColumn("nth", best).filter("nth = 1").select(key, "name", F.greatest(F.lit(0), F.least("score", "max_score")).cast("int").alias("score"), "max_score")
    unsaid = c.join(held.select(key, F.col("name").alias("criterion")).distinct(), [key, "criterion"], "left_anti")
    return held.unionByName(unsaid.select(key, F.col("criterion").alias("name"), F.floor(F.col("max_score") * 0.5).cast("int").alias("score"), "max_score"))
