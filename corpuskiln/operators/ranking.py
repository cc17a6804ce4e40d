"""Ranking of files, sources and results; ties always go by the last columns of an order, so that every rank is defined."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuskiln.functions.parsing import name_date

#: Words of file names that speak for and against a source.
RESUME, PENALTIES, PREFERRED = "이력서", ("신청서", "동의서", "추천서"), ("공고문", "모집")


def _stem(name: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"(?<=.)\.[^.]*$", "")


def _hits(text: Column, words: Sequence[str]) -> Column:
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def ranked_sources(files: DataFrame, keywords: Sequence[str], prefer_resume: bool = False, dry_run: Column | None = None, target: str = "target") -> DataFrame:
    """The files of each target with keyword_hits, resume_bonus, filename_date, penalty and rank.

    files: target, path, mtime. The order is that of dry_run (a column; 0 without one: the two known rankings differ only in
    it), resume bonus, date in the name, keywords, fewer penalties and mtime, each greatest first, then path.
    """
    stem = _stem(F.col("path"))
    zero = F.lit(0)
    rows = files.withColumns(
        {
            "dry_run": zero if dry_run is None else dry_run,
            "keyword_hits": _hits(F.lower(stem), [k.lower() for k in keywords]),
            "resume_bonus": F.when(F.contains(stem, F.lit(RESUME)), 3).otherwise(0) if prefer_resume else zero,
            "filename_date": F.coalesce(name_date(stem), zero) if prefer_resume else zero,
            "penalty": _hits(stem, PENALTIES) if prefer_resume else zero,
        }
    )
    order = [F.col(c).desc() for c in ("dry_run", "resume_bonus", "filename_date", "keyword_hits")] + [F.col("penalty"), F.col("mtime").desc(), F.col("path")]
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(target).orderBy(*order)))


def picked_sources(ranked: DataFrame, least_keywords: int = 0, target: str = "target") -> DataFrame:
    """The best source of each target with at least `least_keywords` hits; where none has, the best of all."""
    fit = (F.col("keyword_hits") >= least_keywords).cast("int")
    nth = F.row_number().over(W.partitionBy(target).orderBy(fit.desc(), "rank"))
    return ranked.withColumn("nth", nth).filter("nth = 1").drop("nth")


def best_announcement(files: DataFrame, keywords: Sequence[str], folder: str = "folder") -> DataFrame:
    """folder and path of the announcement: a preferred name, then most keywords, then latest, then the smaller path."""
    name = F.lower(_stem(F.col("path")))
    order = [F.greatest(*(F.contains(name, F.lit(w)) for w in PREFERRED)).desc(), _hits(name, keywords).desc(), F.col("mtime").desc(), F.col("path")]
    return files.withColumn("nth", F.row_number().over(W.partitionBy(folder).orderBy(*order))).filter("nth = 1").select(folder, "path")


def one_per_stem(files: DataFrame, path: str = "path") -> DataFrame:
    """Of files with one stem (without regard to case) one: .docx first, then .txt, then by name."""
    stem, lower = F.trim(F.lower(_stem(F.col(path)))), F.lower(F.col(path))
    order = [(~lower.endswith(".docx")).cast("int"), (~lower.endswith(".txt")).cast("int"), lower, F.col(path)]
    return files.withColumn("stem", stem).withColumn("nth", F.row_number().over(W.partitionBy("stem").orderBy(*order))).filter("nth = 1").drop("nth")


def preferred_results(results: DataFrame, domains: Sequence[str], most: int = 5, topic: str = "topic") -> DataFrame:
    """The first `most` results of each topic: those whose host ends in a preferred domain first, each lot in its order (seq)."""
    host = F.lower(F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    preferred = F.greatest(F.lit(False), F.lit(False), *(host.endswith(d) for d in domains))
    rows = results.withColumn("preferred", preferred)
    order = W.partitionBy(topic).orderBy(F.col("preferred").desc(), "seq")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def required_first(items: DataFrame, key: str, most: int = 30) -> DataFrame:
    """The first `most` items of each form, required ones first, each lot in its order (seq)."""
    order = W.partitionBy(key).orderBy(F.coalesce("required", F.lit(False)).desc(), "seq")
    return items.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def severity_first(found: DataFrame, key: str) -> DataFrame:
    """Open items (defects > 0) of each document with their rank: failing checks first, each lot in its order (seq)."""
    order = W.partitionBy(key).orderBy((F.col("severity") != "fail").cast("int"), "seq")
    return found.filter("defects > 0").withColumn("rank", F.row_number().over(order))


def samples(rows: DataFrame, keys: list[str], value: str, order: list[str], most: int = 5) -> DataFrame:
    """keys, n and the first `most` values of each; only those are kept on the way."""
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    counted = rows.withColumn("nth", nth)
    held = F.collect_list(F.when(F.col("nth") <= most, F.struct("nth", value)))
    return counted.groupBy(*keys).agg(F.count("*").alias("n"), F.transform(F.array_sort(held), lambda x: x[value]).alias("samples"))
