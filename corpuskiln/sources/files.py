"""Files as tables: decoded texts, pools of sources, folders of notices, libraries of images, tracked files, and logs by name."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpuskiln.functions.predicates import protected_path

#: Encodings that are tried in turn, suffixes of forms, and what tells an announcement from a form.
ENCODINGS = ("utf-8", "cp949", "euc-kr")
POOL_SUFFIXES = (".docx", ".hwp", ".hwpx")
LOGS = ("runs", "defects", "candidates", "traces", "feedback")


@F.pandas_udf(StringType())
def _decoded(content: pd.Series) -> pd.Series:
    def text(data: bytes | None) -> str | None:
        for encoding in ENCODINGS if data is not None else ():
            try:
                return data.decode(encoding)
            except UnicodeDecodeError:
                continue
        return None if data is None else data.decode(errors="replace")

    return content.map(text)


def decoded(content: Column) -> Column:
    """The text of bytes: in the first of the encodings that they are sound in, else UTF-8 with replacements; null stays null."""
    return _decoded(content)


def files(spark: SparkSession, path: str, recursive: bool = True, suffixes: Sequence[str] = ()) -> DataFrame:
    """path, modificationTime, length and content of each file under `path` with one of the suffixes (all without any); empty files have no row, and a missing folder fails."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    lower = F.lower("path")
    return rows.filter(F.greatest(F.lit(False), F.lit(False), *(lower.endswith(s) for s in suffixes))) if suffixes else rows


def texts(spark: SparkSession, path: str, suffixes: Sequence[str] = (".txt", ".md"), largest: int | None = None) -> DataFrame:
    """path and text of the files, in whatever of the encodings; with `largest`, bigger files are left out before they are read."""
    rows = files(spark, path, True, suffixes)
    rows = rows if largest is None else rows.filter(F.col("length") <= largest)
    return rows.select("path", decoded(F.col("content")).alias("text"))


def source_pool(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path and mtime of the forms under `path`, each once, without their contents."""
    return files(spark, path, recursive, POOL_SUFFIXES).select("path", F.col("modificationTime").alias("mtime")).dropDuplicates(["path"])


def notice_kind(path: Column, announcements: Sequence[str], skipped: Sequence[str]) -> Column:
    """announcement, form or other, by a file's name: hidden and unknown files are null and other."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    holds = lambda words: F.greatest(F.lit(False), F.lit(False), *(F.contains(stem, F.lit(w.lower())) for w in words))
    known = name.rlike(r"\.(docx|hwp|hwpx|pdf|txt)$")
    return F.when(name.startswith("."), None).when(~known, "other").when(holds(announcements), "announcement").when(holds(skipped), "other").otherwise("form")


def image_library(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256, length and hint (the name of the folder) of each image under `path`."""
    rows = files(spark, path, True, (".png", ".jpg", ".jpeg", ".webp", ".bmp", ".gif"))
    return rows.select("path", F.sha2("content", 256).alias("sha256"), "length", F.element_at(F.split("path", "/"), -2).alias("hint"))


def tracked_texts(spark: SparkSession, path: str, suffixes: Sequence[str], largest: int = 2 << 20) -> DataFrame:
    """path, text and protected (the rule that protects the path, or null) of the tracked text files up to `largest` bytes."""
    return texts(spark, path, suffixes, largest).withColumn("protected", protected_path(F.col("path")))


def profiles(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The JSON documents of the files under `path`, one each, with their path, sorted by it."""
    rows = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), "*").orderBy("path")


def named_log(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """The sound records of one of the logs that are known by name."""
    from corpuskiln.sources.logs import read_log

    if name not in LOGS:
        raise ValueError(f"no log {name}")
    return read_log(spark, f"{root}/{name}.jsonl", schema)[0]


def append_trend(rows: DataFrame, path: str) -> None:
    """Appends the rows to a CSV trend with a header in each file."""
    rows.write.mode("append").option("header", "true").csv(path)


def receipt_key(*inputs: Column) -> Column:
    """The key of a stage's receipt: the SHA-256 of its inputs as JSON, so that a stage whose inputs did not change is known."""
    return F.sha2(F.to_json(F.array(*(F.coalesce(i.cast("string"), F.lit("")) for i in inputs))), 256)


def without_receipt(stages: DataFrame, receipts: DataFrame) -> DataFrame:
    """The stages (stage, key) that no receipt (stage, key) shows as done."""
    return stages.join(receipts.select("stage", "key").distinct(), ["stage", "key"], "left_anti")
