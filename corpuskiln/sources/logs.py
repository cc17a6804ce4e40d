"""JSON-lines logs and content-addressed blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_log(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """The records of a JSON-lines log, and its lines that are no JSON object, as value and file; blank lines are neither.

    Records keep the order of a file only within one task; a log that needs an order carries it in a column.
    """
    rows = spark.read.text(path).withColumn("file", F.col("_metadata.file_path")).filter(~F.col("value").rlike(r"^\s*$"))
    sound = F.col("value").rlike(r"^\s*\{") & F.try_parse_json("value").isNotNull()
    marked = rows.withColumn("sound", sound)
    return marked.filter("sound").select(F.from_json("value", schema).alias("record")).select("record.*"), marked.filter(~F.col("sound")).select("value", "file")


def append_log(rows: DataFrame, path: str) -> None:
    """Appends the rows as JSON lines."""
    rows.write.mode("append").json(path)


def blob_key(text: Column) -> Column:
    """The first 16 hex digits of the SHA-1 of a text; empty for an empty or null one."""
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(F.substring(F.sha1(text.cast("binary")), 1, 16))


def blobs(rows: DataFrame, text: str = "text") -> DataFrame:
    """digest and text of each distinct text that is not empty."""
    return rows.select(blob_key(F.col(text)).alias("digest"), F.col(text).alias("text")).filter("digest <> ''").dropDuplicates(["digest"])


def with_blobs(rows: DataFrame, store: DataFrame, refs: list[str]) -> DataFrame:
    """The rows with the text of each reference beside it; a missing blob is an empty text."""
    for ref in refs:
        rows = rows.join(store.select(F.col("digest").alias(ref), F.col("text").alias(f"{ref}_text")), ref, "left").withColumn(f"{ref}_text", F.coalesce(f"{ref}_text", F.lit("")))
    return rows
