"""Streams over defect logs: an append-only table for batch recurrence, and windowed counts with late data bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_distinct(stream: DataFrame, key: str, time: str, table: str, checkpoint: str, late: str = "1 hour") -> StreamingQuery:
    """Starts appending the stream's rows to a Parquet table, each key once within the bound on late data."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(table)


def hourly_counts(stream: DataFrame, check: str, time: str, late: str = "1 hour") -> DataFrame:
    """check, hour and n of the stream's rows by hour of event time."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return rows.groupBy(F.col(check), F.window(time, "1 hour").alias("w")).agg(F.count("*").alias("n")).select(check, F.col("w.start").alias("hour"), "n")
