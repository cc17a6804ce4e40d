"""Shards of a fixed capacity."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskiln.llm import sharding


def test_shards_of_a_fixed_capacity_are_few(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0]
    capacity = total // 7
    rows = sharding.shard(docs, capacity=capacity)
    used = [r.n for r in rows.groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert rows.count() == docs.count() and sum(used) == total
    assert max(used) <= capacity and 8 <= len(used) <= 9


def test_tables_written_since_a_mark_are_dropped_but_one(spark):
    from corpuskiln.llm import storage

    before = storage.durable(spark.range(3), "before")
    point = storage.mark()
    gone, kept = storage.durable(spark.range(4), "gone"), storage.durable(spark.range(5), "kept")
    storage.drop_since(spark, point, storage.last())
    assert before.count() == 3 and kept.count() == 5 and storage.mark() == point + 1
    path = spark._jvm.org.apache.hadoop.fs.Path(gone.inputFiles()[0] if gone.inputFiles() else "/none")
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
