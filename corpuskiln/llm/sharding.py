"""Shards of near equal size by best-fit-decreasing bin packing of indivisible groups.

Groups of equal texts are packed as runs: how many groups there are of each size. There are at most sqrt(2 * bytes) sizes, and
far fewer in practice, so what one process packs is bounded though every group is packed by best fit. Of a run, best fit puts
group after group into one bin until it is too full for another, so a run takes a few steps. Each group then finds its shard
by its size and its rank among the groups of that size, which Spark counts in chunks.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuskiln.llm.storage import durable

#: Groups of one size that are ranked in one task.
CHUNK = 20_000
#: Rows of one text from which on its shard is broadcast instead of joined, so that no text has many rows in the join.
MANY = 10_000


class RemainingCapacities:
    """Open bins in a balanced tree (a treap) ordered by (remaining capacity, bin)."""

    def __init__(self) -> None:
        self._root = None

    @staticmethod
    def _rank(key: tuple[int, int]) -> int:
        return hash((key[1] * 2654435761 + 97, key[0]))

    def add(self, key: tuple[int, int]) -> None:
        left, right = self._split(self._root, key)
        self._root = self._join(self._join(left, [key, self._rank(key), None, None]), right)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the least key with a capacity of at least `size`."""
        left, right = self._split(self._root, (size, -1))
        if right is None:
            self._root = left
            return None
        node, parent = right, None
        while node[2] is not None:
            node, parent = node[2], node
        if parent is None:
            right = node[3]
        else:
            parent[2] = node[3]
        self._root = self._join(left, right)
        return node[0]

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            left, right = self._split(node[3], key)
            return [node[0], node[1], node[2], left], right
        left, right = self._split(node[2], key)
        return left, [node[0], node[1], right, node[3]]

    def _join(self, left, right):
        if left is None or right is None:
            return left or right
        if left[1] > right[1]:
            return [left[0], left[1], left[2], self._join(left[3], right)]
        return [right[0], right[1], self._join(left, right[2]), right[3]]


def best_fit_runs(runs: list[tuple[int, int]], capacity: int, bins: int | None = None) -> list[list[tuple[int, int]]] | None:
    """For each run (size, number) of descending sizes, the bins (bin, number) that its items go to, in order. None if more than `bins` bins are needed.

    Each item goes to the open bin of the least capacity left that holds it, so a run fills one bin before it takes the next.
    An item larger than the capacity gets a bin of its own.
    """
    tree, used, out = RemainingCapacities(), 0, []
    for size, left in runs:
        own: list[tuple[int, int]] = []
        while left:
            key = tree.take_tightest(size)
            if key is None:
                if used == bins:
                    return None
                key, used = (max(capacity, size), used), used + 1
            n = min(left, key[0] // size) if size else left
            own.append((key[1], n))
            tree.add((key[0] - n * size, key[1]))
            left -= n
        out.append(own)
    return out


def best_fit_decreasing(sizes: list[int], capacity: int, bins: int | None = None) -> list[int] | None:
    """The bin of each item; `sizes` must be descending. None if more than `bins` bins are needed."""
    found = best_fit_runs([(size, len(list(same))) for size, same in groupby(sizes)], capacity, bins)
    return None if found is None else [b for own in found for b, n in own for _ in range(n)]


def pack_evenly(runs: list[tuple[int, int]], bins: int) -> list[list[tuple[int, int]]]:
    """The bins of each run of descending sizes, at about the least capacity for which best-fit-decreasing needs no more than `bins`.

    Sizes above an even share of what is left get a bin of their own first.
    """
    total = sum(size * n for size, n in runs)
    own: list[list[tuple[int, int]]] = []
    while runs and bins > 1 and runs[0][0] * bins > total:
        size, n = runs[0]
        own.append([(bins - 1, 1)])
        runs = ([(size, n - 1)] if n > 1 else []) + runs[1:]
        total, bins = total - size, bins - 1
    if not runs:
        return own
    low = max(-(-total // bins), runs[0][0])
    step, high = max(1, low // 1_000_000), low
    while (found := best_fit_runs(runs, high, bins)) is None:
        low, high, step = high + 1, high + step, 2 * step
    while high - low > high // 1_000_000:
        middle = (low + high) // 2
        if (better := best_fit_runs(runs, middle, bins)) is None:
            low = middle + 1
        else:
            found, high = better, middle
    return own + found


def group_key(text: Column) -> Column:
    """What equal texts share; null texts are a group of their own."""
    return F.unhex(F.coalesce(F.md5(text), F.lit("00")))


def _ranked(groups: DataFrame, runs: DataFrame) -> DataFrame:
    """`groups` with a column rank that counts from 0 among those of one size; a size's groups are ranked in chunks of about CHUNK."""
    dealt = groups.join(runs.filter(F.col("n") > CHUNK).select("bytes", F.ceil(F.col("n") / CHUNK).alias("chunks")), "bytes", "left")
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("group_key"), F.coalesce("chunks", F.lit(1)))).drop("chunks")
    before = W.partitionBy("bytes").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    counts = dealt.filter("chunk > 0").select("bytes").distinct().join(dealt, "bytes").groupBy("bytes", "chunk").agg(F.count("*").alias("n"))
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = F.row_number().over(W.partitionBy("bytes", "chunk").orderBy("group_key")) - 1
    ranked = dealt.withColumn("within", within).join(offsets, ["bytes", "chunk"], "left")
    return ranked.select("group_key", "rows", "bytes", (F.col("within") + F.coalesce("before", F.lit(0))).cast("long").alias("rank"))


def assign(rows: DataFrame, shards: int, capacity: int | None = None) -> DataFrame:
    """`rows` (with columns group_key and size) with a column shard: `shards` even ones, or as few of a fixed capacity as best fit finds."""
    spark = rows.sparkSession
    rows = durable(rows, "sized")
    groups = durable(rows.groupBy("group_key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "groups")
    runs = durable(groups.groupBy("bytes").agg(F.count("*").alias("n")), "runs")
    table = runs.orderBy(F.col("bytes").desc()).toArrow()
    sizes = list(zip(table.column("bytes").to_pylist(), table.column("n").to_pylist(), strict=True))
    packed = pack_evenly(sizes, shards) if capacity is None else best_fit_runs(sizes, capacity)
    # A run that pack_evenly has split stands there in several parts; sizes repeat in the order of the parts.
    flat, at, taken = [], 0, 0
    for own in packed:
        for shard, n in own:
            if taken == sizes[at][1]:
                at, taken = at + 1, 0
            flat.append((sizes[at][0], taken, taken + n, shard))
            taken += n
    names = ["bytes", "first", "end", "shard"]
    parts = spark.createDataFrame(pd.DataFrame(np.array(flat, np.int64).reshape(-1, 4), columns=names), "bytes long, first long, end long, shard long").withColumn("shard", F.col("shard").cast("int"))
    few = len(flat) <= 1_000_000
    by_size = parts.groupBy("bytes").agg(F.array_sort(F.collect_list(F.struct("first", "end", "shard"))).alias("parts"))
    held = _ranked(groups, runs).join(F.broadcast(by_size) if few else by_size, "bytes")
    shard = F.filter("parts", lambda p: (p["first"] <= F.col("rank")) & (F.col("rank") < p["end"]))[0]["shard"]
    held = durable(held.select("group_key", "rows", shard.alias("shard")), "shards")
    many = held.filter(F.col("rows") >= MANY).select("group_key", F.col("shard").alias("shard of many"))
    apart = rows.join(F.broadcast(many) if many.count() <= 100_000 else many, "group_key", "left")
    joined = apart.filter(F.col("shard of many").isNull()).drop("shard of many").join(held.filter(F.col("rows") < MANY).select("group_key", "shard"), "group_key")
    return apart.filter(F.col("shard of many").isNotNull()).withColumnRenamed("shard of many", "shard").unionByName(joined)


def with_slots(rows: DataFrame, order: list[str], share: int = 20_000) -> DataFrame:
    """`rows` with a column slot that counts from 0 within each shard.

    The rows of a shard are dealt by hash into chunks of about `share`; chunks are numbered on their own, and the sums of the
    chunks before (a few numbers for each `share` rows) are added.
    """
    rows = durable(rows, "placed")
    chunks = max(1, rows.count() // (share * max(1, rows.select("shard").distinct().count())))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)).cast("int"))
    before = W.partitionBy("shard").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "chunk").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = F.row_number().over(W.partitionBy("shard", "chunk").orderBy(*order)) - 1
    return rows.withColumn("slot", within).join(offsets, ["shard", "chunk"]).withColumn("slot", (F.col("slot") + F.col("before")).cast("long")).drop("chunk", "before")


def shard(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text", capacity: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of `docs`.

    size: UTF-8 bytes of the text plus 16; the law is `bytes`: sums of sizes are near equal, as far as the largest group of
    equal texts allows. Null texts count 16, have the checksum of an empty text and form one group. Repeated rows each get
    a slot; other columns are ignored. With a capacity, shards hold at most so many bytes, a larger group of equal texts
    alone has a shard of its own, and their number, which best fit keeps low, replaces `shards`.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        group_key(F.col(text)).alias("group_key"),
    )
    placed = with_slots(assign(rows, shards, capacity).select("doc_id", "size", "text_crc32", "shard"), ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
