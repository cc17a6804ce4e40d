"""Exact top-k inner products over an impact-ordered index.

Vectors are integers and lie in blocks. A block's index holds posting segments by descending impact level (the bit length of a
component's absolute value): for each dimension the vectors whose component is of that level, and those components. With each
segment goes what is left below it: the norm of every vector's components of lower levels. A search takes a block's segments
by descending impact, score at a time: for each dimension, the open queries' weights times the posted components go to the
accumulators of the posted vectors, so the work is that of the postings read. After a level, what is still missing from a candidate's
score is at most the norm of the query times that remaining norm (Cauchy-Schwarz). A query stops only when the candidates that
could still be among its best k are few; these alone are scored exactly from the stored vectors. Segments of the levels after
the last query's stop are not decoded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuskiln.llm.storage import durable

#: Vectors in a block of the index, and queries that are sought together.
BLOCK, QUERIES_AT_ONCE = 8192, 1024
#: The share of a block that may be left to exact scoring.
RESCORED = 1 / 64
#: Exact scores travel as high * 2**62 + low, and are held at this bound.
LOW_BITS, LARGEST = 62, 2**124


def quantised(vectors: DataFrame, scale: int, vec_id: str, embedding: str, *more: Column) -> DataFrame:
    """vec_id, v (array<long>, floor(scale * x) of each component) and `more` of the vectors without null or non-finite components."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("x"), F.struct(F.lit(0).alias("0"), *more).alias("more"))
    sound = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("x").isNotNull() & F.col("vec_id").isNotNull() & sound).select("vec_id", F.transform("x", lambda x: F.floor(x * scale)).alias("v"), "more.*").drop("0")


#: starts has where each dimension's postings begin among vectors (their places in the block) and values.
INDEX_SCHEMA = "block int, level int, width int, ids array<long>, rows array<long>, starts array<int>, vectors array<int>, values array<long>, below array<double>"
#: The level of the row that holds a block's vectors whole.
WHOLE = 99


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Rows of equal width; a shorter vector ends in zeros."""
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _index_block(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["vec_id", "row"])
    block, v = int(rows.block.iloc[0]), _matrix(rows.v)
    # The absolute values are taken as floats: that of the least long has no long.
    sizes = np.abs(v.astype(float))
    levels = np.where(v != 0, np.frexp(sizes)[1], -1)
    empty = np.zeros(0, np.int64)
    out = [(block, WHOLE, v.shape[1], rows.vec_id.to_numpy(), rows.row.to_numpy(), empty, empty, v.ravel(), np.sqrt((sizes**2).sum(1)))]
    for level in np.unique(levels[levels >= 0])[::-1]:
        dims, at = np.nonzero((levels == level).T)
        starts = np.searchsorted(dims, np.arange(v.shape[1] + 1))
        below = np.sqrt(np.where(levels < level, sizes**2, 0).sum(1))
        out.append((block, int(level), v.shape[1], empty, empty, starts, at, v[at, dims], below))
    return pd.DataFrame(out, columns=["block", "level", "width", "ids", "rows", "starts", "vectors", "values", "below"])


def build_index(vectors: DataFrame, blocks: int) -> DataFrame:
    """The posting segments of the vectors (row, vec_id, v), written to the shared folder: a row for each block and level, and one with the block's vectors whole."""
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    return durable(dealt.groupBy("block").applyInPandas(_index_block, INDEX_SCHEMA), "impacts")


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> list[int]:
    """Inner products of integer vectors with an integer query, exact whatever their size."""
    bound = float(np.abs(vectors.astype(float)).max(initial=0)) * float(np.abs(query.astype(float)).sum())
    if bound < 2**62:
        return (vectors @ query).tolist()
    return (vectors.astype(object) @ query.astype(object)).tolist()


def best(whole: pd.Series, segments: Iterator[pd.Series], query_rows: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query row, vec id, score) of each query's k best in one block, ties to the smaller id, the query's own row left out.

    A segment is taken from `segments` only while a query is open.
    """
    ids, rows, n, width = np.asarray(whole.ids), np.asarray(whole["rows"]), len(whole.ids), int(whole.width)
    stored = np.asarray(whole["values"], np.int64).reshape(n, width)
    # A component beyond either width meets zeros.
    shared = min(width, queries.shape[1])
    weights = np.zeros((len(queries), width))
    weights[:, :shared] = queries[:, :shared]
    norms = np.sqrt((queries.astype(float) ** 2).sum(1))
    full = np.asarray(whole.below, float)
    # Sums of floats are off by so much at most.
    rounding = (width + 8) * 2.0**-52
    own = query_rows[:, None] == rows[None, :]
    # A row for each vector, so that a posting touches what lies together.
    sums, below = np.zeros((n, len(queries))), full
    open_, out = np.arange(len(queries)), []
    while len(open_):
        slack = norms[open_, None] * (below * (1 + 1e-12) + full * rounding)[None, :]
        scores = sums[:, open_].T
        low = np.where(own[open_], -np.inf, scores - slack)
        kth = np.partition(low, n - k, axis=1)[:, n - k] if n > k else np.full(len(open_), -np.inf)
        able = (scores + slack >= kth[:, None]) & ~own[open_]
        last = not below.any()
        done = (able.sum(1) <= max(4 * k, RESCORED * n)) | last
        for i in np.flatnonzero(done):
            members = np.flatnonzero(able[i])
            totals = exact_scores(stored[members, :shared], queries[open_[i], :shared])
            found = sorted(zip(totals, ids[members].tolist(), strict=True), key=lambda x: (-x[0], x[1]))[:k]
            out += [(int(query_rows[open_[i]]), vec, total) for total, vec in found]
        open_ = open_[~done]
        if len(open_):
            segment = next(segments)
            starts, posted, values = np.asarray(segment.starts), np.asarray(segment.vectors), np.asarray(segment["values"], float)
            asked, all_open = weights[open_], len(open_) == len(queries)
            for d in np.flatnonzero((np.diff(starts) > 0) & asked.any(0)):
                at = posted[starts[d] : starts[d + 1]]
                added = np.outer(values[starts[d] : starts[d + 1]], asked[:, d])
                # A vector stands once in a dimension's postings.
                if all_open:
                    sums[at] += added
                else:
                    sums[np.ix_(at, open_)] += added
            below = np.asarray(segment.below, float)
    return out


def _search(k: int):
    def run(key: tuple, index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(index) and len(queries):
            index = index.sort_values("level", ascending=False, kind="stable")
            whole, held = index.iloc[0], index.iloc[1:]
            weights, rows = _matrix(queries.v), queries.row.to_numpy()
            for at in range(0, len(weights), 128):
                segments = (held.iloc[i] for i in range(len(held)))
                found += best(whole, segments, rows[at : at + 128], weights[at : at + 128], k)
        scores = [max(-LARGEST, min(s, LARGEST)) for _, _, s in found]
        return pd.DataFrame(
            {
                "query": [q for q, _, _ in found],
                "vec_id": [v for _, v, _ in found],
                "high": [s >> LOW_BITS for s in scores],
                "low": [s & (2**LOW_BITS - 1) for s in scores],
            },
            dtype=np.int64,
        )

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k best of all other vectors for each vector whose id is divisible by `every`.

    Components become floor(scale * x), x as double, held at the ends of a long; the score is their integer inner product and is
    compared exactly up to 2**124; where it is beyond a long the score returned is the end of the long. Ties go to the
    smaller vec_id. Vectors or ids that are null, and vectors with null or non-finite components, take no part; shorter vectors
    end in zeros. Rows that repeat a vec_id are queries and candidates of their own: each leaves out only itself. Other columns
    are ignored; an empty table gives no rows.
    Blocks of queries meet blocks of the index; each such meeting is a task's work, and hands on k rows for each query.
    """
    sound = durable(quantised(vectors, scale, vec_id, embedding).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n = sound.count()
    asked = sound.filter(F.col("vec_id") % every == 0)
    blocks = max(1, math.ceil(n / BLOCK))
    rounds = max(1, math.ceil(asked.count() / QUERIES_AT_ONCE))
    index = build_index(sound, blocks).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    queries = asked.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(rounds)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = index.groupBy("block", "part").cogroup(queries.groupBy("block", "part")).applyInPandas(_search(k), "query long, vec_id long, high long, low long")
    order = W.partitionBy("query").orderBy(F.col("high").desc(), F.col("low").desc(), "vec_id")
    first = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    score = F.when(F.col("high") > 1, F.lit(2**63 - 1)).when(F.col("high") < -2, F.lit(-(2**63))).otherwise(F.shiftleft("high", LOW_BITS).bitwiseOR(F.col("low")))
    named = first.join(asked.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id")), "query")
    return named.select("query_id", "rank", "vec_id", score.alias("score"))
