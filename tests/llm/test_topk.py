"""Top-k against all scores."""

from __future__ import annotations

import math

import numpy as np

from corpuskiln.llm import registry, topk


def brute(rows, k=5, every=50):
    sound = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v in sound), default=0)
    m = np.array([v + [0] * (width - len(v)) for _, v in sound], dtype=np.int64).reshape(len(sound), width)
    ids = np.array([i for i, _ in sound])
    out = []
    for q in sorted({i for i in ids.tolist() if i % every == 0}):
        scores = m @ m[ids.tolist().index(q)]
        best = sorted((-int(s), int(i)) for s, i in zip(scores, ids) if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, registry.op3_topk(spark, sf).collect())) == brute(rows)


def test_many_blocks_equal_one(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 60)
    monkeypatch.setattr(topk, "QUERIES_AT_ONCE", 3)
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, topk.top_k(spark.read.parquet(f"{sf}/embeddings.parquet")).collect())) == brute(rows)


def test_ties_nulls_and_short_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [9.0, 9.0]), (50, [1.0]), (100, []), (7, [-3.0, 0.5]), (8, [0.001, -0.001])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS block", "2 AS part", "3 AS v")
    assert sorted(map(tuple, topk.top_k(df).collect())) == brute(rows)
    assert topk.top_k(df.limit(0)).count() == 0


def test_repeated_ids_are_queries_and_candidates_of_their_own(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [5.0]), (1, [2.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    expected = [(0, 1, 0, 327680), (0, 1, 1, 655360), (0, 2, 1, 131072), (0, 2, 1, 655360), (0, 3, 0, 327680), (0, 3, 1, 131072)]
    assert sorted(map(tuple, topk.top_k(df).collect())) == expected


def test_scores_beyond_exact_floats_and_beyond_longs(spark):
    near = [(0, [1e7, 1 / 256]), (50, [1e7, 0.0]), (1, [1e7, 1 / 256]), (2, [1e7, 0.0])]
    rows = topk.top_k(spark.createDataFrame(near, "vec_id long, embedding array<double>")).collect()
    big = (256 * 10**7) ** 2
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in rows}
    assert found[0, 1] == (1, big + 1) and found[0, 2] == (2, big) and found[50, 1] == (0, big)
    huge = [(0, [1e8, 1.0]), (1, [1e8, 0.0]), (2, [1e8, 1.0]), (3, [-1e8, 0.0]), (4, [1e300, 1.0]), (5, [-1e300, 1.0])]
    rows = topk.top_k(spark.createDataFrame(huge, "vec_id long, embedding array<double>")).collect()
    assert [(r.vec_id, r.score) for r in sorted(rows, key=lambda r: r["rank"])] == [(4, 2**63 - 1), (2, 2**63 - 1), (1, 2**63 - 1), (3, -(2**63)), (5, -(2**63))]


def test_a_table_of_nulls_and_columns_of_any_name(spark):
    df = spark.createDataFrame([(None, None), (0, None), (50, [None])], "vec_id long, embedding array<double>")
    assert topk.top_k(df).count() == 0
    odd = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>").selectExpr("*", "1 AS `a.b`", "2 AS `my col`", "3 AS query", "4 AS row")
    assert [tuple(r) for r in topk.top_k(odd).collect()] == [(0, 1, 1, 131072)]


def test_segments_after_the_proof_are_not_taken():
    import pandas as pd

    rng = np.random.default_rng(2)
    v = rng.integers(-255, 256, (3000, 16))
    v[:4] = 4000
    rows = pd.DataFrame({"block": 0, "vec_id": range(3000), "row": range(3000), "v": list(v)})
    index = topk._index_block(rows).sort_values("level", ascending=False)
    taken = []

    def segments():
        for i in range(1, len(index)):
            taken.append(i)
            yield index.iloc[i]

    found = topk.best(index.iloc[0], segments(), np.array([0]), v[:1], 3)
    assert [x[1] for x in found] == [1, 2, 3] and len(taken) < len(index) - 1
