"""Hard negatives against all scores."""

from __future__ import annotations

import math
import random

import numpy as np

from corpuskiln.llm import hard_negatives
from corpuskiln.llm.hard_negatives import Side, Wanted, dual_search, interval, plant

LEAST, MOST = -(2**63), 2**63 - 1


def brute(rows, positives=5, negatives=10, low=30, high=90, every=100):
    sound = [(i, y, [math.floor(256 * float(x)) for x in v]) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for n, (i, y, v) in enumerate(sound):
        if i % every:
            continue
        scores = [(-dot(v, w), j, z) for m, (j, z, w) in enumerate(sound) if m != n]
        for p, j, _ in sorted(x for x in scores if x[2] == y)[:positives]:
            found = sorted(x for x in scores if x[2] != y and low * -p <= 100 * -x[0] <= high * -p)[:negatives]
            out += [(i, j, r + 1, m, max(LEAST, min(-p, MOST)), max(LEAST, min(-s, MOST))) for r, (s, m, _) in enumerate(found)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")


def clustered(n, d, clusters, seed, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, d))
    of = rng.integers(0, clusters, n)
    v = centres[of] + spread * rng.normal(size=(n, d))
    return [(i, v[i].round(2).tolist(), int(of[i] // 2)) for i in range(n)]


def test_clusters_and_ties_in_many_blocks(spark, monkeypatch):
    for name, value in (("BLOCK", 150), ("PART", 4), ("CANDIDATE_LEAF", 16), ("ANCHOR_LEAF", 2)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = clustered(700, 6, 8, 1) + [(1000 + i, [0.5] * 6, i % 3) for i in range(60)]
    expected = brute(rows, every=25)
    assert len(expected) > 500
    assert sorted(map(tuple, hard_negatives.mine(frame(spark, rows), every=25).collect())) == expected


def test_nulls_short_vectors_and_repeated_ids(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.0, 0.5, 1.0, -1.0]) for _ in range(rng.randint(0, 4))], rng.choice([1, 2, 3, None])) for i in range(0, 60)]
    rows += [(0, [1.0, 1.0], 1), (0, [1.0, 1.0], 1), (None, [1.0], 1), (70, None, 1), (71, [None], 2), (72, [float("nan")], 2), (73, [float("inf"), 1.0], 1), (74, [], 2)]
    df = frame(spark, rows).selectExpr("*", "1 AS row", "2 AS block", "3 AS part", "4 AS targets", "5 AS `a.b`", "6 AS more")
    assert sorted(map(tuple, hard_negatives.mine(df, every=10).collect())) == brute(rows, every=10)
    assert hard_negatives.mine(df.limit(0)).count() == 0
    one = hard_negatives.mine(frame(spark, [(0, [1.0], 1), (1, [1.0], 1)]))
    assert one.count() == 0


def test_scores_beyond_exact_floats_and_beyond_longs(spark):
    for big in (1e7, 1e8, 1e300):
        rows = [(0, [big, 1.0], 1), (1, [big, 0.0], 1), (2, [big * 0.5, 1.0], 2), (3, [big * 0.5, 0.0], 2), (4, [big * 0.95, 0.0], 2), (5, [-big, 0.0], 3)]
        found = sorted(map(tuple, hard_negatives.mine(frame(spark, rows)).collect()))
        if big < 1e300:
            assert found == brute(rows)
        else:
            assert all(LEAST <= r[4] <= MOST for r in found)


def side(rows, leaf):
    v, y = np.array([[math.floor(256 * x) for x in r[1]] for r in rows]), np.array([r[2] for r in rows])
    order, tree = plant(v, y, leaf)
    ids = np.array([r[0] for r in rows])[order]
    return Side(tree, v[order], y[order], ids, ids)


def test_intervals_hold_every_product():
    a, c = side(clustered(60, 5, 4, 3), 4), side(clustered(200, 5, 7, 4), 8)
    for i in range(len(a.tree.begins)):
        for j in range(len(c.tree.begins)):
            products = a.vectors[a.tree.begins[i] : a.tree.ends[i]] @ c.vectors[c.tree.begins[j] : c.tree.ends[j]].T
            least, most = interval(a, i, c, j)
            assert least <= products.min() and products.max() <= most
    assert sorted(a.ids) == list(range(60))


def test_pairs_of_nodes_go_unscored():
    rows = clustered(4000, 8, 40, 5, spread=0.02)
    anchors, candidates = side(rows[::20], 8), side(rows, 64)
    n = len(anchors.ids)
    for same in (True, False):
        low = np.full(n, -np.inf)
        target, _, _, scored = dual_search(anchors, candidates, Wanted(np.arange(n), low, -low, 5, same))
        leaves = (anchors.tree.lefts < 0).sum() * (candidates.tree.lefts < 0).sum()
        assert len(target) == 5 * n and scored < leaves / 4
