"""Packing and slots."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import pytest

from corpuskiln.llm import registry, sharding


def plain_best_fit(sizes, capacity):
    free, out = [], []
    for s in sizes:
        fits = [(f, i) for i, f in enumerate(free) if f >= s]
        i = min(fits)[1] if fits else len(free)
        if not fits:
            free.append(max(capacity, s))
        free[i] -= s
        out.append(i)
    return out


def test_tree_packs_as_a_plain_search_does():
    rng = random.Random(1)
    for _ in range(200):
        sizes = sorted((rng.randint(1, 60) for _ in range(rng.randint(0, 80))), reverse=True)
        assert sharding.best_fit_decreasing(sizes, 64) == plain_best_fit(sizes, 64)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    rows = registry.op4_sharding(spark, f"/root/testdata/{sf}").collect()
    assert len(rows) == len(docs)
    total, slots, groups = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in rows:
        data = (docs[r.doc_id] or "").encode()
        assert r.size == len(data) + 16 and r.text_crc32 == zlib.crc32(data) and r.law == "bytes" and r.grown_shard is None
        total[r.shard] += r.size
        slots[r.shard].append(r.slot)
        groups[docs[r.doc_id]].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(g) == 1 for g in groups.values())
    largest = max(sum(r.size for r in rows if docs[r.doc_id] == t) for t in groups)
    assert set(total) <= set(range(40))
    even = sum(total.values()) / 40
    assert max(total.values()) <= max(1.02 * even, largest) + 1


def test_odd_rows(odd_docs, no_docs):
    rows = sharding.shard(odd_docs, 3).collect()
    assert len(rows) == 12 and {r.shard for r in rows} <= {0, 1, 2}
    assert len({r.shard for r in rows if r.doc_id in (1, 2)}) == 1
    assert sharding.shard(no_docs).count() == 0


def test_slots_over_several_chunks(spark):
    rows = spark.range(1000).selectExpr("id", "cast(id % 3 AS int) AS shard")
    out = sharding.with_slots(rows, ["id"], share=20).collect()
    for s in range(3):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(len([r for r in out if r.shard == s])))


def test_runs_pack_as_single_items_do():
    rng = random.Random(2)
    for _ in range(200):
        sizes = sorted((rng.choice([1, 2, 3, 5, 8, 60]) for _ in range(rng.randint(0, 300))), reverse=True)
        assert sharding.best_fit_decreasing(sizes, 64) == plain_best_fit(sizes, 64)


def test_rows_lie_where_a_plain_packing_of_all_groups_puts_them(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 7)
    monkeypatch.setattr(sharding, "MANY", 5)
    rng = random.Random(3)
    texts = [f"{i % 90:03d}" + "x" * rng.choice([0, 5, 5, 5, 40, 300]) for i in range(400)] + ["same"] * 30 + [None] * 9
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS `a.b`", "2 AS `my col`", "3 AS bytes")
    rows = sharding.shard(docs, 6).collect()
    groups = defaultdict(int)
    for t in texts:
        groups[t] += len(t or "") + 16
    sizes = sorted(groups.values(), reverse=True)
    loads, by_text = defaultdict(list), {}
    for r in rows:
        assert by_text.setdefault(texts[r.doc_id], r.shard) == r.shard
    for t, shard in by_text.items():
        loads[shard].append(groups[t])
    runs = [(s, sizes.count(s)) for s in sorted(set(sizes), reverse=True)]
    expected, left = defaultdict(list), [s for s, n in runs for _ in range(n)]
    for own in sharding.pack_evenly(runs, 6):
        for shard, n in own:
            expected[shard] += [left.pop(0) for _ in range(n)]
    assert {k: sorted(v) for k, v in loads.items()} == {k: sorted(v) for k, v in expected.items()}
    capacity = 900
    fixed = sharding.shard(docs, capacity=capacity).groupBy("shard").sum("size").collect()
    used = defaultdict(int)
    for s, b in zip(sizes, plain_best_fit(sizes, capacity), strict=True):
        used[b] += s
    assert sorted(r[1] for r in fixed) == sorted(used.values())
