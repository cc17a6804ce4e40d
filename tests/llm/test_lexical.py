"""Ranked search against a plain count of all documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from corpuskiln.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=50):
    """(item, rank, doc_id, score), sorted."""
    found = [(i, Counter(terms(t))) for i, t in docs]
    held = [x for x in found if x[1]]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 50 + 50 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if unnamed else i, -s) for r, (s, unnamed, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_random_texts_in_many_shards(spark, monkeypatch):
    rng = random.Random(11)
    vocabulary = ["été", "Word", "word", "x1", "2", "한글", "a-b", *(f"t{i}" for i in range(30))]
    docs = [(i % 90, " ".join(rng.choices(vocabulary, k=rng.randint(0, 40)))) for i in range(300)] + [(7, None), (None, "word t1"), (None, "word t1"), (8, ""), (9, "-- ..")]
    items = [(i, " ".join(rng.choices([*vocabulary, "never"], k=rng.randint(0, 12)))) for i in range(25)] + [(3, "word"), (None, "t1"), (50, None), (51, "")]
    expected = brute(docs, items, 7)
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(lexical, "SHARD_BYTES", 500)
    index = lexical.build_index(d)
    assert index.count() > 10
    assert rows(lexical.search(index, q, 7)) == expected
    monkeypatch.setattr(lexical, "ITEM_BYTES", 200)
    assert rows(lexical.search(index, q, 7)) == expected


def test_ties_go_by_id_in_every_shard(spark, monkeypatch):
    docs = [(i, "same words here") for i in range(200, 0, -1)] + [(1000 + i, f"other {i}") for i in range(200)]
    monkeypatch.setattr(lexical, "SHARD_BYTES", 64)
    found = rows(lexical.search(lexical.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(6)), spark.createDataFrame([("q", "same words")], "item_id string, text string")))
    assert sorted((r, i) for _, r, i, _ in found) == [(i, i) for i in range(1, 51)]


def test_selection_keeps_the_ties_of_the_last():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        scores, ids, unnamed = rng.integers(0, 4, n), rng.permutation(n), rng.random(n) < 0.1
        expected = sorted((-s, u, i) for s, i, u in zip(scores, ids, unnamed, strict=True) if s > 0)[:5]
        assert [(-scores[j], unnamed[j], ids[j]) for j in lexical.select(scores, ids, unnamed, 5)] == expected


def test_odd_documents(spark, odd_docs, no_docs):
    items = odd_docs.selectExpr("doc_id AS item_id", "text", "1 AS score", "2 AS `a.b`")
    plain = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert rows(lexical.search(lexical.build_index(odd_docs), items, 3)) == brute(plain, plain, 3)
    index = lexical.build_index(no_docs)
    assert lexical.search(index, items).count() == 0 and lexical.search(lexical.build_index(odd_docs), items.limit(0)).count() == 0


def test_lengths_beyond_64_bits():
    import pyarrow as pa

    docs = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["a b a"]})
    out = lexical._shard(docs, 10**18, 10**19)
    m = 50 + 50 * 3 * 10**18 // 10**19
    assert out.column("impacts").to_pylist() == [[10**9 * 2 // (2000 + 20 * m), 10**9 // (1000 + 20 * m)]]


def test_a_task_holds_few_shards_at_once(spark, monkeypatch):
    rng = random.Random(12)
    docs = [(i, " ".join(f"{rng.getrandbits(40):x}" for _ in range(100))) for i in range(90)]
    monkeypatch.setattr(lexical, "SHARD_BYTES", 1000)
    monkeypatch.setattr(lexical, "ROW_GROUP", 30_000)
    index = lexical.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    files = [pq.read_metadata(path.removeprefix("file:")) for path in index.inputFiles()]
    groups = [m.row_group(i) for m in files for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 90 and max(g.total_byte_size for g in groups) < 60_000
    # Lists would be held with levels beside every number.
    assert not any("array" in kind for _, kind in index.dtypes)
    assert rows(lexical.search(index, spark.createDataFrame(docs[::30], "item_id long, text string"), 3)) == brute(docs, docs[::30], 3)
