"""Links and components against all pairs."""

from __future__ import annotations

import random
import re

from corpuskiln.llm import near_duplicates, registry


def shingles(text, width):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, width):
    sets = [(i, shingles(t, width)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    by_id = {}
    for i, (doc, s) in enumerate(sets):
        if s and doc in by_id:
            parent[root(i)] = root(by_id[doc])
        elif s:
            by_id[doc] = i
    for i, (_, s) in enumerate(sets):
        for j in range(i):
            t = sets[j][1]
            if s and t and (len(s) * 100 >= len(t) * 80) and (len(t) * 100 >= len(s) * 80):
                both = len(s & t)
                if 100 * both >= 80 * (len(s) + len(t) - both):
                    parent[root(i)] = root(j)
    least = {}
    for i, (doc, s) in enumerate(sets):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted((doc, len(s), least[root(i)] if s else doc, (least[root(i)] if s else doc) == doc) for i, (doc, s) in enumerate(sets))


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, registry.op9_near_duplicates(spark, sf).collect())) == brute(rows, 2)


def test_chains_hubs_and_edges_of_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 5)
    rng, rows = random.Random(4), []
    base = [f"w{i}" for i in range(60)]
    text = list(base)
    for i in range(40):  # a chain: each differs from the one before in few words
        text = list(text)
        text[rng.randrange(60)] = f"c{i}"
        rows.append((i, " ".join(text)))
    for i in range(60):  # copies of one text with one word changed, at random
        t = list(base)
        t[rng.randrange(60)] = f"r{rng.randrange(9)}"
        rows.append((100 + i, " ".join(t)))
    for i in range(30):  # exact copies
        rows.append((200 + i, "Same  text\tHERE and there"))
    rows += [(300, ""), (301, None), (302, "single"), (303, "SINGLE"), (304, "two words"), (305, " \x0b ")]
    rows += [(400, " ".join(f"t{i}" for i in range(10))), (401, " ".join(f"t{i}" for i in range(9))), (402, " ".join(f"t{i}" for i in range(8)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for width in (2, 5):
        assert sorted(map(tuple, near_duplicates.near_duplicates(df, width).collect())) == brute(rows, width)


def test_odd_rows(odd_docs, no_docs):
    rows = near_duplicates.near_duplicates(odd_docs).collect()
    assert len(rows) == 12
    assert {(r.doc_id, r.component_id, r.kept) for r in rows if r.doc_id in (1, 2, 3)} == {(1, 1, True), (2, 1, False), (3, 3, True)}
    assert sorted((r.component_id, r.kept) for r in rows if r.doc_id is None and r.n_shingles) == [(1, False)]
    kept = near_duplicates.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == 11
    assert near_duplicates.near_duplicates(no_docs).count() == 0


def test_shared_key_for_every_distance_within_the_radius():
    import numpy as np

    rng = np.random.default_rng(1)
    chunks, width, errors = 16, 6, 1
    radius = chunks * (errors + 1) - 1
    a = rng.integers(0, 2**16, (200, chunks * width)).astype(np.uint16)
    b = a.copy()
    for i in range(200):
        at = rng.choice(chunks * width, radius, replace=False)
        b[i, at] ^= 1
    shared = (near_duplicates.keys(a) == near_duplicates.keys(b)).any(1)
    assert shared.all()


def test_repeated_ids_with_different_texts_lose_no_link(spark):
    a, b = ([f"{c}{i}" for i in range(40)] for c in "ab")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a, "x"])), (3, " ".join([*b, "y"])), (3, "alone here with words"), (4, "alone here with words"), (5, "others"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' AS `text key`", "1 AS `a.b`")
    assert sorted(map(tuple, near_duplicates.near_duplicates(df, 2).collect())) == brute(rows, 2)
    assert {r.doc_id for r in near_duplicates.drop_near_duplicates(df, 2).collect()} == {1, 5}
