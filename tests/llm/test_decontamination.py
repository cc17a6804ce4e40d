"""Exact phrases against brute force, and proximity."""

from __future__ import annotations

import hashlib
import re

from corpuskiln.llm import decontamination, registry

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, size=10):
    windows = {}
    for item, text in items:
        own = words(text)
        for i in range(max(1, len(own) - size + 1) if own else 0):
            windows.setdefault(tuple(own[i : i + size]), set()).add("null" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        own, hit, found = words(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(own) - n + 1):
                if mine := windows.get(tuple(own[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= mine
        out.append((doc_id, len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted(map(tuple, registry.op2_decontamination(spark, sf).collect()), key=repr) == brute(docs, items)


def test_odd_rows(spark, odd_docs, no_docs):
    items = [(1, "Seven, eight NINE"), (2, "word"), (None, "ten eleven"), (3, None), (4, ""), (5, "two " * 30), (1, "three four"), (6, "fox jumps over a lazy dog near the old river bank")]
    bench = spark.createDataFrame(items, "item_id int, text string")
    rows = decontamination.report(decontamination.search(decontamination.build_index(odd_docs), bench)).collect()
    assert sorted(map(tuple, rows), key=repr) == brute([(r.doc_id, r.text) for r in odd_docs.collect()], items)
    assert decontamination.search(decontamination.build_index(no_docs), bench).count() == 0
    none = decontamination.search(decontamination.build_index(odd_docs), bench.limit(0))
    assert none.count() == 12 and none.filter("size(hits) > 0").count() == 0
    kept = decontamination.decontaminate(odd_docs, bench)
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.collect()} == {3, 4, 5, 7, -9, None}


def test_passes_over_items_give_the_same(spark, odd_docs, monkeypatch):
    bench = spark.createDataFrame([(i, f"{w} {v}") for i, (w, v) in enumerate([("seven", "eight"), ("one", "two"), ("lazy", "dog"), ("no", "such")])], "item_id int, text string")
    index = decontamination.build_index(odd_docs)
    once = decontamination.report(decontamination.search(index, bench)).collect()
    monkeypatch.setattr(decontamination, "ITEM_BYTES", 9)
    assert sorted(map(str, decontamination.report(decontamination.search(index, bench)).collect())) == sorted(map(str, once))


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta gamma"), (2, "alpha beta x x x gamma"), (3, "alpha beta gamma")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id int, text string")
    index = decontamination.build_index(docs)

    def found(slop):
        return {r.doc_id for r in decontamination.search(index, bench, slop=slop).filter("size(items) > 0").collect()}

    assert found(0) == {3} and found(1) == {1, 3} and found(3) == {1, 2, 3}


def test_rows_and_not_ids_are_dropped(spark):
    passage = "one two three four five six seven eight nine ten"
    rows = [(5, passage), (5, "clean text here"), (None, f"so {passage} it is"), (None, "clean too"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS `my col`", "2 AS `a-b`", "3 AS `a.b`", "4 AS digest")
    kept = decontamination.decontaminate(docs, spark.createDataFrame([(1, passage)], "item_id int, text string"))
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == [("5", "clean text here"), ("6", "None"), ("None", "clean too")]


def test_random_texts_with_few_words(spark):
    import random

    rng = random.Random(7)
    docs = [(i, " ".join(rng.choices("abcd", k=rng.randint(0, 60)))) for i in range(60)]
    items = [(i, " ".join(rng.choices("abcd", k=rng.randint(0, 7)))) for i in range(25)]
    index = decontamination.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    found = decontamination.search(index, spark.createDataFrame(items, "item_id int, text string"), window=4)
    assert sorted(map(tuple, decontamination.report(found).collect()), key=repr) == brute(docs, items, 4)


def test_proximity_stays_within_a_document(spark):
    docs = spark.createDataFrame([(1, "gamma x alpha"), (2, "beta y z")], "doc_id long, text string").coalesce(1)
    index = decontamination.build_index(docs)
    bench = spark.createDataFrame([(1, "alpha beta")], "item_id int, text string")
    assert decontamination.search(index, bench, slop=64).filter("size(items) > 0").count() == 0
