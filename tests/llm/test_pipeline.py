"""The pipeline: each stage's decisions, and the whole against the stages' own brute force."""

from __future__ import annotations

import corpus_pipeline

from tests.llm.test_decontamination import brute as leaks
from tests.llm.test_near_duplicates import brute as components
from tests.llm.test_tokens import expected


def test_stages_in_order(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        from corpuskiln.llm.storage import durable

        tables.append(durable(stage(spark, tables[-1], sf), "test-stage"))
    assert all(t.columns == docs.columns for t in tables[:-1])
    rows = [[(r.doc_id, r.text) for r in t.collect()] for t in tables[:-1]]
    assert {i for i, t in rows[0] if not any(c.isalpha() for c in t or "")}.isdisjoint(i for i, _ in rows[1])
    assert len(rows[1]) >= 0.97 * sum(any(c.isalpha() for c in t or "") for _, t in rows[0])
    assert {i for i, _ in rows[2]} == {i for i, _, _, kept in components(rows[1], 5) if kept}
    assert {i for i, _ in rows[3]} == {x[0] for x in leaks(rows[2], items) if not x[-1]}
    assert {i for i, _ in rows[4]} == {i for i, _ in rows[3]}
    assert not any("@example" in (t or "") for _, t in rows[4])
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in tables[-1].collect()), key=repr) == expected(rows[4])


def test_no_rows(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.encode(spark, docs, sf).count() == 0


def test_odd_rows_pass_all_stages(spark, odd_docs):
    sf = "/root/testdata/sf0.001"
    docs = odd_docs.selectExpr("*", "1 AS `my col`", "2 AS `a-b`", "3 AS `a.b`")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in docs.collect()}
    out = corpus_pipeline.encode(spark, docs, sf)
    assert out.count() == docs.count()
