"""The numbered queries against their SQL, and the columns that each returns."""

from __future__ import annotations

import pytest

from corpuskiln.llm import registry

COLUMNS = {
    "op1_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op2_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op3_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op4_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op5_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op6_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op7_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op9_near_duplicates": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op11_lexical_search": "item_id bigint, rank int, doc_id bigint, score bigint",
    "op12_hard_negatives": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
    "op13_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_entropy bigint",
    "op10_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
}


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(same_as_sql, name):
    assert same_as_sql(registry.QUERIES[name], registry.ORACLES[name]) > 0


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_has_its_columns(spark, name):
    df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    found = dict(df.dtypes)
    for column in COLUMNS[name].split(", "):
        column, kind = column.split(" ")
        assert found[column] == kind
