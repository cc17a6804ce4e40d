"""Token counts and ids against the libraries."""

from __future__ import annotations

import base64
import hashlib

import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from corpuskiln.llm import byte_bpe, registry, token_counts
from corpuskiln.llm.pretokens import pretokens

import pyarrow as pa
import regex
import random


def library(name="byte_bpe_50k.tiktoken"):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(name), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(rows):
    lib = library()
    out = []
    for i, text in rows:
        ids = lib.encode_ordinary(text or "")
        out.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def counted(rows):
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return sorted(((i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in rows), key=repr)


def test_pretokens_are_the_matches_of_the_pattern():
    rng = random.Random(2)
    parts = ["'", "s", "ll", "re", " ", "  ", "\n", "\t", "a", "é", "1", "٢", "!", "'t", " ", "　", "\U0001f600", "한", "'d", "x'"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(5000)]
    found = pretokens(pa.array(texts))
    words = found.vocabulary.to_pylist()
    for i, t in enumerate(texts):
        own = [words[c].decode() for c in found.codes[found.offsets[i] : found.offsets[i + 1]]]
        assert own == regex.findall(P.PATTERN, t), repr(t)


def test_encoding_of_all_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in registry.op10_byte_bpe(spark, sf).collect()), key=repr) == expected(rows)


def test_encoding_of_odd_rows_and_decoding(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    out = byte_bpe.encode(odd_docs, with_ids=True)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()), key=repr) == expected(rows)
    back = sorted(((r.doc_id, bytes(r.data).decode()) for r in byte_bpe.decode(out).collect()), key=repr)
    assert back == sorted(((i, t or "") for i, t in rows), key=repr)
    assert byte_bpe.encode(no_docs).count() == 0


def test_long_words(spark):
    texts = ["a" * 70, "ab" * 500, "=" * 300, "é" * 40, "x" * 64, "xyzzy" * 13, "한" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((tuple(r) for r in byte_bpe.encode(df).collect()), key=repr) == expected(enumerate(texts))


def test_counts_of_all_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in registry.op8_token_counts(spark, sf).collect()), key=repr) == counted(rows)


def test_counts_of_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted((tuple(r) for r in token_counts.count_tokens(odd_docs).collect()), key=repr) == counted(rows)
    assert token_counts.count_tokens(no_docs).count() == 0


def test_proven_strings_encode_alone_as_one_token():
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    proven = token_counts.proven(tokenizer)
    assert len(proven) > 40_000
    for token in proven[::97]:
        assert len(tokenizer.model.tokenize(token_counts.as_letters(token))) == 1
