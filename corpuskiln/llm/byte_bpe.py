"""Byte-level BPE encoding and decoding.

Texts are cut into pre-tokens in blocks of a few MB. A pre-token that is in the vocabulary is one id. For each distinct other
word, Spark's higher-order functions fold the ranked merges over the word's bytes, with the rank map as a literal. Words that
several blocks share are folded once, beforehand, and broadcast, as many as a fixed bound allows; each block folds its own
others, most of which no other block has. Bytes are kept as the
characters U+0000 to U+00FF while they are merged. Decoding concatenates the ids' binary pieces.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskiln.llm.pretokens import pretokens
from corpuskiln.llm.storage import durable
from corpuskiln.llm.words import Lookup, lists, lookup, pieces, release, tidy

#: Bytes of text in a block.
BLOCK_BYTES = 2 << 20
#: The most widespread words that are folded beforehand, each once; the bound of what is broadcast. Words of fewer blocks are folded in each.
SHARED_WORDS = 3 << 18
#: Folding looks at each byte of a word after each merge; longer words, which are rare, are merged by tiktoken, whose work does not grow so.
LONGEST = 64
#: Buckets of the literal rank map, so that a look-up compares with few keys.
BUCKETS = 1 << 14
NEVER = 2**31 - 1


def read_ranks(path: str) -> list[bytes]:
    """The byte string of each rank."""
    with open(path, "rb") as lines:
        found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return [found.get(i, b"") for i in range(max(found) + 1)]


def rank_literal(tokens: list[bytes]) -> Column:
    """array<map<string, int>>: in bucket crc32(token) mod BUCKETS, each token's rank. Spark folds it into one literal."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for rank, token in enumerate(tokens):
        if token:
            key = token.decode("latin-1")
            buckets[zlib.crc32(key.encode()) % BUCKETS][key] = rank
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def _let(value: Column, body) -> Column:
    """`body` of `value`, evaluated once."""
    return F.transform(F.array(value), body)[0]


def merged(word: Column, ranks: Column) -> Column:
    """array<int>: the ids of a word of two or more bytes (as characters), by merging the pair of lowest rank, leftmost first, until none has a rank.

    The rank map is named once, so that plans and tasks hold it once.
    """
    return _let(ranks, lambda named: _folded(word, named))


def _folded(word: Column, ranks: Column) -> Column:
    def rank(piece: Column) -> Column:
        bucket = F.pmod(F.crc32(piece.cast("binary")), F.lit(BUCKETS)).cast("int")
        return F.coalesce(F.element_at(F.get(ranks, bucket), piece), F.lit(NEVER))

    def step(state: Column, _: Column) -> Column:
        p, r = state["pieces"], state["ranks"]

        def merge(at: Column) -> Column:
            def around(joined: Column) -> Column:
                left = F.when(at > 1, F.array(rank(F.concat(F.get(p, at - 2), joined)))).otherwise(F.array().cast("array<int>"))
                right = F.when(at < F.size(r), F.array(rank(F.concat(joined, F.get(p, at + 1))))).otherwise(F.array().cast("array<int>"))
                return F.struct(
                    F.concat(F.slice(p, 1, at - 1), F.array(joined), F.slice(p, at + 2, F.size(p))).alias("pieces"),
                    F.concat(F.slice(r, 1, F.greatest(at - 2, F.lit(0))), left, right, F.slice(r, at + 2, F.size(r))).alias("ranks"),
                )

            return _let(F.concat(F.get(p, at - 1), F.get(p, at)), around)

        best = F.array_min(r)
        return F.when(best < NEVER, _let(F.array_position(r, best).cast("int"), merge)).otherwise(state)

    n = F.char_length(word)
    start = F.struct(
        F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(word, i, F.lit(1))).alias("pieces"),
        F.transform(F.sequence(F.lit(1), n - 1), lambda i: rank(F.substring(word, i, F.lit(2)))).alias("ranks"),
    )
    return F.aggregate(F.sequence(F.lit(2), n), start, step, lambda s: F.transform(s["pieces"], rank))


def _latin(words: pa.Array) -> pa.Array:
    """The words' bytes as characters."""
    return pa.array([w.decode("latin-1") for w in words.to_pylist()], pa.string())


def _unknown(words: pa.Array, known: pa.Array) -> np.ndarray:
    """Whether each word is neither among the known nor too long to fold."""
    return pc.and_(pc.is_null(pc.index_in(words, known)), pc.less_equal(pc.binary_length(words), LONGEST)).to_numpy(zero_copy_only=False)


def _distinct(tokens: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(tokens, pa.large_binary())
        for batch in batches:
            for docs in pieces(batch, "text", BLOCK_BYTES):
                found = pretokens(docs.column(0)).vocabulary
                yield pa.RecordBatch.from_arrays([_latin(found.filter(pa.array(_unknown(found, known))))], names=["word"])
            release()

    return run


BLOCK_SCHEMA = "doc_ids array<bigint>, offsets array<int>, codes binary, places binary, fresh array<string>, long array<binary>"


def _blocks(tokens: list[bytes], shared: Lookup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(tokens, pa.large_binary())
        for batch in batches:
            for docs in pieces(batch, "text", BLOCK_BYTES):
                words = pretokens(docs.column(1))
                place = pc.fill_null(pc.index_in(words.vocabulary, known), -1).to_numpy(zero_copy_only=False).astype(np.int32)
                large = (place < 0) & (pc.binary_length(words.vocabulary).to_numpy(zero_copy_only=False) > LONGEST)
                short = np.flatnonzero((place < 0) & ~large)
                latin = _latin(words.vocabulary.take(pa.array(short)))
                held = shared.places(latin)
                place[short[held >= 0]] = len(known) + held[held >= 0]
                fresh, base = short[held < 0], len(known) + len(shared.terms)
                place[fresh] = base + np.arange(len(fresh))
                place[large] = base + len(fresh) + np.arange(large.sum())
                one = np.array([0, docs.num_rows])

                def row(values: pa.Array) -> pa.Array:
                    return lists(values, np.array([0, len(values)]))

                yield pa.RecordBatch.from_arrays(
                    [
                        lists(docs.column(0), one),
                        row(pa.array(words.offsets.astype(np.int32))),
                        pa.array([words.codes.tobytes()], pa.binary()),
                        pa.array([place.tobytes()], pa.binary()),
                        row(latin.filter(pa.array(held < 0))),
                        row(words.vocabulary.filter(pa.array(large)).cast(pa.binary())),
                    ],
                    names=["doc_ids", "offsets", "codes", "places", "fresh", "long"],
                )
            release()

    return run


ENCODED_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _slices(values: pa.Array, offsets: np.ndarray) -> list[memoryview]:
    """The bytes of a binary array's entries, joined between the offsets."""
    at = np.frombuffer(values.buffers()[1], np.int64)[: len(values) + 1]
    data = memoryview(values.buffers()[2] or b"")
    return [data[at[a] : at[b]] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def joined(ids: pa.Array, tokens: pa.Array, offsets: np.ndarray) -> list[memoryview]:
    """The bytes of each run of ids between the offsets: their binary pieces, concatenated."""
    return _slices(tokens.take(ids), offsets)


def _assemble(tokens: list[bytes], shared_ids: pa.Array, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiktoken_ = None
        binary = pa.array(tokens, pa.large_binary())
        digits = pa.array([b"%d " % i for i in range(len(tokens))], pa.large_binary())
        plain = np.arange(len(tokens) + 1)
        single, known = lists(pa.array(plain[:-1], pa.int32()), plain), len(tokens) + len(shared_ids)
        for batch in batches:
            for block in (batch.slice(i, 1) for i in range(batch.num_rows)):
                folded, large = block.column("folded")[0].values, block.column("long")[0].values
                if len(large):
                    tiktoken_ = tiktoken_ or _library(tokens)
                    large = [tiktoken_.encode_single_piece(w) for w in large.to_pylist()]
                places = np.frombuffer(block.column("places")[0].as_py(), np.int32)
                codes = np.frombuffer(block.column("codes")[0].as_py(), np.int32)
                # The ids of the block's own vocabulary: tokens, then shared words, then its others in their order.
                which = [np.flatnonzero(places < len(tokens)), np.flatnonzero((places >= len(tokens)) & (places < known)), np.flatnonzero(places >= known)]
                others = pa.concat_arrays([folded.cast(pa.list_(pa.int32())), pa.array(list(large), pa.list_(pa.int32()))])
                table = pa.concat_arrays(
                    [single.take(pa.array(places[which[0]])), shared_ids.take(pa.array(places[which[1]] - len(tokens))), others.take(pa.array(places[which[2]] - known))]
                )
                order = np.empty(len(places), np.int32)
                order[np.concatenate(which)] = np.arange(len(places))
                flow = table.take(pa.array(order[codes]))
                ids, ends = flow.flatten(), flow.offsets.to_numpy()
                offsets = (ends - ends[0])[block.column("offsets")[0].values.to_numpy()]
                texts = _slices(digits.take(ids), offsets)
                n = np.diff(offsets)
                doc_ids = block.column("doc_ids")[0].values
                columns = [
                    doc_ids,
                    pa.array(n.astype(np.int64)),
                    pa.array([hashlib.sha256(t[:-1]).hexdigest() for t in texts]),
                    pa.array([hashlib.sha256(b).hexdigest() for b in joined(ids, binary, offsets)]),
                ]
                if with_ids:
                    columns.append(lists(ids.cast(pa.int32()), offsets))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])
            release()

    return run


def _library(tokens: list[bytes]):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens) if t}, special_tokens={})._core_bpe


def encode(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and the digests ids_sha256 and decoded_sha256 of every row; with_ids: the ids too.

    Ids are those of the tiktoken library for the rank file at `path` (by default byte_bpe_50k.tiktoken) and the pre-token
    pattern, without special tokens. Null texts are empty and have no ids. Rows are encoded one by one, whatever their ids;
    other columns are ignored.
    """
    tokens = read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ranks = rank_literal(tokens)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    spread = durable(rows.select("text").mapInArrow(_distinct(tokens), "word string").groupBy("word").agg(F.count("*").alias("blocks")), "words")
    # Words in two or more blocks, by how widespread they are, in steps of an eighth of a power of e.
    level = F.floor(8 * F.log("blocks"))
    chosen, n = set(), 0
    for step in spread.filter("blocks > 1").groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.col("level").desc()).collect():
        if n + step.n > SHARED_WORDS:
            break
        chosen, n = {*chosen, step.level}, n + step.n
    often = spread.filter((F.col("blocks") > 1) & level.isin(chosen)).select("word")
    often = durable(often.select("word", merged(F.col("word"), ranks).alias("ids")), "folded").toArrow().combine_chunks()
    # Of shared words with one hash all but the first are folded in their blocks.
    shared, order = lookup(often.column("word").combine_chunks().cast(pa.string()))
    shared_ids = often.column("ids").combine_chunks().cast(pa.list_(pa.int32())).take(pa.array(order))
    del often
    tidy()
    blocks = rows.mapInArrow(_blocks(tokens, shared), BLOCK_SCHEMA)
    folded = blocks.withColumn("folded", F.transform("fresh", lambda w: merged(w, ranks))).drop("fresh")
    return folded.mapInArrow(_assemble(tokens, shared_ids, with_ids), ENCODED_SCHEMA + ", ids array<int>" * with_ids)


def _decoded(tokens: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        binary = pa.array(tokens, pa.large_binary())
        for batch in batches:
            ids = batch.column(1).fill_null([])
            ends = ids.offsets.to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bytes(b) for b in joined(ids.flatten(), binary, ends - ends[0])], pa.binary())], names=["doc_id", "data"])

    return run


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and data: for each row's ids, their binary pieces concatenated (the UTF-8 bytes of the text).

    Null ids are none, and give no bytes; repeated rows and null doc_ids each keep their row; an empty table gives no rows; an
    id that no rank has gives nothing; other columns are left behind.
    """
    tokens = read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(tokens), "doc_id long, data binary")
