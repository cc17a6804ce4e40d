"""Ranked lexical search over document-sharded CSR postings with precomputed integer impacts.

Documents are cut into shards of a few MB, wherever they lie, so that indexing shuffles nothing. A shard holds its vocabulary
and, for the term c, the postings offsets[c] to offsets[c + 1]: document numbers and impacts. An impact is what a term's
frequency is worth in a document of that length, (10**9 * tf) div (1000 * tf + 20 * m); only the term's weight over the whole
corpus is left to the search. A search goes through each shard a term at a time, adding weight times impact to a dense
accumulator over the shard's documents. The best k are selected by a partial sort that keeps all ties of the k-th, and then
put in order. A task keeps the best k of all its shards; the tasks' lists are merged.

Spark holds a shard as two packed values, its vocabulary and its postings, and a few shards at a time: as lists, Spark would
keep levels beside every number, and all shards of a task at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from corpuskiln.llm.storage import durable, quoted
from corpuskiln.llm.words import ALNUM, Lookup, lookup, pieces, release, split_words, text_bytes

#: Bytes of text in a shard; a longer document is a shard of its own.
SHARD_BYTES = 4 << 20
#: Bytes of item texts that are ranked at once, and so the bound of what is sent to the tasks; more are taken in several passes.
ITEM_BYTES = 16 << 20
#: Bytes of a row group of the index, so that no task holds more shards at once. Parquet's writer would look at them only after 100 rows.
ROW_GROUP = 16 << 20
#: How the index is written.
LAYOUT = {"parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.enable.dictionary": "false"}
#: Lists of tasks that are merged before all are.
MERGED = 64

#: The columns of a shard that are packed together.
VOCABULARY, POSTINGS = ["terms", "offsets"], ["doc_ids", "documents", "impacts"]
INDEX_SCHEMA = "n_documents long, vocabulary binary, postings binary"


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of documents with terms, and of all their terms, without looking at what the terms are."""
    held, terms = 0, 0
    for batch in batches:
        for docs in pieces(batch, "text"):
            data, at = text_bytes(docs.column(docs.schema.get_field_index("text")))
            inside = ALNUM[data] != 0
            begins = inside.copy()
            begins[1:] &= ~inside[:-1]
            firsts = at[:-1][at[:-1] < len(data)]
            begins[firsts] = inside[firsts]
            n = np.diff(np.append(0, np.cumsum(begins))[at])
            held, terms = held + int((n > 0).sum()), terms + int(n.sum())
        release()
    yield pa.RecordBatch.from_pydict({"documents": [held], "terms": [terms]})


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """(10**9 * tf) div (1000 * tf + 20 * m), always below 10**6."""
    return ((1_000_000_000 * tf) // (1000 * tf + 20 * m)).astype(np.int32)


def _shard(docs: pa.RecordBatch, total: int, terms: int) -> pa.RecordBatch:
    words = split_words(docs.column(1), ALNUM)
    n, size = np.diff(words.offsets), len(docs)
    # In whole numbers of any size: lengths times the number of documents may leave 64 bits.
    m = np.array([50 + 50 * x * total // terms if x else 50 for x in n.tolist()], np.int64)
    owners = np.repeat(np.arange(size, dtype=np.int64), n)
    found, tf = np.unique(words.codes.astype(np.int64) * size + owners, return_counts=True)
    owners = found % size
    offsets = np.searchsorted(found // size, np.arange(len(words.vocabulary) + 1)).astype(np.int32)
    whole = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([int((n > 0).sum())]),
            whole(docs.column(0), pa.int64()),
            whole(words.vocabulary.cast(pa.binary()), pa.binary()),
            whole(offsets, pa.int32()),
            whole(owners.astype(np.int32), pa.int32()),
            whole(impacts(tf, m[owners]), pa.int32()),
        ],
        names=["n_documents", "doc_ids", "terms", "offsets", "documents", "impacts"],
    )


def _packed(shard: pa.RecordBatch, names: list[str]) -> bytes:
    """Some columns of a shard, as a compressed Arrow stream."""
    columns, out = shard.select(names), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, columns.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(columns)
    return out.getvalue().to_pybytes()


def _unpacked(batch: pa.RecordBatch, column: str, row: int) -> pa.RecordBatch:
    """The columns that a row of the index has packed."""
    return pa.ipc.open_stream(batch.column(batch.schema.get_field_index(column))[row].as_buffer()).read_next_batch()


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of every document, a row for each shard, written to the shared folder.

    Null and empty texts have no terms, and stay in the index as documents without postings; repeated rows and null ids are
    documents of their own; other columns are ignored, whatever their names; an empty table has no shards.
    """
    rows = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("text"))
    total, terms = (x or 0 for x in rows.select("text").mapInArrow(_lengths, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first())

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", SHARD_BYTES):
                shard = _shard(part, total, terms)
                yield pa.RecordBatch.from_pydict({"n_documents": shard.column(0), "vocabulary": [_packed(shard, VOCABULARY)], "postings": [_packed(shard, POSTINGS)]})
            release()

    return durable(rows.mapInArrow(index, INDEX_SCHEMA), "csr", **{"parquet.block.size": ROW_GROUP}, **LAYOUT)


@dataclass
class Items:
    """The distinct terms of some items: those of item i are places[offsets[i] : offsets[i + 1]] of `terms`."""

    terms: Lookup
    places: np.ndarray
    offsets: np.ndarray


def items_of(texts: pa.Array) -> Items:
    """The terms of each text; a null one has none."""
    words = split_words(texts, ALNUM)
    found, first = lookup(words.vocabulary.cast(pa.binary()))
    place = np.empty(len(first), np.int64)
    place[first] = np.arange(len(first))
    owners = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(words.offsets))
    pairs = np.unique(owners * max(1, len(place)) + place[words.codes])
    return Items(found, pairs % max(1, len(place)), np.searchsorted(pairs // max(1, len(place)), np.arange(len(texts) + 1)))


def _flat(shard: pa.RecordBatch, column: str) -> pa.Array:
    return shard.column(shard.schema.get_field_index(column)).flatten()


def _placed(vocabulary: pa.RecordBatch, asked: Lookup) -> tuple[np.ndarray, np.ndarray]:
    """Places among the asked terms of a shard's terms, and which of its terms they are."""
    places = asked.places(_flat(vocabulary, "terms"))
    held = np.flatnonzero(places >= 0)
    return places[held], held


def _frequencies(asked: Lookup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(asked.terms), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                vocabulary = _unpacked(batch, "vocabulary", row)
                places, held = _placed(vocabulary, asked)
                df[places] += np.diff(_flat(vocabulary, "offsets").to_numpy())[held]
            release()
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"place": some, "df": df[some]})

    return run


def weight(n: int, df: int) -> int:
    """floor(1000 * ln((2 * n + 2) / (2 * df + 1))), in doubles."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def select(scores: np.ndarray, ids: np.ndarray, unnamed: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores above 0, in order; ties by ascending id, rows without an id last."""
    held = np.flatnonzero(scores > 0)
    if len(held) > k:
        # All ties of the k-th stay until they are put in order.
        kth = scores[held][np.argpartition(scores[held], len(held) - k)[len(held) - k]]
        held = held[scores[held] >= kth]
    return held[np.lexsort((ids[held], unnamed[held], -scores[held]))][:k]


def _search(asked: Items, weights: np.ndarray, k: int):
    n = len(asked.offsets) - 1
    nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [nothing] * n
        for batch in batches:
            for row in range(batch.num_rows):
                vocabulary, postings = _unpacked(batch, "vocabulary", row), _unpacked(batch, "postings", row)
                places, held = _placed(vocabulary, asked.terms)
                where = np.full(len(asked.terms.terms), -1)
                where[places] = held
                offsets, documents = _flat(vocabulary, "offsets").to_numpy(), _flat(postings, "documents").to_numpy()
                worth, named = _flat(postings, "impacts").to_numpy(), _flat(postings, "doc_ids")
                ids, unnamed = named.fill_null(0).to_numpy(), named.is_null().to_numpy(zero_copy_only=False)
                scores = np.zeros(len(ids), np.int64)
                for i in range(n):
                    terms = asked.places[asked.offsets[i] : asked.offsets[i + 1]]
                    terms = terms[where[terms] >= 0]
                    if not len(terms):
                        continue
                    scores[:] = 0
                    for t in terms.tolist():
                        a, b = offsets[where[t]], offsets[where[t] + 1]
                        scores[documents[a:b]] += weights[t] * worth[a:b].astype(np.int64)
                    old, least = best[i], best[i][0][-1] if len(best[i][0]) == k else 0
                    if scores.max() < max(least, 1):
                        continue
                    top = select(scores, ids, unnamed, k)
                    merged = [np.concatenate(x) for x in zip(old, (scores[top], ids[top], unnamed[top]), strict=True)]
                    order = select(*merged, k)
                    best[i] = tuple(x[order] for x in merged)
            release()
        sizes = [len(x[0]) for x in best]
        scores, ids, unnamed = (np.concatenate([x[j] for x in best] or [nothing[j]]) for j in range(3))
        part = np.full(len(scores), TaskContext.get().partitionId() % MERGED)
        yield pa.RecordBatch.from_pydict({"part": part.astype(np.int32), "item": np.repeat(np.arange(n), sizes).astype(np.int32), "doc_id": pa.array(ids, mask=unnamed), "score": scores})

    return run


def search(index: DataFrame, items: DataFrame, k: int = 50, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of the k documents of the highest score above 0 for each item, or all if fewer.

    Equal scores go by ascending doc_id, documents without an id last. Items without terms have no rows; items that share an
    id, or have none, are ranked each for itself. Items are taken in passes of about ITEM_BYTES, so that any number of them is
    ranked whole; a pass's terms are what is sent to the tasks.
    """
    asked = items.select(quoted(item_id).alias("item_id"), quoted(text).alias("text")).filter(F.octet_length("text") > 0)
    schema = StructType([StructField("item", IntegerType()), asked.schema["item_id"]])
    # An item counts for some bytes besides its text, so that a pass holds no more of short ones either.
    total = asked.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    passes, n = 1 + total // ITEM_BYTES, index.agg(F.sum("n_documents")).first()[0] or 0
    found = None
    for at in range(passes):
        rows = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == at).toArrow().combine_chunks()
        some = items_of(rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string()))
        df = index.select("vocabulary").mapInArrow(_frequencies(some.terms), "place long, df long").groupBy("place").agg(F.sum("df").alias("df")).toArrow()
        weights = np.zeros(len(some.terms.terms), np.int64)
        weights[df.column("place").to_numpy()] = [weight(n, x) for x in df.column("df").to_pylist()]
        lists = index.select("vocabulary", "postings").mapInArrow(_search(some, weights, k), "part int, item int, doc_id long, score long")
        for keys in (["item", "part"], ["item"]):
            lists = _first(lists, keys, k)
        names = index.sparkSession.createDataFrame(pa.table({"item": pa.array(range(rows.num_rows), pa.int32()), "item_id": rows.column("item_id")}), schema)
        part = lists.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        found = part if found is None else found.unionByName(part)
    return found


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order: list[Column] = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
