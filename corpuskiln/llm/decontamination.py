"""Benchmark decontamination over a distributed positional inverted index.

Training texts are cut into blocks of a few MB. A block's index holds, for each term, the ascending positions at which it
stands in the block, and one row that says which document owns which positions. Positions of neighbouring documents are
`GAP` apart, so that no match spans two. All test windows are sought in a block at once: those of which a term has no postings
there fall out, the postings of each other's rarest term there, shifted by its offset, are its candidates, and the candidates
are intersected with the postings of the other terms, the next rarest first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskiln.llm.storage import durable
from corpuskiln.llm.words import ALNUM, lists, pieces, release, split_words

#: Free positions between documents, and so the largest slop of a proximity match.
GAP = 64
#: Bytes of text in a block.
BLOCK_BYTES = 4 << 20
#: Bytes of test texts that are looked up at once, and so the bound of what is broadcast; more are taken in several passes.
ITEM_BYTES = 32 << 20
#: Candidates that are intersected at once.
CANDIDATES = 1 << 20


def _index_block(block: str, docs: pa.RecordBatch) -> pa.RecordBatch:
    words = split_words(docs.column(1), ALNUM)
    lengths = np.diff(words.offsets)
    starts = words.offsets[:-1] + GAP * np.arange(len(lengths))
    order = np.argsort(words.codes, kind="stable")
    places = (np.arange(len(words.codes)) + GAP * np.repeat(np.arange(len(lengths)), lengths))[order].astype(np.int32)
    counts = np.bincount(words.codes, minlength=len(words.vocabulary))
    n = len(words.vocabulary)
    one = np.append(np.zeros(n + 1, np.int32), len(lengths))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([block] * (n + 1)),
            pa.concat_arrays([words.vocabulary.cast(pa.binary()).cast(pa.string()), pa.nulls(1, pa.string())]),
            lists(pa.array(places), np.append(np.append(0, np.cumsum(counts)), len(places))),
            lists(docs.column(0), one),
            lists(pa.array(starts.astype(np.int32)), one),
            lists(pa.array(lengths.astype(np.int32)), one),
        ],
        names=["block", "term", "positions", "doc_ids", "starts", "lengths"],
    )


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        for docs in pieces(batch, "text", BLOCK_BYTES):
            yield _index_block(f"{task}-{n}", docs)
            n += 1
        release()


def build_index(docs: DataFrame, doc_id: str | Column = "doc_id", text: str = "text") -> DataFrame:
    """The positional index of every text, written to the shared folder.

    One row for each block and term, and one with a null term that lists the block's documents by their ids, which may be of
    any plain type. Null texts have no words; repeated and null ids each keep their own row; other columns are ignored.
    """
    rows = docs.select((F.col(doc_id).cast("long") if isinstance(doc_id, str) else doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"block string, term string, positions array<int>, doc_ids array<{rows.schema['doc_id'].dataType.simpleString()}>, starts array<int>, lengths array<int>"
    return durable(rows.mapInArrow(_index, schema), "postings")


@dataclass
class Windows:
    """Test windows: window i is codes[starts[i] : starts[i] + sizes[i]], of the item owners[i]; a code is a place among the terms."""

    terms: pa.Array
    codes: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    owners: np.ndarray


def windows(texts: pa.Array, size: int) -> Windows:
    """The windows of each text: every `size` consecutive words, or all of them if there are fewer."""
    words = split_words(texts, ALNUM)
    lengths = np.diff(words.offsets)
    n = np.where(lengths > 0, np.maximum(lengths - size + 1, 1), 0)
    owners = np.repeat(np.arange(len(n)), n)
    starts = np.arange(len(owners)) - np.repeat(np.cumsum(n) - n, n) + words.offsets[:-1][owners]
    return Windows(words.vocabulary, words.codes, starts, np.minimum(lengths, size)[owners], owners)


def occurrences(asked: Windows, postings: list[np.ndarray | None], end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, position at which it begins) of each exact occurrence in a block whose positions are below `end`.

    `postings` has the ascending positions of each term, None for one that the block lacks.
    """
    counts = np.array([0 if p is None else len(p) for p in postings], np.int64)
    firsts = np.cumsum(counts) - counts
    flow = np.concatenate([p for p in postings if p is not None] or [np.zeros(0, np.int64)])
    at = np.full(end, -1, np.int32)
    at[flow] = np.repeat(np.arange(len(counts)), counts)
    for size in np.unique(asked.sizes):
        which = np.flatnonzero(asked.sizes == size)
        terms = asked.codes[asked.starts[which][:, None] + np.arange(size)]
        held = (counts[terms] > 0).all(1)
        which, terms = which[held], terms[held]
        order = np.argsort(counts[terms], axis=1, kind="stable")
        rarest = np.take_along_axis(terms, order[:, :1], 1)[:, 0]
        ends = np.cumsum(counts[rarest])
        low = 0
        while low < len(which):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + CANDIDATES, "right")))
            n = counts[rarest[low:high]]
            own = np.repeat(np.arange(low, high), n)
            begins = flow[np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + firsts[rarest[own]]] - order[own, 0]
            fit = (begins >= 0) & (begins + size <= end)
            own, begins = own[fit], begins[fit]
            for k in range(1, size):
                same = at[begins + order[own, k]] == terms[own, order[own, k]]
                own, begins = own[same], begins[same]
            yield which[own], begins
            low = high


def near(asked: Windows, postings: list[np.ndarray | None], starts: np.ndarray, lengths: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, position at which it begins, document) of each match in which every term stands in one document, up to `slop` words from its place relative to the window's rarest term."""
    for w, (start, size) in enumerate(zip(asked.starts, asked.sizes, strict=True)):
        found = [postings[c] for c in asked.codes[start : start + size]]
        if any(p is None for p in found):
            continue
        order = sorted(range(size), key=lambda i: (len(found[i]), i))
        docs = np.searchsorted(starts, found[order[0]], "right") - 1
        begins = found[order[0]] - order[0]
        for i in order[1:]:
            least = np.maximum(begins + (i - slop), starts[docs])
            most = np.minimum(begins + (i + slop), starts[docs] + lengths[docs] - 1)
            at = np.minimum(np.searchsorted(found[i], least), len(found[i]) - 1)
            fit = (found[i][at] >= least) & (found[i][at] <= most)
            begins, docs = begins[fit], docs[fit]
        yield np.full(len(begins), w), begins, docs


def _search(asked: Windows, ids: list[str], slop: int):
    def block(rows: pd.DataFrame) -> pd.DataFrame:
        docs = rows[rows.term.isna()].iloc[0]
        held = rows[rows.term.notna()]
        starts, lengths = np.asarray(docs.starts, np.int64), np.asarray(docs.lengths, np.int64)
        postings: list[np.ndarray | None] = [None] * len(asked.terms)
        places = pc.index_in(pa.array(held.term, pa.large_string()).cast(pa.large_binary()), asked.terms)
        for c, p in zip(places.to_pylist(), held.positions, strict=True):
            if c is not None:
                postings[c] = p.astype(np.int64)
        end = int(starts[-1] + lengths[-1] + GAP) if len(starts) else 0
        hits: dict[int, set[int]] = {}
        items: dict[int, set[str]] = {}
        exact = ((w, begins, np.searchsorted(starts, begins, "right") - 1) for w, begins in occurrences(asked, postings, end))
        for found, begins, owners in near(asked, postings, starts, lengths, slop) if slop else exact:
            for w, p, d in zip(found.tolist(), begins.tolist(), owners.tolist(), strict=True):
                first = p - int(starts[d])
                hits.setdefault(d, set()).update(range(max(first, 0), min(first + int(asked.sizes[w]), int(lengths[d]))))
                items.setdefault(d, set()).add(ids[asked.owners[w]])
        n = len(starts)
        return pd.DataFrame(
            {
                "block": rows.block.iloc[0],
                "ord": np.arange(n, dtype=np.int32),
                "doc_id": pd.Series([None if x is None or x != x else x for x in docs.doc_ids], dtype=object),
                "n_words": lengths,
                "hits": [sorted(hits.get(d, ())) for d in range(n)],
                "items": [sorted(items.get(d, ())) for d in range(n)],
            }
        )

    return block


def search(index: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = 10, slop: int = 0) -> DataFrame:
    """Every occurrence of every item's windows in the indexed texts.

    One row for each document: block and ord (its place in the index), doc_id, n_words, hits (its word positions inside any
    occurrence) and items (ids, as strings, of the items with occurring windows). slop 0 matches exact phrases; up to GAP,
    terms may stand that far from their places. Items with null text or no words match nothing; a null id reads "null".
    The items are taken in passes of about ITEM_BYTES, so a test suite of any size is looked up whole; a pass's words are what
    is broadcast.
    """
    if not 0 <= slop <= GAP:
        raise ValueError(f"slop must be from 0 to {GAP}")
    items = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(text).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = 1 + total // ITEM_BYTES
    ids = index.schema["doc_ids"].dataType.elementType.simpleString()
    found = None
    for k in range(passes):
        rows = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k).toArrow().combine_chunks()
        asked = windows(rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string()), window)
        needed = index.sparkSession.createDataFrame(pd.DataFrame({"term": asked.terms.cast(pa.binary()).cast(pa.string()).to_pylist()}, dtype=object), "term string")
        lists_ = index.filter(F.col("term").isNotNull()).join(F.broadcast(needed), "term", "left_semi").select(*index.columns)
        part = lists_.unionByName(index.filter(F.col("term").isNull())).groupBy("block")
        part = part.applyInPandas(_search(asked, rows.column("item").to_pylist(), slop), f"block string, ord int, doc_id {ids}, n_words long, hits array<int>, items array<string>")
        found = part if found is None else found.unionByName(part)
    if passes == 1:
        return found
    return found.groupBy("block", "ord").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for each row of `search`."""
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The rows of `docs` in whose text no test window occurs.

    Ids play no part: of rows that share an id, or have none, each stays or goes by its own text; repeated rows go alike; null
    and empty texts stay; all columns are carried along, whatever their names. The texts to drop are known by a digest, which
    is broadcast only while they are few; beyond that the rows are joined by it.
    """
    digest = F.unhex(F.md5(F.col("text")))
    hit = durable(search(build_index(docs, digest), items, window=window).filter(F.size("hits") > 0).select(F.col("doc_id").alias("digest")).distinct(), "contaminated")
    few = hit.count() <= 1_000_000
    hit = hit.select(F.col("digest").alias("contaminated digest"))
    return docs.join(F.broadcast(hit) if few else hit, F.unhex(F.md5(docs["text"])) == hit["contaminated digest"], "left_anti")
