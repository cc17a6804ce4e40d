"""MinHash near-duplicate detection by a multi-index Hamming join of b-bit signatures.

A signature has `chunks * symbols` MinHash symbols of 16 bits. Two signatures at a Hamming distance of at most
`radius = chunks * (errors + 1) - 1` symbols have, by the pigeonhole principle, a chunk in which no more than `errors`
symbols differ; so each chunk is indexed under the keys that leave out each set of `errors` symbols, and every pair within
the radius shares a key. Pairs are then held against the full sets.

With the defaults (16 chunks of 6 symbols, 1 error, radius 31 of 96) a pair at a similarity of exactly 0.8 shares a key with
probability 1 - (1 - 0.8**6 - 6 * 0.8**5 * 0.2)**16, all but 4e-8, and more similar pairs still more surely.

Nothing expands a group of copies into pairs: equal sets become one class first; members of a key are tested against two
pivots, the key's smallest member and the one that meets most others over all keys, which is the text the others were made
from if it is there; then against a pivot of those not joined so far. What these tests have joined is not tested again. Only
members of a key that are still in different components are compared with each other, by signature and then by set, in
blocks of bounded size, and each pair only under the first key that it shares.

Sets are held as 64-bit hashes of their shingles. Two different shingles of a tested pair have the same hash with a probability
of about (shingles of both) ** 2 / 2 ** 64, some 1e-13 for texts of a thousand words; that is the error of a confirmed link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskiln.llm.storage import durable, quoted
from corpuskiln.llm.words import SPACED, lists, pieces, release, split_words, tidy

CHUNKS, SYMBOLS, ERRORS = 16, 6, 1
#: The signature-distance threshold that the index guarantees is its radius, 31 symbols. Pairs up to this distance that share a key are held against the
#: sets too: of pairs at a similarity of exactly 0.8, fewer than one in 10**8 is farther apart.
FARTHEST = 43
#: Members of a key that are compared at once, and the largest sets that come along for that; larger ones are joined to the pairs.
BLOCK, CARRIED = 1500, 1024
#: Ids up to this number are broadcast; more are joined.
FEW_IDS = 1_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The ascending distinct 64-bit hashes of each text's shingles of `width` words.

    A text of fewer words has its whole sequence as one shingle; one without words, or null, has none.
    """
    words = split_words(texts, SPACED)
    each = np.array([xxhash.xxh3_64_intdigest(w) for w in words.vocabulary.to_pylist()], dtype=np.uint64)
    flow = each[words.codes] if len(words.codes) else np.zeros(0, np.uint64)

    def joined(parts: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(parts[0]), len(parts), np.uint64)
        for p in parts:
            out = _mixed(out * _MIX + p)
        return out

    runs = len(flow) - width + 1
    full = joined([flow[i : i + runs] for i in range(width)]) if runs > 0 else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(words.offsets[:-1], words.offsets[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(full[a : b - width + 1]))
        else:
            out.append(joined([flow[i : i + 1] for i in range(a, b)]) if b > a else np.zeros(0, np.uint64))
    return out


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_229)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """16-bit MinHash symbols, one row of `n` for each set; rows of empty sets are zero."""
    out = np.zeros((len(sets), n), np.uint16)
    filled = [i for i, s in enumerate(sets) if len(s)]
    a, b = _multipliers(n)
    at = 0
    while at < len(filled):
        to, size = at, 0
        while to < len(filled) and (to == at or size + len(sets[filled[to]]) <= 1 << 16):
            size += len(sets[filled[to]])
            to += 1
        values = np.concatenate([sets[i] for i in filled[at:to]])
        starts = np.cumsum([0, *(len(sets[i]) for i in filled[at : to - 1])])
        scratch = np.empty_like(values)
        for k in range(n):
            np.multiply(values, a[k], out=scratch)
            scratch += b[k]
            out[filled[at:to], k] = (_mixed(np.minimum.reduceat(scratch, starts))).astype(np.uint16)
        at = to
    return out


def keys(symbols: np.ndarray, chunks: int = CHUNKS, width: int = SYMBOLS, errors: int = ERRORS) -> np.ndarray:
    """The index keys of each signature: for each chunk, one for each choice of `errors` symbols that may differ."""
    out = []
    with np.errstate(over="ignore"):
        for c in range(chunks):
            for k, held in enumerate(combinations(range(width), width - errors)):
                key = np.full(len(symbols), c * 1000 + k + 1, np.uint64)
                for i in held:
                    key = _mixed(key * _MIX + symbols[:, c * width + i])
                out.append(key)
    return np.stack(out, 1).view(np.int64)


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for docs in pieces(batch, "text"):
                    sets = shingle_sets(docs.column(1), width)
                    marks = signatures(sets, CHUNKS * SYMBOLS)
                    yield pa.RecordBatch.from_arrays(
                        [
                            docs.column(0),
                            pa.array([len(s) for s in sets], pa.int64()),
                            pa.array([hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets], pa.binary()),
                            docs.column(2),
                            pa.array([m.tobytes() if len(s) else None for s, m in zip(sets, marks, strict=True)], pa.binary()),
                        ],
                        names=["doc_id", "n_shingles", "set_key", "text_key", "signature"],
                    )
                release()

    return run


def first_shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The place among `keys` of the first that each signature in `y` shares with `x` under the defaults; -1 if none."""
    off = (y != x).reshape(len(y), CHUNKS, SYMBOLS)
    wrong = off.sum(2)
    may = wrong <= ERRORS
    chunk = may.argmax(1)
    rows = np.arange(len(y))
    # The n-th key of a chunk leaves out its n-th symbol from the end.
    left_out = np.where(wrong[rows, chunk] == 0, SYMBOLS - 1, off[rows, chunk].argmax(1))
    return np.where(may.any(1), chunk * SYMBOLS + SYMBOLS - 1 - left_out, -1)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        symbols = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
        found = keys(symbols)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), found.shape[1])),
                pa.array(found.ravel()),
                pa.array(np.tile(np.arange(found.shape[1], dtype=np.int16), batch.num_rows)),
            ],
            names=["rep", "key", "place"],
        )


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for docs in pieces(batch, "text"):
                    sets = shingle_sets(docs.column(1), width)
                    offsets = np.append(0, np.cumsum([len(s) for s in sets]))
                    yield pa.RecordBatch.from_arrays([docs.column(0), lists(pa.array(np.concatenate([np.sort(s.view(np.int64)) for s in sets])), offsets)], names=["rep", "shingles"])
                release()

    return run


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures differ in FARTHEST symbols at most; the signatures stay behind."""
    for batch in batches:
        left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("a_signature", "b_signature"))
        near = np.count_nonzero(left != right, axis=1) <= FARTHEST
        yield batch.select(["a", "b"]).filter(pa.array(near))


def _common(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many values each of the others, all ascending and not empty, shares with `one`."""
    flow = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, flow), len(one) - 1)
    return np.add.reduceat(one[at] == flow, np.cumsum([0, *map(len, others[:-1])]), dtype=np.int64)


def _blocks(rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs of one key's members, or of two of its blocks, that lie in different components and share no earlier key.

    proven: the sets came along and are similar enough; otherwise the signatures are near and the sets are still to be seen.
    """
    own = rows[rows.side == 0]
    other = rows[rows.side == 1] if (rows.side == 1).any() else own
    x, y = (np.frombuffer(b"".join(s.signature), np.uint16).reshape(len(s), -1) for s in (own, other))
    place = int(rows.place.iloc[0])
    reps, parts, sizes, sets = other.rep.to_numpy(), other.component.to_numpy(), other.n_shingles.to_numpy(), list(other.shingles)
    carried = np.array([v is not None for v in sets])
    found: list[tuple[int, np.ndarray, bool]] = []
    for i, (rep, part, size, mine) in enumerate(zip(own.rep, own.component, own.n_shingles, own.shingles, strict=True)):
        may = np.flatnonzero((parts != part) & (reps > rep if other is own else reps != rep) & (sizes * 100 >= size * 80) & (size * 100 >= sizes * 80))
        near = may[np.count_nonzero(y[may] != x[i], axis=1) <= FARTHEST]
        near = near[first_shared(x[i], y[near]) == place]
        seen = near[carried[near]] if mine is not None else near[:0]
        if len(seen):
            both = _common(np.asarray(mine), [sets[j] for j in seen])
            found.append((rep, reps[seen[100 * both >= 80 * (size + sizes[seen] - both)]], True))
        found.append((rep, reps[near[~carried[near]] if mine is not None else near], False))
    ends = np.concatenate([r for _, r, _ in found]) if found else np.zeros(0, np.int64)
    starts = np.repeat([r for r, _, _ in found], [len(r) for _, r, _ in found]).astype(np.int64)
    proven = np.repeat([p for _, _, p in found], [len(r) for _, r, _ in found]).astype(bool)
    return pd.DataFrame({"a": np.minimum(starts, ends), "b": np.maximum(starts, ends), "proven": proven})


def components(nodes_pairs: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of every node in the pairs (a, b).

    Large-star and small-star rounds, each written to the shared folder, until a round changes nothing.
    """
    pair = lambda low, high: F.struct(F.col(low).alias("low"), F.col(high).alias("high"))
    total = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
    edges = durable(nodes_pairs.filter("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct(), "edges")
    found = total(edges)
    while True:
        # A row that gives two is read once; tables joined by a merge are not sent to the driver, which would hold one of each join of each round.
        both = edges.select(F.inline(F.array(pair("low", "high"), pair("high", "low"))))
        least = both.groupBy(F.col("low").alias("node")).agg(F.min("high").alias("m")).withColumn("m", F.least("node", "m"))
        large = both.filter("high > low").withColumnRenamed("low", "node").join(least.hint("merge"), "node").select(F.col("m").alias("low"), "high").distinct()
        least = large.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("m"))
        small = large.withColumnRenamed("high", "node").join(least.hint("merge"), "node")
        edges = durable(small.select(F.inline(F.array(pair("m", "low"), pair("m", "node")))).filter("low <> high").distinct(), "edges")
        before, found = found, total(edges)
        if before == found:
            break
    return edges.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(edges.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())


def _sets_of(texts: DataFrame, classes: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """rep and shingles of the classes among `ids`, made anew from the text that stands for each; they are broadcast only while they are few."""
    wanted = classes.join(ids, "rep", "left_semi").select("rep", F.col("source.doc_id").alias("wanted"), F.col("source.text_key").alias("wanted_key"))
    few = ids.count() <= FEW_IDS
    met = texts.join(F.broadcast(wanted) if few else wanted, texts["doc_id"] == wanted["wanted"]).filter(F.unhex(F.md5(F.coalesce("text", F.lit("")))) == F.col("wanted_key"))
    # Rows that repeat an id and its text give the same set.
    return durable(met.select("rep", "text").mapInArrow(_sets(width), "rep long, shingles array<long>").dropDuplicates(["rep"]), "sets")


def near_duplicates(docs: DataFrame, width: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of `docs`.

    Documents with a Jaccard similarity of 0.8 or more over shingles of `width` words are linked; component_id is the
    smallest doc_id reachable and kept marks that document's rows. Texts without words, and null texts, are linked with
    nothing. Rows that share a doc_id are one document with several texts, so whatever any of them is linked with is one
    component. Rows with a null doc_id are nobody's smallest: they take the component of an equal set, are never kept beside
    it, and stand alone (component null, kept) otherwise. Other columns are ignored; an empty table gives no rows.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    text_key = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    signed = durable(texts.withColumn("text_key", text_key).mapInArrow(_sign(width), "doc_id long, n_shingles long, set_key binary, text_key binary, signature binary"), "signatures")
    # Classes of equal sets have numbers of their own; an id may have several.
    equal = signed.filter("set_key is not null and doc_id is not null").groupBy("set_key")
    equal = equal.agg(F.min(F.struct("doc_id", "text_key")).alias("source"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"))
    classes = durable(equal.withColumn("rep", F.monotonically_increasing_id()), "classes")
    marks = classes.select("rep", "signature")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs with 100 * |intersection| >= 80 * |union| over the full sets."""
        ids = durable(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "tested")
        sets = _sets_of(texts, classes, ids, width)
        left, right = (sets.select(F.col("rep").alias(x), F.col("shingles").alias(f"{x}_set")) for x in "ab")
        common = F.size(F.array_intersect("a_set", "b_set"))
        both = F.size("a_set") + F.size("b_set")
        return pairs.join(left, "a").join(right, "b").filter(100 * common >= 80 * (both - common)).select("a", "b")

    index = marks.mapInArrow(_index, "rep long, key long, place short")
    met = durable(index.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last"), F.count("*").alias("members")).filter("members > 1"), "keys")
    shared = met.filter("members > 2").select("key", "hub", "members")
    few = shared.count() <= FEW_IDS
    members = durable(index.join(F.broadcast(shared) if few else shared, "key").distinct(), "members")
    weights = durable(members.groupBy("rep").agg(F.sum("members").alias("weight")), "weights")
    central = members.select("key", "rep").join(weights, "rep").groupBy("key").agg(F.max(F.struct("weight", "rep"))["rep"].alias("pivot"))

    def near(pairs: DataFrame) -> DataFrame:
        """The distinct pairs with near signatures."""
        left, right = (marks.select(F.col("rep").alias(x), F.col("signature").alias(f"{x}_signature")) for x in "ab")
        return pairs.filter("a <> b").distinct().join(left, "a").join(right, "b").mapInArrow(_near, "a long, b long")

    def placed(rows: DataFrame, so_far: DataFrame, node: str, name: str) -> DataFrame:
        return rows.join(so_far.select(F.col("node").alias(node), F.col("component").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))

    def apart(pairs: DataFrame, so_far: DataFrame) -> DataFrame:
        """The pairs that lie in different components."""
        return placed(placed(pairs, so_far, "a", "ca"), so_far, "b", "cb").filter("ca <> cb").select("a", "b")

    to_hub = members.select(F.col("hub").alias("a"), F.col("rep").alias("b")).unionByName(met.filter("members = 2").select(F.col("hub").alias("a"), F.col("last").alias("b")))
    to_pivot = members.select("key", "rep").join(central, "key").select(F.col("pivot").alias("a"), F.col("rep").alias("b"))
    first = durable(near(to_hub.unionByName(to_pivot)), "near")
    weighed = first.join(weights.withColumnRenamed("rep", "a"), "a", "left").withColumn("weight", F.coalesce("weight", F.lit(0)))
    best = weighed.groupBy("b").agg(F.max(F.struct("weight", "a"))["a"].alias("a")).select("a", "b")
    links = durable(confirmed(best), "linked")
    so_far = durable(components(links), "components")
    links = durable(links.unionByName(confirmed(apart(first, so_far))), "linked")
    so_far = durable(components(links), "components")

    # What each key's central component has not taken in meets a pivot of its own.
    weighty = F.struct(F.coalesce("weight", F.lit(0)).alias("weight"), "rep", "component")
    inside = durable(placed(members.select("key", "rep"), so_far, "rep", "component").join(weights, "rep"), "placed")
    tops = inside.groupBy("key").agg(F.max(weighty)["component"].alias("top"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key", "top")
    outside = inside.join(tops, "key").filter("component <> top")
    pivots = outside.groupBy("key").agg(F.max(weighty).alias("p")).select("key", F.col("p.rep").alias("a"), F.col("p.component").alias("ca"))
    second = inside.join(pivots, "key").filter("component <> ca").select("a", F.col("rep").alias("b"))
    links = durable(links.unionByName(confirmed(durable(near(second), "near"))), "linked")
    so_far = durable(components(links), "components")

    inside = placed(members.select("key", "place", "rep"), so_far, "rep", "component")
    split = inside.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members")).filter("low <> high").select("key", "members")
    rest = durable(inside.join(split, "key"), "apart")
    ids = durable(rest.select("rep").distinct().join(classes.filter(F.col("n_shingles") <= CARRIED).select("rep"), "rep"), "carried")
    sets = _sets_of(texts, classes, ids, width)
    rest = rest.join(classes.select("rep", "signature", "n_shingles").join(sets, "rep", "left"), "rep")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    dealt = rest.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "key",
        "place",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"),
        "rep",
        "component",
        "n_shingles",
        "signature",
        "shingles",
    )
    across = durable(dealt.groupBy("key", "i", "j").applyInPandas(_blocks, "a long, b long, proven boolean"), "across")
    links = links.unionByName(across.filter("proven").select("a", "b")).unionByName(confirmed(across.filter("not proven").select("a", "b")))
    several = signed.filter("set_key is not null and doc_id is not null").groupBy("doc_id").agg(F.min("set_key").alias("least"), F.max("set_key").alias("most")).filter("least <> most")
    several = durable(several.select("doc_id"), "several")
    own = signed.join(several, "doc_id").join(classes.select("set_key", "rep"), "set_key").select("doc_id", "rep").distinct()
    same = own.join(own.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").select("a", F.col("rep").alias("b"))
    found = durable(components(links.unionByName(same)), "components")

    # The least id of each component, or of the class where nothing is linked.
    by_class = classes.select("set_key", "rep", F.col("source.doc_id").alias("least")).join(found.withColumnRenamed("node", "rep"), "rep", "left")
    least = by_class.filter("component is not null").groupBy("component").agg(F.min("least").alias("component_id"))
    by_set = by_class.join(least, "component", "left").select("set_key", F.coalesce("component_id", "least").alias("component_id"))
    tidy()
    placed = signed.join(by_set, "set_key", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return placed.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5) -> DataFrame:
    """The rows of `docs` whose document is its component's smallest; rows with a null id stay, and so do all rows of a kept id.

    The ids to drop are broadcast only while they are few; beyond that the rows are joined by id.
    """
    dropped = durable(near_duplicates(docs, width).filter("not kept and doc_id is not null").select("doc_id").distinct(), "dropped")
    few = dropped.count() <= FEW_IDS
    return docs.join(F.broadcast(dropped) if few else dropped, "doc_id", "left_anti").select(*map(quoted, docs.columns))
