"""Hard-negative mining by dual-tree search over integer inner products.

Candidates lie in blocks, and each block's ball tree is stored with its vectors: label first, then by the line between
two far vectors. Anchors come in parts with a tree of their own. Where a block meets a part, pairs of nodes are
visited, the most promising first. All inner products of a pair lie within those of the centres, give or take what the radii
allow, and within the product of the largest norms. A pair of which no product can be wanted by any anchor of the node, or all
of whose products are beyond every anchor's bounds, goes at once, with the whole group of anchors; so does one in which the
labels of both sides rule all out. Pairs of leaves are scored exactly.

A first search finds each anchor's positives, its best of the same label. Each positive's score then bounds the scores of its
negatives, and a second search finds the best of other labels within those bounds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuskiln.llm.storage import durable, quoted
from corpuskiln.llm.topk import LARGEST, LOW_BITS, quantised

#: Candidates in a block, anchors in a part, and vectors in a leaf of either's tree.
BLOCK, PART, CANDIDATE_LEAF, ANCHOR_LEAF = 8192, 4096, 256, 32
#: Inner products below this are exact in floats, and so is a hundred times them.
EXACT = 2.0**45


@dataclass
class Tree:
    """A ball tree: node i holds the vectors begins[i] to ends[i], in the tree's order, within radii[i] of centres[i]; lefts[i] is -1 in a leaf, and the right child follows the left one."""

    begins: np.ndarray
    ends: np.ndarray
    lefts: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    norms: np.ndarray
    pure: np.ndarray


def plant(vectors: np.ndarray, labels: np.ndarray, leaf: int) -> tuple[np.ndarray, Tree]:
    """The tree of some vectors, and the order in which it holds them."""
    v = vectors.astype(float)
    order = np.argsort(labels, kind="stable")
    nodes: list[list] = [[0, len(v), -1]]
    at = 0
    while at < len(nodes):
        a, b, _ = nodes[at]
        if b - a > leaf:
            own, kinds = order[a:b], labels[order[a:b]]
            changes = np.flatnonzero(np.diff(kinds)) + 1
            if len(changes):
                half = int(changes[np.abs(changes - (b - a) // 2).argmin()])
            else:
                some = v[own]
                far = some[((some - some.mean(0)) ** 2).sum(1).argmax()]
                line = some[((some - far) ** 2).sum(1).argmax()] - far
                along = some @ line
                # Halfway between the two, unless that leaves one side nearly empty.
                half = int((along < (along.min() + along.max()) / 2).sum())
                half = half if (b - a) // 8 <= half <= b - a - (b - a) // 8 else (b - a) // 2
                order[a:b] = own[np.argpartition(along, half)]
            nodes[at][2] = len(nodes)
            nodes += [[a, a + half, -1], [a + half, b, -1]]
        at += 1
    begins, ends, lefts = (np.array(x, np.int32) for x in zip(*nodes, strict=True))
    centres, radii, norms, pure = np.zeros((len(nodes), v.shape[1])), np.zeros(len(nodes)), np.zeros(len(nodes)), np.zeros(len(nodes), bool)
    for i, (a, b, _) in enumerate(nodes):
        some, kinds = v[order[a:b]], labels[order[a:b]]
        if len(some):
            centres[i] = some.mean(0)
            radii[i] = math.sqrt(((some - centres[i]) ** 2).sum(1).max())
            norms[i] = math.sqrt((some**2).sum(1).max())
            pure[i] = kinds[0] == kinds[-1]
    return order, Tree(begins, ends, lefts, centres, radii, norms, pure)


@dataclass
class Side:
    """Vectors in the order of their tree."""

    tree: Tree
    vectors: np.ndarray
    labels: np.ndarray
    rows: np.ndarray
    ids: np.ndarray


def interval(a: Side, i: int, c: Side, j: int) -> tuple[float, float]:
    """Bounds of all inner products of a node of each side; wide enough for the rounding of floats."""
    x, y = a.tree, c.tree
    middle = float(x.centres[i] @ y.centres[j])
    long = math.sqrt(float(x.centres[i] @ x.centres[i])), math.sqrt(float(y.centres[j] @ y.centres[j]))
    reach = long[0] * y.radii[j] + long[1] * x.radii[i] + x.radii[i] * y.radii[j]
    most = x.norms[i] * y.norms[j]
    slack = 1e-9 * most + 1e-9
    return max(middle - reach, -most) - slack, min(middle + reach, most) + slack


@dataclass
class Wanted:
    """What is sought: target t wants the k best of its anchor (a place in the anchors' order, ascending) with low <= 100 * score <= high."""

    anchors: np.ndarray
    low: np.ndarray
    high: np.ndarray
    k: int
    same_label: bool


def _products(a: np.ndarray, c: np.ndarray, exact: bool) -> np.ndarray:
    return a.astype(float) @ c.astype(float).T if exact else a.astype(object) @ c.astype(object).T


def dual_search(a: Side, c: Side, wanted: Wanted) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(target, candidate's place, score) of what each target wants, best first, ties by ascending id; and how many pairs of leaves were scored."""
    width = min(a.vectors.shape[1], c.vectors.shape[1])
    largest = np.abs(a.vectors.astype(float)).sum(1).max(initial=0) * np.abs(c.vectors.astype(float)).max(initial=0)
    exact = bool(largest < EXACT)
    left, right = a.vectors[:, :width], c.vectors[:, :width]
    kind = float if exact else object
    low, high = wanted.low.astype(kind), wanted.high.astype(kind)
    n = len(wanted.anchors)
    kth = np.full(n, -np.inf, kind)
    found = {}
    scored = 0
    stack = [(0, 0, np.inf)] if n and len(c.vectors) else []
    while stack:
        i, j, upper = stack.pop()
        t = slice(*np.searchsorted(wanted.anchors, [a.tree.begins[i], a.tree.ends[i]]))
        # The k-th may have risen since the pair was put by.
        if t.start == t.stop or not ((100 * upper >= low[t]) & (upper >= kth[t])).any():
            continue
        if a.tree.lefts[i] < 0 and c.tree.lefts[j] < 0:
            scored += 1
            _score_leaves(a, c, i, j, t, wanted, _products(left[a.tree.begins[i] : a.tree.ends[i]], right[c.tree.begins[j] : c.tree.ends[j]], exact), low, high, kth, found)
            continue
        if c.tree.lefts[j] < 0 or (a.tree.lefts[i] >= 0 and a.tree.ends[i] - a.tree.begins[i] > c.tree.ends[j] - c.tree.begins[j]):
            below = [(a.tree.lefts[i], j), (a.tree.lefts[i] + 1, j)]
        else:
            below = [(i, c.tree.lefts[j]), (i, c.tree.lefts[j] + 1)]
        pairs = []
        for x, y in below:
            if a.tree.pure[x] and c.tree.pure[y] and (a.labels[a.tree.begins[x]] == c.labels[c.tree.begins[y]]) != wanted.same_label:
                continue
            least, most = interval(a, x, c, y)
            own = slice(*np.searchsorted(wanted.anchors, [a.tree.begins[x], a.tree.ends[x]]))
            if ((100 * most >= low[own]) & (100 * least <= high[own]) & (most >= kth[own])).any():
                pairs.append((x, y, most))
        stack += sorted(pairs, key=lambda p: p[2])
    parts = [found[i] for i in sorted(found)]
    target, place, score = (np.concatenate([p[x] for p in parts]) if parts else np.zeros(0, np.int64) for x in range(3))
    return target, place, score, scored


def _score_leaves(a: Side, c: Side, i: int, j: int, t: slice, wanted: Wanted, scores: np.ndarray, low: np.ndarray, high: np.ndarray, kth: np.ndarray, found: dict) -> None:
    """Adds the products of two leaves to what has been found, and raises the k-th scores."""
    own, others = slice(a.tree.begins[i], a.tree.ends[i]), slice(c.tree.begins[j], c.tree.ends[j])
    able = (a.labels[own, None] == c.labels[None, others]) == wanted.same_label
    able &= a.rows[own, None] != c.rows[None, others]
    which = wanted.anchors[t] - a.tree.begins[i]
    each = scores[which]
    fit = able[which] & (100 * each >= low[t, None]) & (100 * each <= high[t, None]) & (each >= kth[t, None])
    at, to = np.nonzero(fit)
    if not len(at):
        return
    new = at + t.start, to + c.tree.begins[j], each[at, to]
    old = found.get(i)
    target, place, score = new if old is None else (np.concatenate(x) for x in zip(old, new, strict=True))
    # Integers of any size are put in order by their ranks.
    rank = score if score.dtype == float else np.unique(score, return_inverse=True)[1]
    order = np.lexsort((c.ids[place], -rank, target))
    target, place, score = target[order], place[order], score[order]
    first = np.searchsorted(target, target)
    nth = np.arange(len(target)) - first
    held = nth < wanted.k
    last = nth == wanted.k - 1
    kth[target[last]] = score[last]
    found[i] = target[held], place[held], score[held]


INDEX_SCHEMA = (
    "block int, width int, rows array<long>, ids array<long>, labels array<long>, values array<long>, begins array<int>, ends array<int>, lefts array<int>, "
    "centres array<double>, radii array<double>, norms array<double>, pure array<boolean>"
)


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Rows of equal width; a shorter vector ends in zeros."""
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _plant_block(rows: pd.DataFrame) -> pd.DataFrame:
    v, labels = _matrix(rows.v), rows.label.to_numpy()
    order, t = plant(v, labels, CANDIDATE_LEAF)
    row = (int(rows.block.iloc[0]), v.shape[1], rows.row.to_numpy()[order], rows.vec_id.to_numpy()[order], labels[order], v[order].ravel())
    row += (t.begins, t.ends, t.lefts, t.centres.ravel(), t.radii, t.norms, t.pure)
    return pd.DataFrame([row], columns=[x.split(" ")[0] for x in INDEX_SCHEMA.split(", ")])


def build_index(vectors: DataFrame, blocks: int) -> DataFrame:
    """The candidates' trees (row, vec_id, label, v), a row for each block, written to the shared folder."""
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    return durable(dealt.groupBy("block").applyInPandas(_plant_block, INDEX_SCHEMA), "trees")


def _block(x: pd.Series) -> Side:
    n, width = len(x.ids), int(x.width)
    held = {k: np.asarray(x[k]) for k in ("begins", "ends", "lefts", "centres", "radii", "norms", "pure")}
    held["centres"] = held["centres"].astype(float).reshape(-1, width)
    return Side(Tree(**held), np.asarray(x["values"], np.int64).reshape(n, width), np.asarray(x.labels), np.asarray(x["rows"]), np.asarray(x.ids))


def _score(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return high.astype(object) * 2**LOW_BITS + low.astype(object)


def _meet(k: int, low: int | None, high: int | None):
    """The search of a block for the anchors of a part; without bounds, of the same label."""

    def run(key: tuple, index: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        names = ["anchor", "target", "vec_id", "high", "low"]
        if not len(index) or not len(anchors):
            return pd.DataFrame({x: [] for x in names}, dtype=np.int64)
        c, v, labels = _block(index.iloc[0]), _matrix(anchors.v), anchors.label.to_numpy()
        # Vectors of either side end in zeros where the other's are longer.
        width = max(v.shape[1], c.vectors.shape[1])
        wide = lambda x: np.pad(x, ((0, 0), (0, width - x.shape[1])))
        c.vectors, c.tree.centres = wide(c.vectors), wide(c.tree.centres)
        order, tree = plant(wide(v), labels, ANCHOR_LEAF)
        a = Side(tree, wide(v)[order], labels[order], anchors.row.to_numpy()[order], anchors.row.to_numpy()[order])
        if low is None:
            places, targets = np.arange(len(order)), np.zeros(len(order), np.int64)
            wanted = Wanted(places, np.full(len(order), -np.inf), np.full(len(order), np.inf), k, True)
        else:
            lists = anchors.targets.to_numpy()[order]
            places = np.repeat(np.arange(len(order)), [len(x) for x in lists])
            targets = np.array([t["target"] for x in lists for t in x], np.int64)
            scores = _score(np.array([t["high"] for x in lists for t in x], np.int64), np.array([t["low"] for x in lists for t in x], np.int64))
            wanted = Wanted(places, low * scores, high * scores, k, False)
        t, place, score, _ = dual_search(a, c, wanted)
        whole = np.array([max(-LARGEST, min(int(s), LARGEST)) for s in score], object)
        return pd.DataFrame({"anchor": a.rows[places[t]], "target": targets[t], "vec_id": c.ids[place], "high": whole >> LOW_BITS, "low": whole & (2**LOW_BITS - 1)}, columns=names).astype(np.int64)

    return run


def _met(index: DataFrame, anchors: DataFrame, blocks: int, parts: int, run, k: int) -> DataFrame:
    """Every block with every part; the first k of each anchor's target."""
    left = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = anchors.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(run, "anchor long, target long, vec_id long, high long, low long")
    order = W.partitionBy("anchor", "target").orderBy(F.col("high").desc(), F.col("low").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _long(high: str, low: str) -> Column:
    held = F.shiftleft(high, LOW_BITS).bitwiseOR(F.col(low))
    return F.when(F.col(high) > 1, F.lit(2**63 - 1)).when(F.col(high) < -2, F.lit(-(2**63))).otherwise(held)


def mine(vectors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, every: int = 100, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of each anchor's hard negatives.

    Anchors are the rows whose id is divisible by `every`; an anchor's positives are the best `positives` other rows of its
    label; a positive's negatives are the best `negatives` rows of other labels with low * positive_score <=
    100 * negative_score <= high * positive_score. Components become floor(scale * x), and scores are integer inner products,
    compared exactly up to 2**124 and returned at the ends of a long beyond it; equal scores go by ascending vec_id. Rows with a
    null id, label or vector, or with a null or non-finite component, take no part; shorter vectors end in zeros. Rows that
    repeat a vec_id are anchors and candidates of their own: each leaves out only itself. Other columns are ignored; an empty
    table, or one without two labels, gives no rows.
    """
    labelled = vectors.filter(quoted(label).isNotNull())
    sound = quantised(labelled, scale, vec_id, embedding, quoted(label).cast("long").alias("label"))
    sound = durable(sound.withColumn("row", F.monotonically_increasing_id()), "labelled")
    n = sound.count()
    asked = sound.filter(F.col("vec_id") % every == 0)
    blocks, parts = max(1, math.ceil(n / BLOCK)), max(1, math.ceil(asked.count() / PART))
    index = build_index(sound, blocks)
    best = durable(_met(index, asked, blocks, parts, _meet(positives, None, None), positives).drop("target").withColumnRenamed("rank", "target"), "positives")
    targets = best.groupBy("anchor").agg(F.collect_list(F.struct(F.col("target").cast("long").alias("target"), "high", "low")).alias("targets"))
    found = _met(index, asked.join(targets.withColumnRenamed("anchor", "row"), "row"), blocks, parts, _meet(negatives, low, high), negatives)
    found = found.select("anchor", F.col("target").cast("int").alias("target"), "rank", F.col("vec_id").alias("negative_id"), _long("high", "low").alias("negative_score"))
    named = best.select("anchor", "target", F.col("vec_id").alias("positive_id"), _long("high", "low").alias("positive_score"))
    ids = asked.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return found.join(named, ["anchor", "target"]).join(ids, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
