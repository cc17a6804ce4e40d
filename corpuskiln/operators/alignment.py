"""Alignment of two forms line by line, and what one has filled in, dropped and edited of the other.

Lines that stand once in either form are anchors. The longest chain of anchors that ascend in both forms holds; between two of
its anchors lies a gap, and every gap is aligned for itself, by its longest common blocks. Gaps with lines of one form only
need no comparison.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskiln.functions.predicates import bare


def paired(source: DataFrame, target: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, a_lines and b_lines: the lines of each form, in order, in one row; each form's lines are shuffled once, by key.

    source and target: key, pos (from 0, without gaps) and line; a null line is an empty one. The lines of a form that is
    missing are null; null keys are left out.
    """

    def gathered(df: DataFrame, s: str) -> DataFrame:
        rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col("pos").cast("int").alias("pos"), F.coalesce("line", F.lit("")).alias("line"))
        lists = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
        return lists.select("key", F.transform("lines", lambda x: x["line"]).alias(f"{s}_lines"))

    return gathered(source, "a").join(gathered(target, "b"), "key", "full_outer")


def longest_chain(places: list[int]) -> list[int]:
    """Which elements make a longest ascending chain; of several the one whose ends are least."""
    tails: list[int] = []
    last: list[int] = []
    before = [-1] * len(places)
    for i, b in enumerate(places):
        n = bisect_left(tails, b)
        if n == len(tails):
            tails.append(b)
            last.append(i)
        else:
            tails[n], last[n] = b, i
        before[i] = last[n - 1] if n else -1
    chain, i = [], last[-1] if last else -1
    while i >= 0:
        chain.append(i)
        i = before[i]
    return chain[::-1]


def held_anchors(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Where the anchors that hold stand in either form."""
    seen, other = Counter(a), Counter(b)
    place = {y: k for k, y in enumerate(b) if other[y] == 1}
    found = [(i, place[x]) for i, x in enumerate(a) if seen[x] == 1 and x in place]
    return [found[n] for n in longest_chain([k for _, k in found])]


def aligned(a: list[str], b: list[str]) -> list[tuple[str, int, int, int, int]]:
    """What turns one form into the other: anchors, and the blocks of the gaps between them."""
    out, i, k = [], 0, 0
    for j, m in [*held_anchors(a, b), (len(a), len(b))]:
        out += [(tag, i + p, i + q, k + r, k + s) for tag, p, q, r, s in SequenceMatcher(None, a[i:j], b[k:m], autojunk=False).get_opcodes()]
        out += [("equal", j, j + 1, m, m + 1)] * (j < len(a) and m < len(b))
        i, k = j + 1, m + 1
    return out


def _of_lines(made: Callable[[list[str], list[str]], list[tuple]], fields: dict[str, pa.DataType]) -> Column:
    """What `made` gives for a row's two forms, one pair of forms at a time."""
    kind = pa.list_(pa.struct(list(fields.items())))
    names = {pa.string(): "string", pa.int32(): "int"}

    @F.arrow_udf(f"array<struct<{','.join(f'{n}:{names[t]}' for n, t in fields.items())}>>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(fields, o, strict=True)) for o in made(x.as_py() or [], y.as_py() or [])] for x, y in zip(a, b, strict=True)], kind)

    return run("a_lines", "b_lines")


def anchors(source: DataFrame, target: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, a and b: where the lines stand that either form has once, and that keep their order."""
    held = _of_lines(held_anchors, {"a": pa.int32(), "b": pa.int32()})
    return paired(source, target, key).select(F.col("key").alias(key), F.inline(held))


def _operations() -> Column:
    return _of_lines(aligned, {"tag": pa.string(), **dict.fromkeys(("a_from", "a_to", "b_from", "b_to"), pa.int32())})


def operations(source: DataFrame, target: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, tag (equal, replace, delete or insert), a_from, a_to, b_from and b_to of what turns each source into its target.

    source and target: key, pos (from 0, without gaps) and line; a null line is an empty one. Ends are exclusive. Keys on one
    side only are all deleted or inserted; a null key has no operations.
    """
    return paired(source, target, key).select(F.col("key").alias(key), F.inline(_operations()))


def form_diff(source: DataFrame, target: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, fills, drops, edits and intact: lines of a form that were blank and have a text, that had one and are blank or gone, and whose text is another.

    Only within what `operations` does not hold equal, where lines are taken in order, one with one. Texts are compared without
    white space at their ends. A form is intact without drops and edits. Every key of either side has a row.
    """
    changed = F.filter("found", lambda x: x["tag"] != "equal")

    def text(x: Column, s: str, k: Column) -> Column:
        return F.when(x[f"{s}_from"] + k < x[f"{s}_to"], bare(F.get(F.col(f"{s}_lines"), x[f"{s}_from"] + k))).otherwise("")

    def compared(x: Column) -> Column:
        longest = F.greatest(x["a_to"] - x["a_from"], x["b_to"] - x["b_from"])
        return F.transform(F.sequence(F.lit(0), longest - 1), lambda k: F.struct(text(x, "a", k).alias("was"), text(x, "b", k).alias("now")))

    rows = paired(source, target, key).withColumn("found", _operations()).select("key", F.flatten(F.transform(changed, compared)).alias("pairs"))
    count = lambda holds: F.size(F.filter("pairs", lambda x: holds(x["was"], x["now"]))).cast("long")
    fills, drops, edits = count(lambda was, now: (was == "") & (now != "")), count(lambda was, now: (was != "") & (now == "")), count(lambda was, now: (was != "") & (now != "") & (was != now))
    out = rows.select(F.col("key").alias(key), fills.alias("fills"), drops.alias("drops"), edits.alias("edits"))
    return out.withColumn("intact", (F.col("drops") == 0) & (F.col("edits") == 0))
