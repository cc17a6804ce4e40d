"""Alignment against the plain matching blocks, and cards."""

from __future__ import annotations

import random
from difflib import SequenceMatcher
from itertools import combinations

from corpuskiln.operators import alignment, tables


def frame(spark, forms):
    return spark.createDataFrame([(k, p, x) for k, xs in forms.items() for p, x in enumerate(xs)], "doc_id int, pos int, line string")


def counted(ops, a, b):
    fills = drops = edits = 0
    for tag, i, j, k, m in ops:
        if tag == "equal":
            continue
        for n in range(max(j - i, m - k)):
            was, now = (a[i + n].strip() if i + n < j else ""), (b[k + n].strip() if k + n < m else "")
            fills, drops, edits = fills + (not was and now != ""), drops + (was != "" and not now), edits + (was != "" and now != "" and was != now)
    return fills, drops, edits


def merged(ops):
    """Neighbouring operations of one kind as one, by place."""
    out = []
    for tag, i, j, k, m in sorted(ops, key=lambda x: (x[1], x[3], x[2], x[4])):
        if out and out[-1][0] == tag and out[-1][2] == i and out[-1][4] == k:
            out[-1] = (tag, out[-1][1], j, out[-1][3], m)
        else:
            out.append((tag, i, j, k, m))
    return out


def edited(rng, lines):
    out = []
    for x in lines:
        kind = rng.random()
        if kind < 0.1:
            continue
        out.append(f"{x} new" if kind < 0.2 else x)
        if kind > 0.9:
            out.append(f"added {rng.random()}")
    return out


def test_edits_of_unique_lines_equal_plain_matching_blocks(spark):
    rng = random.Random(1)
    a = {k: [f"line {k} {i}" for i in range(rng.randint(0, 40))] for k in range(60)}
    b = {k: edited(rng, xs) for k, xs in a.items()}
    a[100], b[101] = ["x"], ["y", ""]
    found = {}
    for r in alignment.operations(frame(spark, a), frame(spark, b)).collect():
        found.setdefault(r.doc_id, []).append((r.tag, r.a_from, r.a_to, r.b_from, r.b_to))
    counts = {r.doc_id: (r.fills, r.drops, r.edits) for r in alignment.form_diff(frame(spark, a), frame(spark, b)).collect()}
    for k in {*a, *b}:
        x, y = a.get(k, []), b.get(k, [])
        plain = SequenceMatcher(None, x, y, autojunk=False).get_opcodes()
        assert merged(found.get(k, [])) == plain, (x, y)
        if x or y:
            assert counts[k] == counted(plain, x, y)
    assert not counts.keys() - {k for k in {*a, *b} if a.get(k) or b.get(k)}


def test_one_inserted_line_edits_nothing_else(spark):
    a, b = {1: ["one", "", "two", "three"]}, {1: ["new", "one", "filled", "two", "three"]}
    (r,) = alignment.form_diff(frame(spark, a), frame(spark, b)).collect()
    assert (r.fills, r.drops, r.edits, r.intact) == (2, 0, 0, True)


def test_repeated_and_moved_lines_make_a_sound_alignment(spark):
    rng = random.Random(2)
    a = {k: rng.choices(["", " ", "x", "y", *(f"u{i}" for i in range(12))], k=rng.randint(0, 25)) for k in range(80)}
    b = {k: rng.sample(xs, len(xs)) if k % 4 == 0 else edited(rng, xs) for k, xs in a.items()}
    found = {}
    for r in alignment.operations(frame(spark, a), frame(spark, b)).collect():
        found.setdefault(r.doc_id, []).append((r.tag, r.a_from, r.a_to, r.b_from, r.b_to))
    for k in a:
        ops = sorted(found.get(k, []), key=lambda x: (x[1], x[3], x[2], x[4]))
        # The operations cover both forms in order, and what they call equal is.
        assert [i for _, i, j, _, _ in ops for i in range(i, j)] == list(range(len(a[k])))
        assert [i for _, _, _, i, j in ops for i in range(i, j)] == list(range(len(b[k])))
        assert all(a[k][i:j] == b[k][n:m] for tag, i, j, n, m in ops if tag == "equal")


def test_longest_chain():
    rng = random.Random(3)
    for _ in range(200):
        xs = rng.sample(range(30), rng.randint(0, 9))
        chain = alignment.longest_chain(xs)
        assert [xs[i] for i in chain] == sorted(xs[i] for i in chain) and chain == sorted(chain)
        longest = max((n for n in range(len(xs) + 1) for c in combinations(xs, n) if list(c) == sorted(c)), default=0)
        assert len(chain) == longest


def test_vertical_cards(spark):
    def grid(*rows):
        return rows

    docs = {
        "card": grid(["성명", "", "연락처"], ["홍", "x", ""], ["", "", ""]),
        "last": grid(["성명", "연락처"], ["홍", "010"]),
        "roster": grid(["성명", "연락처"], ["홍", "010"], ["김", ""]),
        "next card": grid(["성명", "연락처"], ["홍", "010"], ["주소", "성명"], ["서울", "김"]),
        "a label below": grid(["성명", "연락처"], ["전화", "010"]),
        "one cluster twice": grid(["전화", "연락처"], ["1", "2"]),
        "a value among labels": grid(["성명", "A"], ["홍", "B"]),
        "another width": grid(["성명", "연락처"], ["홍", "010", ""]),
        "one label": grid(["성명", ""], ["홍", ""]),
        "other width after": grid(["성명", "연락처"], ["홍", "010"], ["김"]),
    }
    cells = spark.createDataFrame([(d, 0, r, c, x) for d, rows in docs.items() for r, xs in enumerate(rows) for c, x in enumerate(xs)], "doc_id string, `table` int, `row` int, col int, cell string")
    synonyms = spark.createDataFrame([("성명", "성명"), ("연락처", "연락처"), ("전화", "연락처"), ("주소", "주소")], "alias string, cluster string")
    found = {}
    for r in tables.vertical_cards(cells, synonyms).orderBy("row", "col").collect():
        found.setdefault(r.doc_id, []).append((r.label, r.value))
    pair = [("성명", "홍"), ("연락처", "010")]
    assert found == {"card": [("성명", "홍")], "last": pair, "next card": [*pair, ("주소", "서울"), ("성명", "김")], "other width after": pair}
