"""The pre-token pattern of byte-level BPE, applied to whole Arrow columns.

The pattern is `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`. Its matches tile a text, and where one begins
depends only on the classes of the characters around it:

- a run of letters, of digits or of other visible characters begins a match, a space before it included;
- a run of white space begins one, and its last character begins another if something follows;
- an apostrophe that is a run of its own, without a space before it, makes one with a contraction's letters after it.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from corpuskiln.llm.words import Words, split_runs, text_bytes

OTHER, LETTER, DIGIT, SPACE = range(4)


@cache
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.zeros(0x110000, np.uint8)
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            a, b = ord(text[m.start()]), ord(text[m.end() - 1])
            out[a : b + 1] = np.where((np.arange(a, b + 1) >= 0xD800) & (np.arange(a, b + 1) < 0xE000), out[a : b + 1], kind)
    return out


def match_starts(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a match begins at each code point, of texts that begin at `at` (the last entry is the end)."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    kind = classes()[points]
    first = np.zeros(n, bool)
    first[at[:-1][at[:-1] < n]] = True
    last = np.zeros(n, bool)
    last[:-1] = first[1:]
    last[-1] = True
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    white = kind == SPACE
    blank = points == 32
    after_blank = np.zeros(n, bool)
    after_blank[1:] = blank[:-1]
    after_blank &= ~first
    ends = np.zeros(n, bool)  # the last white character before something visible
    ends[:-1] = white[:-1] & ~white[1:]
    ends &= ~last
    starts = np.where(white, run | ends, run & ~after_blank)
    marks = np.flatnonzero((points == 39) & run & ~after_blank & ~last)
    marks = marks[kind[marks + 1] == LETTER]
    if len(marks):
        one = np.isin(points[marks + 1], [ord(c) for c in "stmd"])
        two = np.zeros(len(marks), bool)
        may = np.flatnonzero((marks + 2 < n) & ~last[marks + 1])
        pair = points[marks[may] + 1].astype(np.int64) << 21 | points[marks[may] + 2]
        two[may] = np.isin(pair, [ord(a) << 21 | ord(b) for a, b in ("re", "ve", "ll")])
        for found, width in ((marks[one], 2), (marks[two], 3)):
            starts[found + 1] = False
            to = found + width
            starts[to[to < n]] = True
    return starts


def pretokens(texts: pa.Array) -> Words:
    """The matches of every text, null as empty; the vocabulary's entries are their UTF-8 bytes."""
    data, at = text_bytes(texts)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    lead = (data & 0xC0) != 0x80
    places = np.flatnonzero(lead)
    cuts = places[match_starts(points, np.searchsorted(places, at))]
    ends = np.append(cuts, len(data)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    coded = words.dictionary_encode()
    return Words(coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), np.searchsorted(cuts, at))


def letter_words(texts: pa.Array) -> Words:
    """The runs of letters of every text, lower-cased, null as empty."""
    data, at = text_bytes(pc.utf8_lower(texts))
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    widths = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    return split_runs(data, np.repeat(classes()[points] == LETTER, widths), at)
