"""Token counts with a whole-token shortcut.

Offline, every vocabulary string is put through the tokenizer's merges once; those that come out as one token are proven. In a
text, pre-tokens that equal a proven string count one each; the others' merges are counted once for each distinct pre-token
of a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuskiln.llm.pretokens import pretokens
from corpuskiln.llm.words import pieces

#: Distinct pre-tokens whose counts a task remembers at once.
REMEMBERED = 1 << 20
BYTES_AT_ONCE = 8 << 20


@cache
def byte_letters() -> str:
    """The character that stands for each byte in a byte-level vocabulary: visible Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return "".join(chr(b if b in seen else next(rest)) for b in range(256))


def as_letters(token: bytes) -> str:
    """A byte string in the vocabulary's letters."""
    letters = byte_letters()
    return "".join(letters[b] for b in token)


def proven(tokenizer: Tokenizer) -> list[bytes]:
    """The vocabulary strings that the merges turn into exactly one token."""
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    out = []
    for word in tokenizer.get_vocab(with_added_tokens=False):
        if all(c in byte_of for c in word) and len(tokenizer.model.tokenize(word)) == 1:
            out.append(bytes(byte_of[c] for c in word))
    return sorted(out)


def _specials(tokenizer: Tokenizer) -> list[str]:
    """The special strings, longest first; those that the library would match in another way than as they stand are refused."""
    for t in tokenizer.get_added_tokens_decoder().values():
        if t.lstrip or t.rstrip or t.single_word:
            raise ValueError(f"special string {t.content!r} takes white space or asks for word boundaries, which is not supported")
    return sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=lambda s: (-len(s), s))


def _cut(texts: pa.Array, specials: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The texts with special strings cut out, the text that each part comes from, and each text's number of special strings."""
    n, counts = len(texts), np.zeros(len(texts), np.int64)
    held = np.zeros(n, bool)
    for s in specials:
        held |= pc.match_substring(texts.fill_null(""), s).to_numpy(zero_copy_only=False)
    if not held.any():
        return texts, np.arange(n), counts


    cut = re.compile("|".join(map(re.escape, specials)))
    parts, owners = [], []
    for i, text in enumerate(texts.to_pylist()):
        own = cut.split(text or "") if held[i] else [text]
        parts += own
        owners += [i] * len(own)
        counts[i] = len(own) - 1
    return pa.array(parts, pa.large_string()), np.array(owners), counts


def _counter(path: str, whole: list[bytes], limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer.from_file(path)
        specials, known, remembered = _specials(tokenizer), pa.array(whole, pa.large_binary()), {}
        for batch in batches:
            for docs in pieces(batch, "text", BYTES_AT_ONCE):
                texts, owners, counts = _cut(docs.column(1), specials)
                words = pretokens(texts)
                sizes = np.ones(len(words.vocabulary), np.int64)
                for i in np.flatnonzero(pc.is_null(pc.index_in(words.vocabulary, known)).to_numpy(zero_copy_only=False)):
                    word = words.vocabulary[int(i)].as_py()
                    size = remembered.get(word)
                    if size is None:
                        if len(remembered) >= REMEMBERED:
                            remembered.clear()
                        size = remembered[word] = len(tokenizer.model.tokenize(as_letters(word)))
                    sizes[i] = size
                sums = np.append(0, np.cumsum(sizes[words.codes]))
                np.add.at(counts, owners, sums[words.offsets[1:]] - sums[words.offsets[:-1]])
                n_bytes = pc.fill_null(pc.binary_length(docs.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([docs.column(0), n_bytes, pa.array(counts), pa.array(counts > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of `docs`.

    Counts are those of the tokenizers library for the file at `path` (a byte-level BPE; by default byte_bpe_50k.json) without
    added tokens; special strings inside a text count one each, as is the library's default. Null texts are empty: no bytes,
    no tokens. Rows are counted one by one, whatever their ids; other columns are ignored.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    _specials(tokenizer)
    whole = proven(tokenizer)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_counter(path, whole, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
