"""Splitting Arrow text columns into words, a few MB at a time, without a Python object for each word."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


def byte_map(separators: bytes) -> np.ndarray:
    """Per byte: A-Z lower-cased, 0 for separators, else the byte itself.

    Separators must be ASCII, so that a UTF-8 character never falls apart.
    """
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    out[np.frombuffer(separators, np.uint8)] = 0
    return out


#: Words of digits, ASCII letters and every character beyond ASCII.
ALNUM = byte_map(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: Words between ASCII white space.
SPACED = byte_map(bytes([0x20, *range(0x09, 0x0E)]))


@dataclass
class Words:
    """The words of some texts: `vocabulary[codes[i]]` is word i; those of text d are offsets[d] to offsets[d + 1]."""

    vocabulary: pa.Array
    codes: np.ndarray
    offsets: np.ndarray


@dataclass
class Lookup:
    """Terms in the order of their hashes, which are found without building anything for each call."""

    terms: pa.Array
    hashes: np.ndarray

    def places(self, words: pa.Array) -> np.ndarray:
        """Each word's place among the terms; -1 if it is not there."""
        if not len(self.hashes) or not len(words):
            return np.full(len(words), -1)
        at = np.searchsorted(self.hashes, hashes(words))
        at[at == len(self.hashes)] = 0
        same = pc.equal(self.terms.take(pa.array(at)), words).to_numpy(zero_copy_only=False)
        return np.where(same, at, -1)


def hashes(words: pa.Array) -> np.ndarray:
    """The 64-bit hash of each word, of its UTF-8 bytes."""
    # A slice at a time, so that there are never many Python objects.
    slices = (words.slice(at, 1 << 16).to_pylist() for at in range(0, len(words), 1 << 16))
    return np.concatenate([np.zeros(0, np.uint64), *(np.array([xxhash.xxh3_64_intdigest(w) for w in some], np.uint64) for some in slices)])


def lookup(terms: pa.Array) -> tuple[Lookup, np.ndarray]:
    """The look-up of distinct terms, and the place that each of its terms had. Of terms with one hash only the first is kept, and the others are not found."""
    found, first = np.unique(hashes(terms), return_index=True)
    return Lookup(terms.take(pa.array(first)), found), first


def release() -> None:
    """Gives memory that Arrow and the C library have freed back to the system, so that a worker kept for later tasks does not hold it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy() -> None:
    """On the driver, after an operator: collects what it has left behind, the handles of its tables too, and gives the memory back."""
    gc.collect()
    release()


def pieces(batch: pa.RecordBatch, column: str, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of the batch's rows with about `size` bytes of text each; a row is never cut."""
    lengths = np.nan_to_num(np.asarray(pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=float))
    ends = np.cumsum(lengths)
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All the texts' bytes in a row, and where each begins; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
    return data, at - at[0]


def split_words(texts: pa.Array, mapping: np.ndarray) -> Words:
    """The words of each text under a `byte_map`."""
    data, at = text_bytes(texts)
    mapped = mapping[data]
    return split_runs(mapped, mapped != 0, at)


def split_runs(data: np.ndarray, inside: np.ndarray, at: np.ndarray) -> Words:
    """The runs of bytes marked `inside`, of texts that begin at `at`."""
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = at[:-1][at[:-1] < len(data)]
    begins[firsts] = inside[firsts]
    starts = np.flatnonzero(begins)
    letters = data[inside]
    ends = np.append(np.flatnonzero(begins[inside]), len(letters)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(letters)])
    coded = words.dictionary_encode()
    codes = np.asarray(coded.indices.to_numpy(zero_copy_only=False), dtype=np.int32)
    return Words(coded.dictionary, codes, np.searchsorted(starts, at))


def lists(values: pa.Array, offsets: np.ndarray) -> pa.Array:
    """A list column of `values` cut at `offsets`."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)
