"""Words of many texts at once: their places and 64-bit hashes, from Arrow's buffers, without a Python object for each word.

A word is a run of bytes other than blank and the controls 9 to 13. A hash reads a word's bytes eight at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

from ledgerlake.llm.common import mix64

CHUNK = 1 << 20  #: bytes of text at once; one longer text is a chunk of its own
LONG = 256  #: words of more bytes are hashed one by one
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Words(NamedTuple):
    first: int  #: the row of the chunk's first text
    texts: int  #: how many texts the chunk has
    data: np.ndarray  #: their bytes, with at least eight more behind
    offsets: np.ndarray  #: where each text begins in data, and where the last one ends
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray  #: the text of each word, counted from the chunk's first

    def lines(self) -> np.ndarray:
        """Each word's line in its text, from 0."""
        feeds = np.flatnonzero(self.data[: self.offsets[-1]] == 10)
        before = np.searchsorted(feeds, self.offsets[:-1])
        return np.searchsorted(feeds, self.start) - before[self.text]

    def line_counts(self) -> np.ndarray:
        """The lines of each text; an empty text has one."""
        feeds = np.flatnonzero(self.data[: self.offsets[-1]] == 10)
        return np.diff(np.searchsorted(feeds, self.offsets)) + 1

    def hashes(self) -> np.ndarray:
        return hash_spans(self.data, self.start, self.end)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of data; data has eight bytes more behind the last span."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    lanes = np.lib.stride_tricks.as_strided(data[:8].view(np.uint64), shape=(len(data) - 7,), strides=(1,), writeable=False)
    size = end - start
    with np.errstate(over="ignore"):
        out = mix64((lanes[start] & _MASKS[np.minimum(size, 8)]) + size.astype(np.uint64) * _STEP)
        left = np.flatnonzero((size > 8) & (size <= LONG))
        at = 8
        while len(left):
            out[left] = mix64(out[left] * _STEP + (lanes[start[left] + at] & _MASKS[np.minimum(size[left] - at, 8)]))
            at += 8
            left = left[size[left] > at]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    return out


def tally(parts: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(value, count) of 64-bit values in many arrays, ascending."""
    counted = [np.unique(p, return_counts=True) for p in parts]
    value, n = (np.concatenate([c[k] for c in counted]) for k in (0, 1))
    order = np.argsort(value)
    value, n = value[order], n[order]
    first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]]) if len(value) else np.zeros(0, dtype=np.int64)
    return value[first], np.add.reduceat(n, first) if len(first) else n


def as_strings(column: pa.Array) -> pa.Array:
    """The column as large strings, null as empty."""
    return column.cast(pa.large_string()).fill_null("")


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[Words]:
    """The words of a column of texts (null counts as empty), a bounded number of bytes at a time, whole texts only."""
    column = as_strings(column)
    n = len(column)
    if not n:
        return
    raw = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None and raw[-1] > raw[0] else np.zeros(0, dtype=np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(raw, raw[low] + most, side="right")) - 1)
        offsets = raw[low : high + 1] - raw[low]
        data = np.zeros(int(offsets[-1]) + 16, dtype=np.uint8)
        data[: offsets[-1]] = whole[raw[low] : raw[high]]
        data[offsets[-1] :] = 32
        yield _found(low, data, offsets)
        low = high


def _found(first: int, data: np.ndarray, offsets: np.ndarray) -> Words:
    n = int(offsets[-1])
    word = ~_SPACE[data[:n]]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    begins[heads] = word[heads]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    tails = offsets[1:][np.diff(offsets) > 0] - 1
    ends[tails] = word[tails]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
    return Words(first, len(offsets) - 1, data, offsets, start, end, text)
