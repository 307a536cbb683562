"""Words and hashes of Arrow text columns, computed on whole slices with numpy.

A slice is a run of rows with at most SLICE_BYTES of text (or one longer text), so the memory of a task is
bounded by the longest text, not by the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
#: The same where words and hashes, some 50 bytes for each byte of a slice, are most of what a worker takes and then keeps.
SMALL_SLICE_BYTES = 256 << 10
#: The word pattern of every operator here, for Java and Python alike: anything but space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: What is neither an ASCII letter nor part of a character beyond ASCII.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[65:91] = NOT_LETTER[97:123] = NOT_LETTER[128:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[k] = np.cumprod(row)
    return _powers[0][:n], _powers[1][:n]


class Spans:
    """Hashes of runs of values, equal for equal runs wherever they stand."""

    def __init__(self, values: np.ndarray):
        self.down = powers(len(values) + 1)[1]
        self.total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(len(values) + 1)[0][: len(values)], out=self.total[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    """Words of some rows: byte range of each word, and first[r]:first[r + 1] as the words of row r."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def spans(self, lower: bool = False) -> Spans:
        """Hashes of byte runs."""
        return Spans(_BYTE[LOWER[self.data] if lower else self.data])

    def hashes(self, lower: bool = False) -> np.ndarray:
        return self.spans(lower).hashes(self.start, self.end)

    def grams(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Start word and hash of each run of n words that lies in one row."""
        last = np.repeat(self.first[1:], self.counts)
        at = np.arange(len(hashes))
        at = at[at + n <= last]
        return at, Spans(hashes).hashes(at, at + n)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offsets of its rows; a null counts as an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(column: pa.Array, separators: np.ndarray = _SPACE) -> Words:
    """Words of each row; separators tells which of the 256 bytes stand between words."""
    data, offsets = buffers(column)
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, offsets, none, none, np.zeros(len(offsets), np.int64))
    space = separators[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = edge[:-1].copy()
    before[1:] |= space[:-1]
    after = edge[1:].copy()
    after[:-1] |= space[1:]
    np.logical_not(space, out=space)
    start, end = np.flatnonzero(space & before), np.flatnonzero(space & after) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of each batch with at most limit bytes of text, or one row."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at, done = 0, 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at, done = to, int(sizes[to - 1])


def binary(arrays: list[bytes]) -> pa.Array:
    return pa.array(arrays, pa.binary())
