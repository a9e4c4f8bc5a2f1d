"""Words and rolling hashes of whole texts, vectorised over Arrow's UTF-8 buffers.

A column of texts is one byte array plus offsets, so nothing here makes a Python
string per word.  Separators are ASCII, hence byte tables split code points right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
_M1, _M2, _GOLD = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)
FOLDED_CODES = BYTE_CODES.copy()
FOLDED_CODES[65:91] = BYTE_CODES[97:123]

#: Separators of the two word rules: white space, and everything but digits, letters and non-ASCII.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True
NOT_WORD = np.ones(256, bool)
NOT_WORD[0x30:0x3A] = NOT_WORD[0x41:0x5B] = NOT_WORD[0x61:0x7B] = NOT_WORD[0x80:] = False


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a text column; nulls are empty texts."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(ends):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def chunked(data: np.ndarray, offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``size`` bytes: first, last + 1, bytes, offsets."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches in runs of ``rows`` rows; afterwards Arrow's free memory goes back to the system, as workers live on."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
    pa.default_memory_pool().release_unused()


class Words:
    """Word bounds of a chunk: ``starts``, ``ends`` in bytes; ``first[d]:first[d + 1]`` are text d's words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray):
        inside = ~separators[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1] | edge[1:-1]
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        self.data, self.inside = data, inside
        self.starts, self.ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def hashes(self, codes: np.ndarray = BYTE_CODES) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lengths = self.ends - self.starts
        at = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
        powers = np.cumprod(np.full(int(lengths.max()), _STEP, np.uint64))
        return mix(np.add.reduceat(codes[self.data[self.inside]] * powers[place], at))

    def texts(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hashes of its two parts."""
    return mix(a * _STEP + (b ^ (b >> np.uint64(29))) * _GOLD + _M2)


def grams(words: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """Hashes of all runs of each length, by doubling; entry s covers words s to s + n - 1."""
    made = {1: words}

    def of(n: int) -> np.ndarray:
        if n not in made:
            half = n // 2
            left = of(n - half)
            right = of(half)
            m = max(0, len(words) - n + 1)
            made[n] = joined(left[:m], right[n - half : n - half + m])
        return made[n]

    return {n: of(n) for n in lengths}


def run_starts(first: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a run of n words lies in one text, and its text."""
    many = np.maximum(counts - n + 1, 0)
    text = np.repeat(np.arange(len(counts)), many)
    return np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + first[text], text


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as a Spark long."""
    return x.view(np.int64)
