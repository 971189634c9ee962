"""Words, word hashes and shingles of many texts at once, as NumPy arrays over Arrow buffers.

A word is a run of characters other than space and U+0009 to U+000D.  Texts are handled as UTF-8 bytes, a megabyte
or so at a time, so memory follows the largest single text and not the batch.  Hashes are 64-bit: a polynomial over
random byte values, finished with a mixer.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C1B)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_LOWER_BYTES = _BYTES[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        grown = []
        for base in (_BASE, _INVERSE):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            grown.append(np.cumprod(table))
        if n > 8 * SLICE_BYTES:  # one huge text: do not keep its tables
            return grown[0], grown[1]
        _powers = (grown[0], grown[1])
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finisher of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """Words of the rows ``first`` .. ``first + len(counts)`` of a batch."""
    first: int
    data: np.ndarray      # bytes of the slice
    starts: np.ndarray    # first byte of each word
    ends: np.ndarray      # byte after each word
    bounds: np.ndarray    # words of row r: bounds[r] .. bounds[r + 1]
    offsets: np.ndarray   # bytes of row r: offsets[r] .. offsets[r + 1]

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1

    def hashes(self, lower: bool = False) -> np.ndarray:
        """One 64-bit hash per word; ``lower`` folds A-Z."""
        n = len(self.data)
        up, down = _power_tables(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_LOWER_BYTES if lower else _BYTES)[self.data] * up[:n], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts])


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole, at


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Words]:
    """The words of a string column, some rows at a time."""
    whole, at = string_buffers(column)
    row, rows = 0, len(at) - 1
    while row < rows:
        last = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield _split(row, whole[at[row]:at[last]], at[row:last + 1] - at[row])
        row = last


def _split(first: int, data: np.ndarray, offsets: np.ndarray) -> Words:
    word = ~_SPACE[data]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    starts[inner] = word[inner]          # rows follow each other without a separator
    begin = np.flatnonzero(starts)
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    last = inner[inner > 0] - 1
    ends[last] = word[last]
    return Words(first, data, begin, np.flatnonzero(ends) + 1, np.searchsorted(begin, offsets), offsets)


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position on; the last ``k - 1`` positions hold no full window."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= np.uint64(0xFF51AFD7ED558CCD)
        out += hashes[j:j + n]
    return mix(out)


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
