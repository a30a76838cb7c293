"""Words and shingles of many texts at once, as hashes in numpy arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_KIND = np.zeros(256, np.uint8)  # 1: part of a word
for _c in [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]:
    _KIND[_c] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A good 64-bit hash of each 64-bit value."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            grown = np.full(size, base, np.uint64)
            grown[0] = 1
            _powers[name] = np.cumprod(grown, dtype=np.uint64)
    return _powers["up"], _powers["down"]


@dataclass
class Words:
    """Words of texts in their order: ``hashes`` of all, ``first`` the index of each text's first word and the total at the end."""

    hashes: np.ndarray
    starts: np.ndarray  # bytes, in the whole buffer
    ends: np.ndarray
    first: np.ndarray
    data: np.ndarray  # lower-cased bytes of all texts
    offsets: np.ndarray  # of the texts in data

    def rows(self) -> np.ndarray:
        """The text that each word is of."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in one array, and where each begins; a null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - (offsets[0] if len(offsets) else 0)


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the accented letters of Latin-1 in UTF-8."""
    low = _LOWER[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    second = second[(data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)]
    low[second] += 0x20
    return low


def words(column: pa.Array) -> Words:
    """Runs of letters, digits and non-ASCII bytes in lower case; no word spans two texts. Equal words have equal hashes everywhere."""
    data, offsets = raw(column)
    low = lowered(data)
    inside = _KIND[low].astype(bool)
    n = len(low)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    hashes = mixed((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    return Words(hashes, starts, stops, np.searchsorted(starts, offsets), low, offsets)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` words in a row, for every place, across texts too; the caller drops those that cross."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    n = len(hashes) - size + 1
    total = np.full(n, np.uint64(size))
    for k in range(size):
        total = mixed(total + hashes[k : k + n])
    return total
