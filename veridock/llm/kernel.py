"""Vectorised byte-level text kernel shared by the corpus operators.

Works on the UTF-8 buffers of Arrow string columns.  A *word* is a maximal run
of bytes outside ``0x20, 0x09-0x0D``; all these separators are ASCII, so byte
runs and character runs are the same thing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is handled alone.
SLICE_BYTES = 2_000_000
_HASH_BYTES = 1_000_000

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C55)
_rng = np.random.default_rng(20240229)
_BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n``."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, _HASH_BYTES + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        tables = []
        for base in (_BASE, inverse):
            t = np.full(size, base, dtype=np.uint64)
            t[0] = 1
            tables.append(np.cumprod(t, dtype=np.uint64))
        _powers[:] = tables
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and ``n + 1`` offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1, offset=8 * column.offset) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, off


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold at most ``limit`` bytes together, or one text."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


class Words:
    """Words of a range of texts: byte bounds, and per text the range of words."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, lo: int, hi: int, lower: bool = False):
        self.base = int(offsets[lo])
        self.buf = buf[self.base : int(offsets[hi])]
        if lower:
            self.buf = LOWER[self.buf]
        self.text_at = offsets[lo : hi + 1] - self.base
        inside = ~_SEPARATOR[self.buf]
        starts, ends = inside.copy(), inside.copy()
        if len(inside):
            starts[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            edges = self.text_at[1:-1]
            edges = edges[(edges > 0) & (edges < len(inside))]
            starts[edges] = inside[edges]
            ends[edges - 1] = inside[edges - 1]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        #: Text t has the words word_at[t] .. word_at[t + 1] - 1.
        self.word_at = np.searchsorted(self.start, self.text_at)
        self.n = len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.word_at)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.word_at) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return range_hashes(self.buf, self.start, self.end)


def range_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each range; ranges ascend and don't overlap."""
    n = len(start)
    out = np.empty(n, dtype=np.uint64)
    at = 0
    while at < n:
        first = int(start[at])
        to = int(np.searchsorted(end, first + _HASH_BYTES, side="right"))
        to = max(to, at + 1)
        last = int(end[to - 1])
        power, inverse = _power_tables(last - first + 1)
        sums = np.zeros(last - first + 1, dtype=np.uint64)
        np.cumsum(_BYTE_CODES[buf[first:last]] * power[: last - first], out=sums[1:])
        s, e = start[at:to] - first, end[at:to] - first
        out[at:to] = (sums[e] - sums[s]) * inverse[s]
        at = to
    return mix(out)


def rolling(values: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of ``width`` consecutive values (len - width + 1 of them)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    if width == 1:
        return mix(values ^ np.uint64(salt))
    factor = np.uint64(2 * salt + 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF)
    acc = values[:n].copy()
    for k in range(1, width):
        acc *= factor
        acc += values[k : k + n]
    return mix(acc)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` consecutive values."""
    have, cur = 1, values
    while have * 2 <= width:
        cur = np.minimum(cur[:-have], cur[have:])
        have *= 2
    rest = width - have
    return np.minimum(cur[:-rest], cur[rest:]) if rest else cur


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)
