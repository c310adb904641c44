"""Texts of an Arrow batch as flat byte arrays, so that numpy works on many documents at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time, few enough for what is made of them to stay in a processor's cache; a longer text
#: is a block of its own.
BLOCK = 1 << 17

_M = (1 << 64) - 1


def _mixed(i: int) -> int:
    """splitmix64 of a counter."""
    z = (i + 1) * 0x9E3779B97F4A7C15 & _M
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & _M
    z = (z ^ z >> 27) * 0x94D049BB133111EB & _M
    return z ^ z >> 31


#: A random-looking 64-bit value for each byte, and the base of the polynomial hash with its inverse.
BYTE = np.array([_mixed(i) for i in range(256)], dtype=np.uint64)
BASE = _mixed(1000) | 1
INVERSE = pow(BASE, -1, 1 << 64)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64, kept for the usual block size."""
    size = BLOCK + 4096
    while size < n:
        size *= 2
    return _powers(base, size)[:n] if size <= 32 * BLOCK else np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column end to end, and where each text starts (one more entry than rows). Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64, n + 1, column.offset * 8)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of at most ``size`` bytes or of one row."""
    flat, at = utf8(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, j, flat[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a block: start, end (byte positions), doc (row in the block)."""

    def __init__(self, flat: np.ndarray, at: np.ndarray):
        self.flat, self.at, self.rows = flat, at, len(at) - 1
        n = len(flat)
        solid = np.empty(n + 1, dtype=bool)
        solid[:n] = ~SPACE[flat]
        solid[n] = False
        first = np.zeros(n + 1, dtype=bool)
        first[at] = True  # a text's end ends its last word
        before = np.empty(n + 1, dtype=bool)
        before[0] = False
        before[1:] = solid[:n]
        self.start = np.flatnonzero(solid & (first | ~before))
        self.end = np.flatnonzero(before & (first | ~solid))
        self.bounds = np.searchsorted(self.start, at)  # where each row's words start
        self.counts = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(self.rows), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, wherever the word stands."""
        return run_hashes(self.flat, self.start, self.end)

    def ids(self) -> np.ndarray:
        """A number for each word of the block: equal for equal words only."""
        return run_ids(self.flat, self.start, self.end, self.hashes())


def run_hashes(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes from each start to its end."""
    n = len(flat)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE[flat] * powers(BASE, n), out=total[1:], dtype=np.uint64)
    h = (total[end] - total[start]) * powers(INVERSE, n + 1)[start]
    return mix(h + (end - start).astype(np.uint64))


#: By how many bytes of a 64-bit value count, the mask that keeps them.
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


def same_runs(flat: np.ndarray, start: np.ndarray, size: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes from each ``start`` are those from its ``other``, by the bytes themselves."""
    raw = flat.tobytes() + bytes(8)
    eight = np.ndarray((len(flat) + 1,), "<u8", raw, 0, (1,))
    out = np.ones(len(start), dtype=bool)
    left = np.flatnonzero(size > 0)
    for k in range(0, 64, 8):
        if not len(left):
            return out
        keep = _KEEP[np.minimum(size[left] - k, 8)]
        out[left] &= (eight[start[left] + k] ^ eight[other[left] + k]) & keep == 0
        left = left[(size[left] > k + 8) & out[left]]
    for i in left.tolist():  # long runs, of which a block holds few
        a, b, n = int(start[i]), int(other[i]), int(size[i])
        out[i] = raw[a : a + n] == raw[b : b + n]
    return out


def run_ids(flat: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A number for each run of bytes, equal for equal runs only: by their hashes ``h``, then held against the bytes."""
    _, first, ids = np.unique(h, return_index=True, return_inverse=True)
    model, size = first[ids], end - start
    again = np.flatnonzero(model != np.arange(len(model)))
    alike = size[again] == size[model[again]]
    if alike.all() and same_runs(flat, start[again], size[again], start[model[again]]).all():
        return ids
    raw, known = flat.tobytes(), {}  # different bytes with one hash: count by the bytes
    return np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(start.tolist(), end.tolist())], dtype=np.int64)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]]; empty runs give 0. Runs must be in order and touch."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.int64 if values.dtype.kind in "biu" else np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
