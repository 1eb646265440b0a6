"""Numpy helpers over the UTF-8 bytes of an Arrow batch, used inside tasks.

A batch of texts is handled as one byte array plus row offsets, cut into
chunks of a few MB so that memory follows the chunk (or one text, if that is
longer), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MULT = U64(0x9E3779B97F4A7C15)          # odd, so invertible mod 2**64
_INVERSE = U64(pow(int(_MULT), -1, 1 << 64))
_BYTE = np.random.default_rng(20240501).integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; NULL counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type)
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset:arr.offset + len(arr) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, off.astype(np.int64)


def chunks(arr: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(row slice, bytes, offsets from 0) for runs of rows of at most
    ``limit`` bytes together; a longer text is a run of its own."""
    buf, off = utf8(arr)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n)
        yield slice(i, j), buf[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (bijective)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        m = max(n + 1, 1 << 16)
        for k, base in enumerate((_MULT, _INVERSE)):
            x = np.full(m, base, U64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n + 1], _powers[1][:n + 1]


class Spans:
    """Hashes of any spans of a sequence, each from two prefix sums."""

    def __init__(self, values: np.ndarray):
        power, self._inverse = _power(len(values))
        self._sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * power[:-1], out=self._sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self._sums[end] - self._sums[start]) * self._inverse[start]
        return mix(h + (np.asarray(end) - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def byte_spans(buf: np.ndarray) -> Spans:
    return Spans(_BYTE[buf])


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, per-row bounds) of the maximal runs of True that do not
    cross row offsets; row r has runs bounds[r]:bounds[r+1]."""
    n = len(inside)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = off[:-1][off[:-1] < n]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = off[1:][off[1:] > off[:-1]] - 1
    last[cut] = inside[cut]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, off)


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes other than ASCII white space."""
    return runs(~SPACE[buf], off)


def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each bounds[r]:bounds[r+1]."""
    kind = np.float64 if values.dtype.kind == "f" else np.int64
    total = np.zeros(len(values) + 1, kind)
    np.cumsum(values, out=total[1:], dtype=kind)
    return total[bounds[1:]] - total[bounds[:-1]]


class HashIndex:
    """Open-addressing table from distinct 64-bit keys to their positions."""

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        bits = max(4, int(3 * n).bit_length())
        self._mask = (1 << bits) - 1
        self._shift = U64(64 - bits)
        self._key = np.zeros(1 << bits, U64)
        self._at = np.full(1 << bits, -1, np.int32)
        todo, slot = np.arange(n), self._slot(keys)
        while len(todo):
            s = slot[todo]
            free = self._at[s] < 0
            self._at[s[free]] = todo[free]
            done = self._at[s] == todo
            todo = todo[~done]
            slot[todo] = (slot[todo] + 1) & self._mask
        full = self._at >= 0
        self._key[full] = keys[self._at[full]]

    def _slot(self, keys):
        return ((keys * _MULT) >> self._shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 where absent."""
        slot = self._slot(keys)
        at = self._at[slot]
        todo = np.flatnonzero((at >= 0) & (self._key[slot] != keys))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & self._mask
            got = self._at[slot]
            at[todo] = got
            again = (got >= 0) & (self._key[slot] != keys[todo])
            todo, slot = todo[again], slot[again]
        return at
