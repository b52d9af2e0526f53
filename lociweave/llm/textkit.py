"""Vectorised hashing over Arrow text columns: no Python object per document, word or byte.

A sequence v[0..n) gets prefix sums H[i] = sum v[j]*B^j (mod 2^64); the name of v[i:i+k) is
(H[i+k]-H[i])*B^-i, the same wherever the sequence stands. Values are 64-bit random, names are
mixed. Names only choose candidates or stand for sequences inside a group already equal by
another key, so a collision needs two coincidences.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15
_INV = pow(BASE, -1, 1 << 64)
BYTE_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CHUNK = 1 << 20
_pw = _ipw = np.ones(1, U)


def _trim() -> None:
    """Freed memory goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def trimmed(run):
    """run for mapInArrow; at a task's end its freed memory is given back. Workers serve one stage after the other, and
    what they keep of the last one's arrays counts beside the next one's."""

    def out(it):
        yield from run(it)
        _trim()

    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pw, _ipw
    if len(_pw) < n:
        size = max(n, CHUNK + 1)
        made = []
        for b in (BASE, _INV):
            x = np.full(size, U(b))
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        _pw, _ipw = made
    return _pw, _ipw


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


class Prefix:
    def __init__(self, values: np.ndarray):
        n = len(values)
        self.pw, self.ipw = powers(n + 1)
        self.h = np.zeros(n + 1, U)
        np.cumsum(values * self.pw[:n], out=self.h[1:])
        self.n = n

    def windows(self, k: int) -> np.ndarray:
        """The name of each v[i:i+k); empty if there are fewer than k values."""
        if self.n < k:
            return np.zeros(0, U)
        x = self.h[k:] - self.h[: self.n + 1 - k]
        x *= self.ipw[: len(x)]
        return mix(x)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.h[end] - self.h[start]) * self.ipw[start])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of documents [i, j) of about `size` bytes together, one at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACES, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, doc) of each maximal run of other bytes; runs end with their document.

    data is what offsets point into, offsets[0] being the first byte of the first document."""
    base, n = int(offsets[0]), int(offsets[-1] - offsets[0])
    inside = np.zeros(n + 2, np.int8)
    inside[1 : n + 1] = ~separator[data[base : base + n]]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cuts = offsets[1:-1] - base
    cuts = cuts[(cuts > 0) & (cuts < n)]
    cuts = np.unique(cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)])
    if len(cuts):
        start, end = np.sort(np.concatenate([start, cuts])), np.sort(np.concatenate([end, cuts]))
    doc = np.searchsorted(offsets - base, start, side="right") - 1
    return start, end, doc


#: A random value for each byte at each of the first places of a word.
PLACES = 64
_PLACED = np.random.default_rng(20240301).integers(0, 1 << 63, PLACES * 256, dtype=np.uint64) * U(2) + U(1)


def word_names(data: np.ndarray, offsets: np.ndarray, lower: bool = False, separator: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, start, end, doc) of each word: the mixed sum of random values of its bytes at their places, which no
    pattern of letters cancels, however long the word."""
    start, end, doc = words(data, offsets, separator)
    size = end - start
    at = runs(size)
    part = data[int(offsets[0]) : int(offsets[-1])][np.repeat(start, size) + at]
    part = (LOWER[part] if lower else part).astype(np.int64)
    value = _PLACED[(np.minimum(at, PLACES - 1) << 8) | part]
    far = np.flatnonzero(at >= PLACES)
    if len(far):
        value[far] = mix((at[far].astype(U) << U(8) | part[far].astype(U)) ^ U(0x8EBC6AF09C88C6E3))
    total = np.zeros(len(value) + 1, U)
    np.cumsum(value, out=total[1:])
    first = np.cumsum(size) - size
    return mix(total[first + size] - total[first] + size.astype(U)), start, end, doc


def slide(x: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """op over each x[i:i+w), in about log2(w) passes."""
    out, c = x, 1
    while c * 2 <= w:
        out = op(out[:-c], out[c:])
        c *= 2
    if c < w:
        n = len(x) - w + 1
        out = op(out[:n], out[w - c : w - c + n])
    return out


def runs(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after another."""
    total = int(counts.sum())
    first = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(first, counts)
