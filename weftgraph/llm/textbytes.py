"""Vectorised reading of text columns as UTF-8 bytes: no per-word Python."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once; a longer text is handled alone.
SLICE_BYTES = 1 << 20

#: Every byte as itself, and with A-Z as a-z.
AS_IS = np.arange(256, dtype=np.uint8)
FOLDED = AS_IS.copy()
FOLDED[65:91] += 32
_SEED, _SIZED = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Of the last 8 bytes of a span those that belong to it.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer spans are hashed one by one, by BLAKE2b.
_LONG = 256
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 (a public bijection on 64-bit words)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row begins (one more for the end); null: empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw, at - at[0] if len(at) else at


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most limit bytes together (or one longer row)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal runs of mask, none of which crosses from one row to the next."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin, end = mask.copy(), mask.copy()
    begin[1:] &= ~mask[:-1]
    end[:-1] &= ~mask[1:]
    filled = offsets[:-1][np.diff(offsets) > 0]
    begin[filled] = mask[filled]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    end[last] = mask[last]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


class Spans:
    """Hashes of any spans of data: 8 bytes at a time through a permutation that isn't linear.

    Sums of powers modulo 2^64 are no choice here: some pairs of long words have the same one for every base.
    """

    def __init__(self, data: np.ndarray, as_byte: np.ndarray = FOLDED):
        self.data = np.zeros(len(data) + 8, np.uint8)
        np.take(as_byte, data, out=self.data[:-8])
        self.eights = np.ndarray(len(data) + 1, "<u8", self.data, strides=(1,))

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - begin
        h = mix(size.astype(np.uint64) * _SIZED + _SEED)
        long = np.flatnonzero(size > _LONG)
        some, at = np.flatnonzero((size > 0) & (size <= _LONG)), begin
        done = 0
        while len(some):
            block = self.eights[at[some] + done] & _MASK[np.minimum(size[some] - done, 8)]
            h[some] = mix(h[some] ^ block)
            done += 8
            some = some[size[some] > done]
        for i in long:
            h[i] = int.from_bytes(hashlib.blake2b(self.data[begin[i] : end[i]], digest_size=8).digest(), "little")
        return h
