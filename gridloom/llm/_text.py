"""Vectorised text kernels over Arrow string buffers.

A batch of texts is one UTF-8 byte buffer with row bounds. Words are found and hashed for the whole buffer with
numpy, without a Python object per word. Hashes are 64 bits wide: a byte-table polynomial over 2**64, then mixed.
"""

from __future__ import annotations

import ctypes
import ctypes.util

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on unsigned 64-bit values."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def _lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = _lower_table()

#: Words of [^\x20\x09-\x0D]+
BLANK_WORD = np.ones(256, dtype=bool)
BLANK_WORD[[0x20, 9, 10, 11, 12, 13]] = False

#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased
ALNUM_WORD = np.zeros(256, dtype=bool)
ALNUM_WORD[0x30:0x3A] = True
ALNUM_WORD[0x41:0x5B] = True
ALNUM_WORD[0x61:0x7B] = True
ALNUM_WORD[0x80:] = True


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row bounds (n + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, bounds


_libc = ctypes.CDLL(ctypes.util.find_library("c")) if ctypes.util.find_library("c") else None


def release() -> None:
    """Give free memory back to the system: workers live on, and what one batch needed would count for good."""
    pa.default_memory_pool().release_unused()
    if _libc is not None and hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def pieces(bounds: np.ndarray, target: int = CHUNK_BYTES):
    """Row ranges (lo, hi) of about target bytes each; a longer row stands alone. Memory is released at the end."""
    n, lo = len(bounds) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(bounds, bounds[lo] + target, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi
    release()


class Words:
    """Words of the rows lo..hi of a buffer: byte starts and ends, hashes, and the word range of each row."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, word: np.ndarray):
        base, stop = int(bounds[0]), int(bounds[-1])
        buf = data[base:stop]
        at = (bounds - base).astype(np.int64)
        n = len(buf)
        inside = word[buf]
        edge = np.zeros(n + 1, dtype=bool)
        edge[at] = True
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | edge[1:-1]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | edge[1:-1]
        self.bytes = buf
        self.row_bytes = at
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, at)
        total = np.zeros(n + 1, dtype=U64)
        np.cumsum(_BYTE_CODE[LOWER[buf]] * _power(_BASE, n), out=total[1:])
        h = (total[self.ends] - total[self.starts]) * _power(_BASE_INV, n)[self.starts] if n else np.zeros(0, U64)
        self.hash = mix(h + (self.ends - self.starts).astype(U64) * U64(0xA0761D6478BD642F))
        self._sums: np.ndarray | None = None

    def sums(self) -> np.ndarray:
        if self._sums is None:
            s = np.zeros(len(self.hash) + 1, dtype=U64)
            np.cumsum(self.hash * _power(_BASE, len(self.hash)), out=s[1:])
            self._sums = s
        return self._sums

    def window(self, starts: np.ndarray, k) -> np.ndarray:
        """Hashes of the k words from each start on (k: a number or one for each start)."""
        s = self.sums()
        if not len(starts):
            return np.zeros(0, U64)
        h = (s[starts + k] - s[starts]) * _power(_BASE_INV, len(self.hash))[starts]
        return mix(h + np.asarray(k, dtype=np.int64).astype(U64) * U64(0xE7037ED1A0B428DB))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Start words of all windows of k words that lie in one row, and the window range of each row."""
        count = np.maximum(np.diff(self.first) - (k - 1), 0)
        first = np.concatenate([[0], np.cumsum(count)])
        starts = np.arange(first[-1]) + np.repeat(self.first[:-1] - first[:-1], count)
        return starts, first


def shingle_sets(words: Words, k: int):
    """For each row the sorted distinct hashes of its k-word shingles; a shorter row is one shingle, an empty one none."""
    starts, first = words.windows(k)
    h = words.window(starts, k)
    n = np.diff(words.first)
    short = np.flatnonzero((n > 0) & (n < k))
    whole = dict(zip(short.tolist(), words.window(words.first[short], n[short]), strict=True)) if len(short) else {}
    for i in range(len(n)):
        if i in whole:
            yield np.array([whole[i]], dtype=U64)
        else:
            a, b = first[i], first[i + 1]
            s = np.sort(h[a:b])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def code_points(data: np.ndarray) -> np.ndarray:
    """Running count of code points before each byte, one longer than data."""
    out = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def gram_counts(data: np.ndarray, bounds: np.ndarray, fold: np.ndarray, orders, width: int):
    """For each row the counts of its hashed byte n-grams, as a dense vector."""
    base = int(bounds[0])
    codes = fold[data[base : int(bounds[-1])]].astype(np.uint32)
    shift = np.uint32(32 - (width.bit_length() - 1))
    hashed, key = [], np.zeros(len(codes), dtype=np.uint32)
    for n in range(1, max(orders) + 1):
        key = (codes if n == 1 else key[: len(codes) - n + 1] * np.uint32(257) + codes[n - 1 :]).astype(np.uint32)
        hashed.append((((key + np.uint32(n * 7919)) * np.uint32(2654435761)) >> shift).astype(np.int32) if n in orders else None)
    at = bounds - base
    for i in range(len(bounds) - 1):
        a, b = int(at[i]), int(at[i + 1])
        parts = [hashed[n - 1][a : max(a, b - n + 1)] for n in orders]
        yield np.bincount(np.concatenate(parts), minlength=width)
