"""Vectorised byte and word kernels that run inside Spark tasks.

A batch of texts is one byte buffer plus offsets (Arrow's own layout).  All
kernels work in blocks that fit a CPU cache, so their extra memory is a small
multiple of the batch and does not depend on the table.

Hashes are 64-bit polynomial hashes (odd multiplier, wrapping) of random byte
symbols, finished by a bijective mixer.
"""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa

BLOCK = 1 << 15
MULT = 0x9E3779B97F4A7C15
U = np.uint64

# Fixed character classes.
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


BYTE_SYMBOL = mix64(np.arange(1, 257, dtype=np.uint64) * U(0xA0761D6478BD642F))
_POW = _powers(MULT, BLOCK + 4096)
_IPOW = _powers(pow(MULT, -1, 1 << 64), BLOCK + 4096)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, at least ``n`` of each."""
    global _POW, _IPOW
    if n > len(_POW):
        _POW, _IPOW = _powers(MULT, n), _powers(pow(MULT, -1, 1 << 64), n)
    return _POW, _IPOW


def lower_ascii() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = lower_ascii()


def space_words() -> np.ndarray:
    """Bytes of words ``[^\\x20\\x09-\\x0D]+``."""
    t = np.ones(256, bool)
    t[list(ASCII_SPACE)] = False
    return t


def plain_words() -> np.ndarray:
    """Bytes of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` (after A-Z are lower-cased)."""
    t = np.zeros(256, bool)
    t[0x30:0x3A] = t[0x61:0x7B] = t[0x80:] = True
    return t


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets (n + 1, from 0) and null mask of a text column; a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    nulls = np.asarray(column.is_null().to_numpy(zero_copy_only=False), bool)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), nulls
    column = column.cast(pa.large_binary())
    if nulls.any():
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0]:off[-1]], off - off[0], nulls


def words(buf: np.ndarray, off: np.ndarray, word_bytes: np.ndarray):
    """Start, end (byte positions) of every word, and word offsets per text (n + 1)."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = word_bytes[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = off[:-1][off[:-1] < off[1:]]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = off[1:][off[:-1] < off[1:]] - 1
    last[tails] = inside[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


def span_hashes(symbols: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """Hash of ``symbols[start:end]`` for spans sorted by start (they may overlap, ends sorted too).
    ``table`` maps raw bytes to symbols block by block."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        a = start[i]
        j = max(i + 1, int(np.searchsorted(end, a + BLOCK, "right")))
        pw, ipw = powers(int(end[j - 1] - a) + 1)
        seg = symbols[a:end[j - 1]]
        if table is not None:
            seg = table[seg]
        c = np.empty(len(seg) + 1, np.uint64)
        c[0] = 0
        np.cumsum(seg * pw[:len(seg)], out=c[1:])
        s = start[i:j] - a
        out[i:j] = mix64((c[end[i:j] - a] - c[s]) * ipw[s] + (end[i:j] - start[i:j]).astype(np.uint64))
        i = j
    return out


def rolling(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``symbols[i:i + k]``."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for a in range(0, n, BLOCK):
        m = min(BLOCK, n - a)
        out[a:a + m] = _grams(symbols[a:a + m + k - 1], k)
    return out


def _grams(seg: np.ndarray, k: int) -> np.ndarray:
    pw, ipw = powers(len(seg) + 1)
    c = np.empty(len(seg) + 1, np.uint64)
    c[0] = 0
    np.cumsum(seg * pw[:len(seg)], out=c[1:])
    h = (c[k:] - c[:-k]) * ipw[:len(seg) - k + 1]
    return mix64(h)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = 1
    while n * 2 <= w:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    if n < w:
        x = np.minimum(x[:len(x) - (w - n)], x[w - n:])
    return x


def triggers(symbols: np.ndarray, window: int, k: int, table: np.ndarray | None = None) -> np.ndarray:
    """For every window of ``window`` symbols the smallest hash of its k-grams: a
    rolling-hash trigger that depends on the window's content alone, so equal
    windows carry equal triggers."""
    n = len(symbols) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for a in range(0, n, BLOCK):
        m = min(BLOCK, n - a)
        seg = symbols[a:a + m + window - 1]
        if table is not None:
            seg = table[seg]
        out[a:a + m] = sliding_min(_grams(seg, k), window - k + 1)
    return out


def valid_starts(off: np.ndarray, window: int) -> np.ndarray:
    """Mask over positions 0 .. n - window: True where the window stays in one text."""
    n = int(off[-1])
    if n < window:
        return np.zeros(0, bool)
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, np.maximum(off[:-1], off[1:] - window + 1), 1)
    np.add.at(d, off[1:], -1)
    return (np.cumsum(d[:-1]) == 0)[:n - window + 1]


def cover(flags: np.ndarray, n: int, window: int) -> np.ndarray:
    """Mask over ``n`` positions: covered by a flagged window (``flags`` over window starts)."""
    d = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(flags)
    d[at] += 1
    np.subtract.at(d, np.minimum(at + window, n), 1)
    return np.cumsum(d[:-1]) > 0


def runs(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Per text the number of maximal runs of True (runs never cross texts)."""
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    heads = off[:-1][off[:-1] < off[1:]]
    first[heads] = mask[heads]
    c = np.concatenate([[0], np.cumsum(first)])
    return c[off[1:]] - c[off[:-1]]


def release() -> None:
    """Gives a finished task's freed memory back to the system: Python workers live on between
    tasks, and idle ones would otherwise hold it beside the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass
