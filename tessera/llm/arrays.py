"""Vectorised text primitives over Arrow string columns.

A batch of texts is one byte buffer with offsets.  Words, n-grams and byte
windows are hashed with a polynomial hash read off prefix sums, so that every
step is a whole-array operation; nothing loops over characters or words.

Hashes have 64 bits.  Equal inputs always hash alike, on every executor; two
different inputs collide with probability about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 2**64)
CHUNK = 1 << 18
BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=U)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words are runs of bytes outside 0x20 and 0x09-0x0D.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: Words are runs of digits, lower-case ASCII letters and non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_powers = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def xxhash64(*columns: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of long columns without nulls (fixed values: the hash's five primes and Spark's seed)."""
    p1, p2, p3, p4, p5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    h = np.full(len(columns[0]), 42, U)
    for c in columns:
        x = c.astype(np.int64, copy=False).view(U) * p2
        h = (h + p5 + U(8)) ^ ((x << U(31) | x >> U(33)) * p1)
        h = (h << U(27) | h >> U(37)) * p1 + p4
        h = (h ^ h >> U(33)) * p2
        h = (h ^ h >> U(29)) * p3
        h = h ^ h >> U(32)
    return h.view(np.int64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        for i, b in enumerate((BASE, UNBASE)):
            p = np.full(size, b, U)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers[0][:n], _powers[1][:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null is an empty text."""
    column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return buf, at - at[0]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts, about ``limit`` bytes each."""
    buf, at = utf8(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j, buf[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def prefix(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(S, inverse powers): the hash of buf[s:e] is (S[e] - S[s]) * inverse[s]."""
    p, inverse = powers(len(buf) + 1)
    s = np.zeros(len(buf) + 1, U)
    np.cumsum(BYTE[buf] * p[:-1], out=s[1:])
    return s, inverse


@dataclass
class Words:
    """Words of a run of texts in order: byte spans, text index, hash; first[i] is the first word of text i."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def words(buf: np.ndarray, at: np.ndarray, kind: np.ndarray, lower: bool) -> Words:
    if lower:
        buf = LOWER[buf]
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = kind[buf]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < len(buf))]
    begins[cut] = inside[cut + 1]
    ends[cut - 1] = inside[cut]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    s, inverse = prefix(buf)
    first = np.searchsorted(start, at)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    return Words(start, end, doc, mix((s[end] - s[start]) * inverse[start]), first)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values (also across texts: mask those with ``within``)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    g = np.zeros(n, U)
    for j in range(k):
        g *= U(BASE)
        g += h[j : n + j]
    return mix(g)


def within(doc: np.ndarray, k: int) -> np.ndarray:
    """Whether the k values from each place on belong to one text."""
    n = len(doc) - k + 1
    return doc[:n] == doc[k - 1 :] if n > 0 else np.zeros(0, bool)


def least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[w - have : w - have + n])


def runs(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.concatenate(([False], same, [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... counts[0] of them, then those of starts[1] and so on."""
    total = int(counts.sum())
    out = np.ones(total, np.int64)
    live = counts > 0
    starts, counts = starts[live], counts[live]
    if not total:
        return out
    out[0] = starts[0]
    ends = np.cumsum(counts)[:-1]
    out[ends] = starts[1:] - starts[:-1] - counts[:-1] + 1
    return np.cumsum(out)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask over n places of those in any interval [start, end)."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    return np.cumsum(depth[:-1]) > 0


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
