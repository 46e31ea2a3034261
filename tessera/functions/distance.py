"""Edit distances: Spark's own, and Arrow-batched ones for what it lacks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Symbols of a cost table, in the order of its rows and columns: four bases and the gap (fixed values).
SYMBOLS = "ACTG-"
CODE = np.full(256, 255, np.uint8)
for _i, _c in enumerate(SYMBOLS):
    CODE[ord(_c)] = CODE[ord(_c.lower())] = _i
CODE[ord("_")] = 4
UNIT = tuple(int(x != y) for x in range(5) for y in range(5))
#: Of a sequence's symbols that are no base: it equals nothing, not even itself.
UNKNOWN = 5


def codes(seqs: list[str]) -> list[np.ndarray]:
    """Codes 0 to 3 of the bases, without regard to case, and UNKNOWN; one for each character."""
    return [np.minimum(x, UNKNOWN) + (x == 4) for x in (CODE[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)] for s in seqs)]


def square(costs: tuple[int, ...]) -> np.ndarray:
    """A cost table with a row and a column for UNKNOWN, which costs as much as the dearest change, insertion or deletion."""
    c = np.zeros((6, 6), np.int32)
    c[:5, :5] = np.array(costs, np.int32).reshape(5, 5)
    c[5, :4] = c[:4, 5] = c[5, 5] = c[:4, :4].max()
    c[5, 4], c[4, 5] = c[:4, 4].max(), c[4, :4].max()
    return c


def table(triples: str) -> tuple[int, ...]:
    """A cost table from white-space separated ``x y cost`` triples; pairs that are not given cost 0.  An unknown symbol is an error."""
    out, words = [0] * 25, triples.split()
    for x, y, cost in zip(words[::3], words[1::3], words[2::3], strict=False):
        a, b = (int(CODE[ord(c)]) if len(c) == 1 and ord(c) < 256 else 255 for c in (x, y))
        if 255 in (a, b):
            raise ValueError(f"unknown symbol in cost {x} {y} {cost}")
        out[5 * a + b] = int(cost)
    return tuple(out)


def aligned(b: np.ndarray, r: np.ndarray, costs: tuple[int, ...], prefix: bool) -> np.ndarray:
    """Weighted distance of each row of b (barcodes) and r (reads), all of one length each; ``prefix``: the least over the last row and column."""
    c = square(costs)
    n, width = r.shape[1], b.shape[1]
    row = np.zeros((len(b), width + 1), np.int32)
    for j in range(width):
        row[:, j + 1] = row[:, j] + c[b[:, j], 4]
    best = np.full(len(b), np.iinfo(np.int32).max)
    for i in range(n):
        new = np.empty_like(row)
        new[:, 0] = row[:, 0] + c[4, r[:, i]]
        gap = c[r[:, i], 4]
        for j in range(width):
            new[:, j + 1] = np.minimum(np.minimum(row[:, j] + c[r[:, i], b[:, j]], row[:, j + 1] + gap), new[:, j] + c[4, b[:, j]])
        row = new
        best = np.minimum(best, row[:, -1])
    return np.minimum(best, row[:, :-1].min(1)) if prefix and width else row[:, -1]


def masks(b: np.ndarray) -> np.ndarray:
    """For each symbol and row of b, a word whose highest bits tell which places have it, the last place's first; UNKNOWN is nowhere."""
    out = np.zeros((6, len(b)), np.uint64)
    for x in range(4):
        for j in range(b.shape[1]):
            out[x] |= (b[:, j] == x).astype(np.uint64) << np.uint64(64 - b.shape[1] + j)
    return out


def unit(b: np.ndarray, r: np.ndarray, prefix: bool) -> np.ndarray:
    """Unit-cost distance of each row of b and r, barcodes of at most 63 bases."""
    eq, at = masks(b), np.arange(len(b))
    return columns(lambda i: eq[r[:, i], at], (len(b),), r.shape[1], b.shape[1], prefix)


def _steps() -> tuple[np.ndarray, np.ndarray]:
    """For a byte of rises and one of falls (index rises << 8 | falls): their sum, and the least sum of the bits up to any place."""
    rise, fall = np.arange(1 << 16) >> 8, np.arange(1 << 16) & 255
    at = np.cumsum([(rise >> j & 1) - (fall >> j & 1) for j in range(8)], axis=0)
    return at[-1].astype(np.int32), at.min(0).astype(np.int32)


_SUM, _LEAST = _steps()


def columns(equal, shape: tuple[int, ...], n: int, width: int, prefix: bool) -> np.ndarray:
    """Unit-cost distances of an array of pairs; one machine word holds a column of a distance matrix as differences.

    ``equal(i)`` has the masks of the barcode places that equal read place i.  Arrays are used again, so that few of them stay in a cache.
    """
    u = np.uint64
    full = u(((1 << width) - 1) << (64 - width))
    up, down = np.full(shape, full, u), np.zeros(shape, u)
    score, best = np.full(shape, width, u), np.full(shape, 1 << 32, u)
    diag, right, left = np.empty(shape, u), np.empty(shape, u), np.empty(shape, u)
    top, one, low = u(63), u(1), u(1 << (64 - width) if width else 0)
    for i in range(n):
        e = equal(i)
        np.bitwise_and(e, up, out=diag)
        diag += up
        diag ^= up
        diag |= e
        diag |= down
        np.bitwise_and(up, diag, out=left)
        np.bitwise_or(diag, up, out=right)
        np.invert(right, out=right)
        right |= down
        score += np.right_shift(right, top, out=down)
        score -= np.right_shift(left, top, out=down)
        right <<= one
        right |= low
        left <<= one
        np.bitwise_and(right, diag, out=down)
        right |= diag
        np.invert(right, out=up)
        up |= left
        if prefix:
            np.minimum(best, score, out=best)
    if not prefix:
        return score.astype(np.int32)
    best = np.minimum(best, u(n) if width else score).astype(np.int32)
    up &= full
    down &= full
    value = np.full(shape, n, np.int32)
    for j in range((64 - width) // 8 * 8, 64, 8):
        byte = ((up >> u(j) & u(255)) << u(8) | (down >> u(j) & u(255))).astype(np.intp)
        np.minimum(best, value + _LEAST[byte], out=best)
        value += _SUM[byte]
    return best


def pairs(bs: list[np.ndarray], rs: list[np.ndarray], costs: tuple[int, ...] | None, prefix: bool) -> np.ndarray:
    """Distances of parallel lists of sequences; those with equal lengths are computed together."""
    out = np.zeros(len(bs), np.int32)
    shape = np.array([(len(b), len(r)) for b, r in zip(bs, rs, strict=True)], np.int64).reshape(-1, 2)
    for width, n in np.unique(shape, axis=0).tolist():
        k = np.flatnonzero((shape[:, 0] == width) & (shape[:, 1] == n))
        b, r = (np.array([x[i] for i in k], np.uint8).reshape(len(k), -1) for x in (bs, rs))
        if not width or not n:
            out[k] = (0 if prefix and not n else aligned(b.reshape(len(k), width), r.reshape(len(k), n), costs or UNIT, prefix))
        elif costs is None and width < 64:
            out[k] = unit(b, r, prefix)
        else:
            out[k] = aligned(b, r, costs or UNIT, prefix)
    return out


def _udf(costs: tuple[int, ...] | None, prefix: bool):
    @F.pandas_udf("int")
    def run(b: pd.Series, r: pd.Series) -> pd.Series:
        ok = (b.notna() & r.notna()).to_numpy()
        out = np.zeros(len(b), object)
        out[~ok] = None
        out[ok] = pairs(codes(b[ok].tolist()), codes(r[ok].tolist()), costs, prefix)
        return pd.Series(out, dtype="Int32")

    return run


def levenshtein(b: Column, r: Column, bound: int | None = None) -> Column:
    """Unit costs; with a bound, the lesser of both."""
    if bound is None:
        return F.levenshtein(b, r)
    d = F.levenshtein(b, r, bound)
    return F.when(d < 0, F.lit(bound)).otherwise(d)


def sequence_levenshtein(b: Column, r: Column, bound: int | None = None) -> Column:
    """The least Levenshtein distance of b and a non-empty prefix of r, or of a proper prefix of b and r; 0 for an empty r."""
    d = _udf(None, True)(b, r)
    return d if bound is None else F.least(d, F.lit(bound))


def weighted_levenshtein(b: Column, r: Column, costs: tuple[int, ...]) -> Column:
    return _udf(tuple(costs), False)(b, r)


def weighted_sequence_levenshtein(b: Column, r: Column, costs: tuple[int, ...]) -> Column:
    return _udf(tuple(costs), True)(b, r)


#: By name; hyphens and underscores are alike.
DISTANCES = {"levenshtein": levenshtein, "sequence-levenshtein": sequence_levenshtein}


def named(name: str) -> str:
    name = name.replace("_", "-")
    if name not in DISTANCES:
        raise ValueError(f"unknown distance {name}")
    return name


def register(spark) -> None:
    """sequence_levenshtein(b, r) for SQL."""
    spark.udf.register("sequence_levenshtein", _udf(None, True))
