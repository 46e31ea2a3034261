"""Assignment of reads to their nearest barcodes.

A call cuts a read's barcodes to the candidates with the least pseudo distance
in the k-mer index, and takes the two nearest of those by edit distance.  Ties
go to the smaller barcode_id.  A read without candidates has nulls.

There are two plans with equal results.  ``map`` sends the barcodes to every
worker, which makes the index, as arrays, and calls each batch of reads on its
own, without a shuffle; it is for barcode sets whose index has at most ``SENT``
bytes, which follow from the number of barcodes, their length and k.  It runs
in the executors' JVMs (``Caller.java``), or in Python workers where an index
is larger or sums pass 16 bits.
``join`` deals distinct sequences with one block of barcodes after another, each
with an index of at most ``SENT`` bytes, and ranks the candidates of all blocks,
for sets beyond that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window as W

from tessera.functions import distance as D
from tessera.operators import index as I
from tessera.operators import kernel
from tessera.sources.scratch import kept

#: Bytes of an index that every worker makes of sent barcodes; larger sets are joined.
SENT = 5 << 26
#: Postings of a piece of work, which stay in a core's cache; a read's are never parted.
PIECE = 1 << 16
#: Barcodes from which a table of all of them is made read by read, where a read meets a good part of them.
MANY = 1 << 12
METHODS = {f"{k}-mer-filter": (k,) for k in (4, 5, 6, 7)} | {"7-4-mer-filter": (7, 4), "7-5-mer-filter": (7, 5)}


@dataclass
class Index:
    """Postings by (k-mer, position): those of (x, i) are post[first[x * places + i] : first[x * places + i + 1]], each a barcode row << bits | position."""

    k: int
    length: int
    places: int
    first: np.ndarray
    post: np.ndarray
    bits: int
    ids: np.ndarray
    code: np.ndarray
    masks: np.ndarray | None  # of D.masks, if a word holds a barcode


def index_bytes(rows: int, length: int, *ks: int) -> int:
    places = [max(length - k + 1, 0) for k in ks]
    return rows * (length + 8 + 48) + sum(4 * rows * n + 8 * 4**k * n for k, n in zip(ks, places, strict=True))


def kmer_codes(code: np.ndarray, k: int) -> np.ndarray:
    """Base-4 numbers of the k-mers of each row; -1 where a symbol is no base."""
    n = code.shape[1] - k + 1
    out, bad = np.zeros((len(code), max(n, 0)), np.int64), np.zeros((len(code), max(n, 0)), bool)
    for j in range(k if n > 0 else 0):
        part = code[:, j : j + n]
        out = out * 4 + (part & 3)
        bad |= part > 3
    return np.where(bad, -1, out)


def build(ids: np.ndarray, seqs: list[str], k: int, length: int) -> Index:
    return Sent(pa.table({"barcode_id": ids, "seq": seqs}), length, k).steps[0]


def indexed(ids: np.ndarray, code: np.ndarray, masks: np.ndarray | None, k: int) -> Index:
    length = code.shape[1]
    places = length - k + 1
    bits = max(places - 1, 1).bit_length()
    small = np.int16 if k < 8 else np.int32
    words = [kmer_codes(code[:, at : at + k], k)[:, 0].astype(small) for at in range(places)]
    count = np.stack([np.bincount(x[x >= 0], minlength=4**k) for x in words], 1).ravel() if places > 0 else np.zeros(0, np.int64)
    first = np.append(0, np.cumsum(count))
    post = np.zeros(first[-1], np.uint32 if len(ids) << bits < 1 << 32 else np.uint64)
    for at, x in enumerate(words):
        row = np.argsort(x, kind="stable")[np.count_nonzero(x < 0) :]
        cells = np.arange(4**k) * places + at
        post[spread(first[cells], count[cells])] = row.astype(post.dtype) << post.dtype.type(bits) | post.dtype.type(at)
    return Index(k, length, places, first, post, bits, ids, code, masks)


class Sent:
    """What is sent of a barcode set: ids, ascending, and codes.  The indexes, some times as large, are made where they are used, once by each worker."""

    def __init__(self, table: pa.Table, length: int, *ks: int):
        ids, seqs = table["barcode_id"].to_numpy(), table["seq"].combine_chunks()
        order = np.argsort(ids, kind="stable")
        code = np.zeros((len(ids), length), np.uint8)
        for a in range(0, len(ids), 1 << 14):  # so few of them as arrays of their own at a time
            code[a : a + (1 << 14)] = np.stack(D.codes(seqs.take(pa.array(order[a : a + (1 << 14)])).to_pylist()))
        self.ids, self.code, self.ks = ids[order], code, ks

    @cached_property
    def steps(self) -> list[Index]:
        masks = D.masks(self.code) if self.code.shape[1] < 64 else None
        return [indexed(self.ids, self.code, masks, k) for k in self.ks]

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "steps"}


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - count), count)


def pieces(ix: Index, code: list[np.ndarray], window: int, of: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(a, z, read - a, read place, first posting, postings) of the reads from a to z.  ``of`` has the read, ascending, of each sequence, where reads have several."""
    reads, spots, xs = [], [], []
    sizes = np.array([min(len(c), ix.length) for c in code])
    for size in np.unique(sizes[sizes >= ix.k]).tolist():
        rows = np.flatnonzero(sizes == size)
        x = kmer_codes(np.stack([code[i][:size] for i in rows.tolist()]), ix.k)
        row, at = np.nonzero(x >= 0)
        reads.append((rows if of is None else of[rows])[row])
        spots.append(at)
        xs.append(x[row, at])
    if not reads or not len(ix.ids):
        return
    read, i, x = np.concatenate(reads), np.concatenate(spots), np.concatenate(xs)
    if len(reads) > 1:
        order = np.argsort(read, kind="stable")
        read, i, x = read[order], i[order], x[order]
    start = ix.first[x * ix.places + np.maximum(i - window, 0)]
    count = ix.first[x * ix.places + np.minimum(i + window, ix.places - 1) + 1] - start
    n = len(code) if of is None else int(of[-1]) + 1
    first = np.searchsorted(read, np.arange(n + 1))
    upto, a = np.append(0, np.cumsum(count))[first], 0  # postings before each read
    most = max(1, (1 << 32) >> (_row_bits(ix) + _gap_bits(ix, window)))  # reads whose keys have 32 bits
    while a < n:
        z = min(a + most, max(a + 1, int(np.searchsorted(upto, upto[a] + PIECE, "right")) - 1))
        k = slice(first[a], first[z])
        if upto[z] > upto[a]:
            yield a, z, read[k] - a, i[k], start[k], count[k]
        a = z


def candidates(ix: Index, code: list[np.ndarray], window: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(read, barcode row) of each read's n best by (pd, barcode_id), by read.  The work follows the number of postings, not of barcodes."""
    return scores(ix, code, window, n)[:2]


def scores(ix: Index, code: list[np.ndarray], window: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``candidates`` with -pd."""
    none = np.zeros(0, np.int64)
    out = [(none, none, none)]
    for a, z, *cells in pieces(ix, code, window):
        r, b, total = best(ix, *cells, z - a, window, n)
        out.append((r + a, b, total))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _row_bits(ix: Index) -> int:
    return max(len(ix.ids) - 1, 1).bit_length()


def _gap_bits(ix: Index, window: int) -> int:
    return max(min(window, ix.places - 1), 1).bit_length()


def postings(ix: Index, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    if len(count) << 6 > count.sum():
        return ix.post[spread(start, count)]
    return np.concatenate([ix.post[a:z] for a, z in zip(start.tolist(), (start + count).tolist(), strict=True)])


def keys(ix: Index, read: np.ndarray, i: np.ndarray, start: np.ndarray, count: np.ndarray, reads: int, window: int) -> np.ndarray:
    """Of each posting read, barcode row and |i - j| in one word."""
    row, gap = _row_bits(ix), _gap_bits(ix, window)
    u = np.uint32 if row + gap + (reads - 1).bit_length() <= 32 else np.uint64
    post = postings(ix, start, count).astype(u, copy=False)
    at = (post & u((1 << ix.bits) - 1)).astype(np.int32)
    at -= np.repeat(i.astype(np.int32), count)
    post = post >> u(ix.bits)
    post <<= u(gap)
    post |= np.abs(at, out=at).astype(u, copy=False)
    post |= np.repeat(read.astype(u) << u(row + gap), count)
    return post


def best(ix: Index, read: np.ndarray, i: np.ndarray, start: np.ndarray, count: np.ndarray, reads: int, window: int, n: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(read, barcode row, -pd) of a piece, each read's n best by rank, or all by row.

    A barcode met fewer than c times has less than c * length.  So where n barcodes that are met c times or more exceed
    (c - 1) * length, the n best are among these, and others, nearly all, are not summed.
    """
    b, row, gap = len(ix.ids), _row_bits(ix), _gap_bits(ix, window)
    if n is not None and n < b >= MANY and 4 * int(count.sum()) > reads * b and ix.places * min(2 * window + 1, ix.places) * ix.length < 1 << 16:
        return tallied(ix, read, i, start, count, reads, n)
    key = keys(ix, read, i, start, count, reads, window)
    u = key.dtype.type
    if 2 * len(key) > reads * b:
        key = key.astype(np.int64)
        cell = (key >> gap >> row) * b + (key >> gap & ((1 << row) - 1))
        total = np.bincount(cell, ix.length - (key & ((1 << gap) - 1)), reads * b).astype(np.int64)
        if n is not None and n < b:
            least = np.partition(total.reshape(reads, b), b - n, axis=1)[:, b - n]
            cell = np.flatnonzero(total.reshape(reads, b) >= np.maximum(least, 1)[:, None])
        else:
            cell = np.flatnonzero(total)
        return ranked(cell // b, cell % b, total[cell], reads, n)
    key.sort()
    run = key >> u(gap)
    met = 1
    while n is not None and met < len(run) and np.count_nonzero(run[met:] == run[:-met]) >= 2 * n * reads:
        met += 1
    out = ranked(*summed(ix, key, run, met, row, gap), reads, n)
    if met > 1:
        size = np.bincount(out[0], minlength=reads)
        ends = np.cumsum(size) - 1
        sure = (size == n) & (out[2][np.maximum(ends, 0)] > ix.length * (met - 1)) if len(out[0]) else np.zeros(reads, bool)
        if not sure.all():
            rest = ~sure[(run >> u(row)).astype(np.int64)]
            more = ranked(*summed(ix, key[rest], run[rest], 1, row, gap), reads, n)
            out = [np.concatenate((x[sure[out[0]]], y)) for x, y in zip(out, more, strict=True)]
            order = np.argsort(out[0], kind="stable")
            out = out[0][order], out[1][order], out[2][order]
    return out


def tallied(ix: Index, read: np.ndarray, i: np.ndarray, start: np.ndarray, count: np.ndarray, reads: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(read, barcode row, -pd) of each read's n best by rank, from a table of -pd of all barcodes.

    Some cells of a read's tell a bound that its n best most likely reach; where fewer do, all barcodes that it meets are ranked.
    """
    b, u = len(ix.ids), ix.post.dtype.type
    post = postings(ix, start, count)
    cell = (post >> u(ix.bits)).astype(np.intp)
    if reads > 1:
        cell += np.repeat(read * b, count)
    gap = (post & u((1 << ix.bits) - 1)).astype(np.int16)
    gap -= np.repeat(i.astype(np.int16), count)
    total = np.zeros(reads * b, np.uint16)
    np.add.at(total, cell, (ix.length - np.abs(gap, out=gap)).astype(np.uint16))
    step, found = max(1, b >> 12), []
    for t in total.reshape(reads, b):
        some = t[::step]
        nth = max(len(some) - 2 * n // step - 8, 0)
        at = np.flatnonzero(t >= max(np.partition(some, nth)[nth], 1))
        found.append(at if len(at) >= n else np.flatnonzero(t))
    who, at = np.repeat(np.arange(reads), [len(x) for x in found]), np.concatenate(found)
    return ranked(who, at, total[who * b + at].astype(np.int64), reads, n)


def summed(ix: Index, key: np.ndarray, run: np.ndarray, met: int, row: int, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(read, barcode row, -pd) of those that sorted keys have ``met`` times or more."""
    at = np.flatnonzero(run[met - 1 :] == run[: len(run) - met + 1]) if met > 1 else np.arange(len(run))
    if not len(at):
        return at, at, at
    who = run[at]
    first = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
    size = np.diff(np.append(first, len(at))) + met - 1
    if met > 1:
        key = key[spread(at[first], size)]
    gaps = np.add.reduceat((key & key.dtype.type((1 << gap) - 1)).astype(np.int64), np.cumsum(size) - size)
    who = who[first].astype(np.int64)
    return who >> row, who & ((1 << row) - 1), size * ix.length - gaps


def ranked(read: np.ndarray, b: np.ndarray, total: np.ndarray, reads: int, n: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n best of each read by falling total, then barcode; given and left by read."""
    if n is None or not len(read):
        return read, b, total
    size = np.bincount(read, minlength=reads)
    base = np.cumsum(size) - size
    top = int(total.max()) + 1
    order = np.argsort(read * top + (top - 1 - total), kind="stable")
    order = order[np.arange(len(order)) - base[read[order]] < n]
    return read[order], b[order], total[order]


def _caller(sent, distance: str, costs, window: int, n: int, threshold: int | None):
    """Calls with the first of the sent indexes; reads that have no accepted call are called with the next."""
    names = ["read_id", "barcode1", "distance1", "barcode2", "distance2"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32()]

    def called(ix: Index, code: list[np.ndarray]) -> np.ndarray:
        """Barcode row and distance of the best and the second; row -1 for none."""
        r, b = candidates(ix, code, window, n)
        d = measure(ix, code, r, b, distance, costs)
        order = np.argsort((r * (int(d.max(initial=0)) + 1) + d) * len(ix.ids) + b) if len(r) else r
        r, b, d = r[order], b[order], d[order]
        first = np.searchsorted(r, np.arange(len(code) + 1))
        out = np.full((2, 2, len(code)), -1, np.int64)
        for k in (0, 1):
            some = np.flatnonzero(np.diff(first) > k)
            out[k, 0, some], out[k, 1, some] = b[first[some] + k], d[first[some] + k]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps: list[Index] = sent.value.steps
        for batch in batches:
            seqs = [s or "" for s in batch.column("seq").to_pylist()]
            for a in range(0, len(seqs), 1 << 12):
                code = D.codes(seqs[a : a + (1 << 12)])
                got = called(steps[0], code)
                for ix in steps[1:]:
                    rest = np.flatnonzero((got[0, 0] < 0) | (got[0, 1] > threshold))
                    if len(rest):
                        got[:, :, rest] = called(ix, [code[i] for i in rest.tolist()])
                cells = [(steps[0].ids[got[k, 0]] if v == 0 else got[k, 1], got[k, 0] < 0) for k in (0, 1) for v in (0, 1)]
                yield pa.record_batch([batch.column("read_id").slice(a, len(code)), *[pa.array(v.astype(t.to_pandas_dtype()), t, mask=m) for (v, m), t in zip(cells, types, strict=True)]], names=names)

    return run, "read_id long, barcode1 long, distance1 int, barcode2 long, distance2 int"


def measure(ix: Index, code: list[np.ndarray], r: np.ndarray, b: np.ndarray, distance: str, costs) -> np.ndarray:
    """Distances of the reads r, ascending, and barcode rows b; reads of one length are measured together."""
    prefix, size = distance == "sequence-levenshtein", np.array([len(c) for c in code])
    first = np.searchsorted(r, np.arange(len(code) + 1))
    count = np.diff(first)
    out = np.zeros(len(r), np.int64)
    for n in np.unique(size[count > 0]).tolist():
        of = np.flatnonzero((size == n) & (count > 0))
        step = max(1, (1 << 12) // int(count[of].max()))  # so much stays in a core's cache
        for some in np.split(of, range(step, len(of), step)):
            reads = np.stack([code[i] for i in some.tolist()])
            if costs is None and ix.masks is not None:
                # a row for each read; rows with fewer barcodes are filled up with barcode 0
                there = np.arange(count[some].max()) < count[some][:, None]
                y = np.zeros(there.shape, np.int64)
                at = spread(first[some], count[some])
                y[there] = b[at]
                eq, each = ix.masks[:, y], np.arange(len(some))
                out[at] = D.columns(lambda i, x=reads, eq=eq, each=each: eq[x[:, i], each], y.shape, n, ix.length, prefix)[there]
            else:
                at = spread(first[some], count[some])
                out[at] = D.aligned(ix.code[b[at]], np.repeat(reads, count[some], 0), costs or D.UNIT, prefix)
    return out


def barcode_length(barcodes: DataFrame) -> tuple[int, int]:
    """(length, rows); all barcodes must have one length."""
    low, high, n = barcodes.agg(F.min(F.length("seq")), F.max(F.length("seq")), F.count("*")).first()
    if not n:
        raise ValueError("the barcode set is empty")
    if low != high:
        raise ValueError(f"barcodes have lengths from {low} to {high}")
    return low, n


def spread_out(reads: DataFrame) -> DataFrame:
    """reads over at least as many partitions as there are cores: a call costs far more than moving its read."""
    cores = reads.sparkSession.sparkContext.defaultParallelism
    return reads if reads.isStreaming or reads.rdd.getNumPartitions() >= cores else reads.repartition(4 * cores)


def _parts(reads: DataFrame) -> int:
    return max(4 * reads.sparkSession.sparkContext.defaultParallelism, reads.rdd.getNumPartitions())


def call(barcodes: DataFrame, reads: DataFrame, k: int = 4, distance: str = "sequence-levenshtein", window: int = I.WINDOW, n: int = I.CANDIDATES, costs: tuple[int, ...] | None = None, plan: str = "auto") -> DataFrame:
    """(read_id, barcode1, distance1, barcode2, distance2) of every row of reads(read_id, seq); read_ids may repeat.

    ``costs`` is a table as of ``distance.table``; without one, costs are 1.  A null or empty sequence has no candidates.
    Bases count without regard to case; other symbols match nothing, neither in k-mers nor in distances.
    """
    return _call(barcodes, reads, (k,), None, distance, window, n, costs, plan).drop("seq")


def _call(barcodes: DataFrame, reads: DataFrame, ks: tuple[int, ...], threshold: int | None, distance: str = "sequence-levenshtein", window: int = I.WINDOW, n: int = I.CANDIDATES, costs: tuple[int, ...] | None = None, plan: str = "auto") -> DataFrame:
    """The calls with ks[0], and of reads without one within the threshold with ks[1].  The join plan also has seq."""
    distance = D.named(distance)
    length, rows = barcode_length(barcodes)
    for k in ks:
        if not 0 < k < min(length, 16):
            raise ValueError(f"k = {k} does not suit barcodes of {length} bases")
    if plan == "auto":
        plan = "map" if index_bytes(rows, length, *ks) <= SENT else "join"
    reads = reads.select(F.col("read_id").cast("long").alias("read_id"), "seq")
    if plan == "map":
        barcodes = barcodes.select(F.col("barcode_id").cast("long").alias("barcode_id"), "seq")
        if index_bytes(rows, length, *ks) <= SENT and all((length - k + 1) * min(2 * window + 1, length - k + 1) * length < 1 << 16 for k in ks):
            return _called(barcodes, rows, length, ks, spread_out(reads), window, n, threshold, distance, costs)
        sent = _sent(barcodes, length, *ks)
        return spread_out(reads).mapInArrow(*_caller(sent, distance, costs, window, n, threshold))
    # a call depends on the sequence alone, so the sequence is the key, whatever the read_ids; unknown symbols differ between both sides
    reads = reads.withColumn("key", known(F.col("seq"), "-"))
    barcodes = barcodes.select(F.col("barcode_id").cast("long").alias("barcode_id"), known(F.col("seq"), "_").alias("seq"))
    seqs = reads.where("key is not null").select(F.col("key").alias("read_id"), F.col("key").alias("seq"))
    seqs = seqs.repartition(_parts(reads), "read_id").distinct()
    best = None
    for k in ks:
        blocks = -(-index_bytes(rows, length, k) // SENT)
        pairs = None
        for m in range(blocks):
            sent = _sent(barcodes.where(F.pmod(F.xxhash64("barcode_id"), F.lit(blocks)) == m), length, k)
            if not sent:
                continue
            part = seqs.mapInArrow(*_block(sent, distance, costs, window, n, n if blocks > 1 else 2))
            pairs = part if pairs is None else pairs.unionByName(part)
        step = best_two(I.top_candidates(pairs, n) if blocks > 1 else pairs, seqs)
        if len(ks) > 1 and k == ks[0]:
            step = kept(step, "calls")
            seqs = unassigned(step, threshold).select("read_id", F.col("read_id").alias("seq"))
            step = step.where(F.col("distance1") <= threshold)
        best = step if best is None else best.unionByName(step)
    # both sides are dealt out: Spark takes the calls for less than they are, and would broadcast them
    return reads.join(best.withColumnRenamed("read_id", "key").hint("merge"), "key", "left").drop("key")


def _called(barcodes: DataFrame, rows: int, length: int, ks: tuple[int, ...], reads: DataFrame, window: int, n: int, threshold: int | None, distance: str, costs) -> DataFrame:
    """The rows of ``_caller``, made in the executors' JVMs: one index for all tasks of an executor, and sums and distances without arrays of postings."""
    spark = reads.sparkSession
    args = kernel.ints(spark, ks), reads._jdf, window, n, -1 if threshold is None else threshold, distance == "sequence-levenshtein", costs is None
    square = kernel.ints(spark, D.square(costs or D.UNIT).ravel().tolist())
    types = "barcode1 long, distance1 int, barcode2 long, distance2 int"
    caller = kernel.caller(spark)
    parted = rows >= MANY and ks[-1] in (4, 5) and length + window < 64 and not reads.isStreaming
    return DataFrame((caller.parted if parted else caller.calls)(barcodes._jdf, rows, length, *args, square, types), spark)


def _block(sent, distance: str, costs, window: int, n: int, most: int):
    """(read_id, barcode_id, pd, dist) of the ``most`` nearest of each read's n candidates in the sent block of barcodes."""
    names = ["read_id", "barcode_id", "pd", "dist"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = sent.value.steps[0]
        for batch in batches:
            for a in range(0, len(batch), 1 << 12):
                code = D.codes(batch.column("seq").slice(a, 1 << 12).to_pylist())
                r, b, total = scores(ix, code, window, n)
                d = measure(ix, code, r, b, distance, costs)
                if most < n:
                    order = np.lexsort((b, d, r))
                    order = order[np.arange(len(r)) - np.searchsorted(r, r) < most]
                    r, b, total, d = r[order], b[order], total[order], d[order]
                yield pa.record_batch([batch.column("read_id").take(pa.array(r + a)), pa.array(ix.ids[b]), pa.array(-total), pa.array(d.astype(np.int32))], names=names)

    return run, "read_id string, barcode_id long, pd long, dist int"


def _plain(barcodes: DataFrame, k: int, length: int) -> bool:
    """Whether the index of these barcodes can be sent, and gives what the joins of ``index`` give: distinct ids, and sequences of ``length`` upper-case bases."""
    plain = F.col("barcode_id").isNotNull() & F.coalesce(F.col("seq").rlike(f"^[ACGT]{{{length}}}$"), F.lit(False))
    rows, good, ids = barcodes.agg(F.count("*"), F.count_if(plain), F.countDistinct("barcode_id")).first()
    return 0 < k < min(length, 16) and 0 < rows == good == ids and index_bytes(rows, length, k) <= SENT


def _sent(barcodes: DataFrame, length: int, *ks: int):
    """The broadcast barcodes; None if there are none."""
    table = barcodes.select("barcode_id", "seq").toArrow()
    return barcodes.sparkSession.sparkContext.broadcast(Sent(table, length, *ks)) if table.num_rows else None


def _typed(reads: DataFrame, barcodes: DataFrame, *names: str) -> StructType:
    types = {"read_id": reads.schema["read_id"].dataType, "barcode_id": barcodes.schema["barcode_id"].dataType}
    return StructType([StructField(c, types.get(c, IntegerType())) for c in names])


#: What is no upper-case base meets no k-mer of plain barcodes.
_BASES = "regexp_replace(coalesce(seq, ''), '[^ACGT]', 'N')"


def scored(reads: DataFrame, barcodes: DataFrame, k: int, length: int, window: int = I.WINDOW, n: int | None = None) -> DataFrame:
    """(read_id, barcode_id, pd) of ``index.pseudo_distance``; with n also the rank, of the n best of each read.

    Pairs are summed where a read is, by the sent index; barcode sets that can't be sent so are joined.
    """
    if not _plain(barcodes, k, length):
        rows = I.pseudo_distance(reads, barcodes, k, length, window)
        return rows if n is None else I.top_candidates(rows, n)
    sent = _sent(barcodes, length, k)
    names = ["read_id", "barcode_id", "pd", *(["rank"] if n else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = sent.value.steps[0]
        for batch in batches:
            read_id, lists = batch.column("read_id"), batch.column("seqs")
            for a in range(0, len(batch), 1 << 10):
                part = lists.slice(a, 1 << 10)
                of = np.repeat(np.arange(len(part)), part.value_lengths().to_numpy())
                for p, z, *cells in pieces(ix, D.codes(part.flatten().to_pylist()), window, of):
                    r, b, total = best(ix, *cells, z - p, window, n)
                    size = np.bincount(r, minlength=z - p)
                    more = [np.arange(len(r)) - (np.cumsum(size) - size)[r] + 1] if n else []
                    yield pa.record_batch([read_id.take(pa.array(r + (a + p))), pa.array(ix.ids[b]), *[pa.array(x.astype(np.int32)) for x in (-total, *more)]], names=names)

    reads = reads.select("read_id", F.expr(_BASES).alias("seq")).repartition(_parts(reads), "read_id").groupBy("read_id").agg(F.collect_list("seq").alias("seqs"))
    return reads.mapInArrow(run, _typed(reads, barcodes, *names))


def band(reads: DataFrame, barcodes: DataFrame, k: int, length: int, window: int = I.WINDOW) -> DataFrame:
    """(read_id, i, barcode_id, j) of ``index.band_join``, by the sent index or, for barcode sets that can't be sent, by the equi-join."""
    if not _plain(barcodes, k, length):
        return I.band_join_equi(reads, barcodes, k, length, window)
    sent = _sent(barcodes, length, k)
    names = ["read_id", "i", "barcode_id", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = sent.value.steps[0]
        for batch in batches:
            read_id, seqs = batch.column("read_id"), batch.column("seq")
            for a in range(0, len(batch), 1 << 10):
                for p, _, read, i, start, count in pieces(ix, D.codes(seqs.slice(a, 1 << 10).to_pylist()), window):
                    post = postings(ix, start, count)
                    u = post.dtype.type
                    yield pa.record_batch([read_id.take(pa.array(np.repeat(read + (a + p), count))), pa.array(np.repeat(i.astype(np.int32), count)), pa.array(ix.ids[post >> u(ix.bits)]), pa.array((post & u((1 << ix.bits) - 1)).astype(np.int32))], names=names)

    return spread_out(reads.select("read_id", F.expr(_BASES).alias("seq"))).mapInArrow(run, _typed(reads, barcodes, *names))


def known(seq: Column, other: str) -> Column:
    """Upper-case bases; each other symbol becomes ``other``."""
    return F.regexp_replace(F.translate(seq, "acgt", "ACGT"), "[^ACGT]", other)


def best_two(measured: DataFrame, reads: DataFrame) -> DataFrame:
    """First and second barcode of each read by (dist, barcode_id); reads without any have nulls."""
    by = W.partitionBy("read_id").orderBy("dist", "barcode_id")
    top = measured.select("read_id", "barcode_id", "dist", F.row_number().over(by).alias("rank")).where("rank <= 2")
    pick = lambda c, k, name: F.max(F.when(F.col("rank") == k, F.col(c))).alias(name)
    best = top.groupBy("read_id").agg(pick("barcode_id", 1, "barcode1"), pick("dist", 1, "distance1"), pick("barcode_id", 2, "barcode2"), pick("dist", 2, "distance2"))
    return reads.select("read_id").join(best.hint("merge"), "read_id", "left")


def unassigned(calls: DataFrame, threshold: int) -> DataFrame:
    return calls.where(F.col("distance1").isNull() | (F.col("distance1") > threshold))


def two_step(barcodes: DataFrame, reads: DataFrame, k_large: int, k_small: int, threshold: int | None, **options) -> DataFrame:
    """Calls with k_large; reads without an accepted one are called anew with k_small.  Without a threshold, only reads without candidates are."""
    return _call(barcodes, reads, (k_large, k_small), 2**31 - 1 if threshold is None else threshold, **options).drop("seq")


def run_method(method: str, barcodes: DataFrame, reads: DataFrame, threshold: int | None = None, **options) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    ks = METHODS[method]
    return call(barcodes, reads, ks[0], **options) if len(ks) == 1 else two_step(barcodes, reads, *ks, threshold, **options)


def nearest(barcodes: DataFrame, reads: DataFrame, distance: str = "sequence-levenshtein") -> DataFrame:
    """(read_id, barcode1, distance1) without the filter: every read against every barcode of a set that may be sent."""
    length, rows = barcode_length(barcodes)
    if rows * (length + 56) > SENT:
        raise ValueError("too many barcodes to compare each with each read")
    spark = reads.sparkSession
    barcodes = barcodes.select(F.col("barcode_id").cast("long").alias("barcode_id"), "seq")
    reads = spread_out(reads.select(F.col("read_id").cast("long").alias("read_id"), "seq"))
    prefix, square = D.named(distance) == "sequence-levenshtein", kernel.ints(spark, D.square(D.UNIT).ravel().tolist())
    return DataFrame(kernel.caller(spark).nearest(barcodes._jdf, rows, length, reads._jdf, prefix, square, "barcode1 long, distance1 int"), spark)
