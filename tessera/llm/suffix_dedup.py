"""Removal of long repeated byte strings with a logarithmic family of suffix indexes.

A byte belongs to a repeat when some string of ``length`` bytes that covers it
also starts at another place.  Nothing else about a suffix matters than its
first ``length`` bytes, so the index orders suffixes by the 64-bit fingerprint
of those bytes; equal prefixes are neighbours as in lexicographic order.

1.  Each text is cut into blocks: maximal runs of places whose windows of
    ``length`` bytes have the same least ``seed``-byte hash.  Equal windows have
    equal seeds, so only blocks that share a seed can share a window.
2.  A block whose bytes occur twice is a repeat as a whole.
3.  Where blocks with one seed differ, the bytes of each distinct block go
    through a ``Levels`` index, which finds the windows they share.

Blocks are about half of ``length`` long, so the tables that are shuffled have
about one row for every hundred bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.llm import arrays as A
from tessera.llm.shared import bitmap, kept, maybe

LENGTH = 400
GROUP = 4096
PLACES = A.U(2**30 - 1)


class Levels:
    """Suffix indexes whose sizes grow geometrically.

    ``add`` sorts a batch, merge-scans it against every level, returns the
    entries (old and new) that turn out to have a twin, and merges levels of
    about equal size.  Each distinct prefix is held once.
    """

    def __init__(self) -> None:
        self.levels: list[list[np.ndarray]] = []  # prefix, entry, whether its twin is known

    def add(self, prefix: np.ndarray, entry: np.ndarray) -> np.ndarray:
        order = np.argsort(prefix, kind="stable")
        prefix, entry = prefix[order], entry[order]
        new = np.ones(len(prefix), bool)
        new[1:] = prefix[1:] != prefix[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(prefix)))
        keys, twin = prefix[first], size > 1
        fresh = np.ones(len(keys), bool)
        out = []
        for level in self.levels:
            at = np.searchsorted(level[0], keys)
            at[at == len(level[0])] = 0
            hit = level[0][at] == keys
            fresh &= ~hit
            twin |= hit
            late = at[hit & ~level[2][at]]
            out.append(level[1][late])
            level[2][late] = True
        out.append(entry[np.repeat(twin, size)])
        if fresh.any():
            self.levels.append([keys[fresh], entry[first][fresh], twin[fresh]])
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            a, b = self.levels.pop(), self.levels.pop()
            merged = [np.concatenate(x) for x in zip(a, b, strict=True)]
            order = np.argsort(merged[0], kind="stable")
            self.levels.append([x[order] for x in merged])
        return np.concatenate(out)


def cut(buf: np.ndarray, at: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """Blocks of a run of texts: seed hash, content hash, text, start byte, number of window starts, whether equal windows may lie in it.

    Of equal least hashes the leftmost counts.  Windows of one block can be equal only where that place moves.
    """
    n = len(buf)
    if n < length:
        return (np.zeros(0, A.U), np.zeros(0, A.U), *[np.zeros(0, np.int64)] * 3, np.zeros(0, bool))
    s, inverse = A.prefix(buf)
    g = A.mix((s[seed:] - s[:-seed]) * inverse[: n - seed + 1])
    place = A.least((g & ~PLACES) | np.arange(len(g), dtype=A.U), length - seed + 1)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    p = np.flatnonzero(A.within(doc, length))
    place = (place[p] & PLACES).astype(np.int64)
    low = g[place]
    new = np.ones(len(p), bool)
    new[1:] = (low[1:] != low[:-1]) | (p[1:] != p[:-1] + 1)
    b = np.flatnonzero(new)
    start = p[b]
    count = np.diff(np.append(b, len(p)))
    end = start + count - 1 + length
    key = A.mix((s[end] - s[start]) * inverse[start] + count.astype(A.U))
    return low[b], key, doc[start], start, count, place[b] != place[np.append(b[1:], len(p)) - 1]


def _blocks(length: int, seed: int):
    schema = pa.schema([("seed", pa.int64()), ("key", pa.int64()), ("doc_id", pa.int64()), ("dh", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("own", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dh = batch.column("doc_id"), batch.column("dh")
            for i, _, buf, at in A.chunks(batch.column("text")):
                low, key, doc, start, count, own = cut(buf, at, length, seed)
                rows = pa.array(i + doc)
                yield pa.record_batch([A.signed(low), A.signed(key), ids.take(rows), dh.take(rows), pa.array(start - at[doc]), pa.array(count.astype(np.int32)), pa.array(own)], schema=schema)

    return run, "seed long, key long, doc_id long, dh long, start long, n int, own boolean"


#: A block's place; ``_spans`` computes the same.
PLACE = "xxhash64(key, coalesce(doc_id, 0L), start)"


def _spans(length: int, seed: int, bits):
    schema = pa.schema([("seed", pa.int64()), ("doc_id", pa.int64()), ("dh", pa.int64()), ("start", pa.int64()), ("span", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = bits.value
        for batch in batches:
            ids, dh = batch.column("doc_id"), batch.column("dh")
            nums = ids.fill_null(0).to_numpy()
            for i, _, buf, at in A.chunks(batch.column("text")):
                low, key, doc, start, count, own = cut(buf, at, length, seed)
                place = A.xxhash64(key.view(np.int64), nums[i + doc], start - at[doc])
                hit = np.flatnonzero(maybe(want, place))
                spans = [buf[s:e].tobytes() for s, e in zip(start[hit].tolist(), (start[hit] + count[hit] - 1 + length).tolist(), strict=True)]
                rows = pa.array(i + doc[hit])
                yield pa.record_batch([A.signed(low[hit]), ids.take(rows), dh.take(rows), pa.array((start - at[doc])[hit]), pa.array(spans, pa.binary())], schema=schema)

    return run, "seed long, doc_id long, dh long, start long, span binary"


def _shared(length: int):
    """Windows that a shard's spans share, as byte intervals of their texts."""
    schema = pa.schema([("doc_id", pa.int64()), ("dh", pa.int64()), ("s", pa.int64()), ("e", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, tables, base = Levels(), [], 0
        where: list[np.ndarray] = []
        for batch in batches:
            part, parts = batch.column("part").to_numpy(), batch.column("parts").to_numpy()
            seeds = batch.column("seed").to_numpy().view(A.U)
            for i, j, buf, at in A.chunks(batch.column("span")):
                s, inverse = A.prefix(buf)
                count = np.diff(at) - length + 1
                row = np.repeat(np.arange(j - i), count)
                p = A.spread(at[:-1], count)
                prefix = A.mix((s[p + length] - s[p]) * inverse[p] + seeds[i + row])
                mine = prefix % parts[i + row].astype(A.U) == part[i + row].astype(A.U)
                hits = index.add(prefix[mine], (base + at[i - i] + p)[mine])
                tables.append((base, at[:-1], batch.column("doc_id").slice(i, j - i), batch.column("dh").slice(i, j - i), batch.column("start").to_numpy()[i:j]))
                where.append(hits)
                base += len(buf)
        if not tables:
            return
        first = np.concatenate([b + at for b, at, *_ in tables])
        start = np.concatenate([x[4] for x in tables])
        ids, dh = (pa.concat_arrays([x[k] for x in tables]) for k in (2, 3))
        hits = np.unique(np.concatenate(where))
        row = np.searchsorted(first, hits, "right") - 1
        new = np.ones(len(hits), bool)
        new[1:] = (hits[1:] != hits[:-1] + 1) | (row[1:] != row[:-1])
        b = np.flatnonzero(new)
        last = np.append(b[1:], len(hits)) - 1
        s = start[row[b]] + hits[b] - first[row[b]]
        e = start[row[last]] + hits[last] - first[row[last]] + length
        rows = pa.array(row[b])
        for k in range(0, len(b), 10000):
            yield pa.record_batch([ids.take(rows[k : k + 10000]), dh.take(rows[k : k + 10000]), pa.array(s[k : k + 10000]), pa.array(e[k : k + 10000])], schema=schema)

    return run, "doc_id long, dh long, s long, e long"


def repeats(docs: DataFrame, length: int = LENGTH, seed: int | None = None) -> DataFrame:
    """(doc_id, dh, s, e): byte intervals of texts that repeated strings of ``length`` bytes cover.

    dh is xxhash64 of the text, so that rows that share a doc_id but not their text stay apart.
    """
    seed = seed or length // 2
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("dh")).where(F.octet_length("text") >= length)
    by, one = W.partitionBy("seed"), W.partitionBy("seed", "key").orderBy("doc_id", "dh", "start")
    blocks = docs.mapInArrow(*_blocks(length, seed))
    found = blocks.select("*", F.count("*").over(by).alias("of_seed"), (F.col("own") | (F.min("key").over(by) != F.max("key").over(by))).alias("mixed")).where("of_seed > 1 or own")
    found = found.select("*", F.row_number().over(one).alias("nth"), F.lead("dh").over(one).isNotNull().alias("more"))
    found = kept(found.select("seed", "key", "doc_id", "dh", "start", "n", "mixed", "nth", ((F.col("nth") > 1) | F.col("more")).alias("twice")), "blocks")
    whole = found.where("twice").select("doc_id", "dh", F.col("start").alias("s"), (F.col("start") + F.col("n") - 1 + length).alias("e"))
    open_ = found.where("mixed and nth = 1")
    bits = spark.sparkContext.broadcast(bitmap(open_, F.expr(PLACE)))
    large = open_.groupBy("seed").count().where(F.col("count") > GROUP).select("seed", F.ceil(F.col("count") / GROUP).cast("int").alias("parts"))
    spans = docs.mapInArrow(*_spans(length, seed, bits)).join(large, "seed", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    spans = spans.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).repartition("seed", "part")
    return whole.union(spans.mapInArrow(*_shared(length)))


def _cut_out(drop: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, at = A.utf8(batch.column("text"))
            size = np.diff(at)
            removed, spans, digest, texts = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), [], []
            cuts = batch.column("cuts")
            some = cuts.is_valid().to_numpy(zero_copy_only=False)
            for i in range(len(size)):
                text = buf[at[i] : at[i + 1]]
                if some[i]:
                    c = cuts[i].values
                    out = A.covered(len(text), c.field("s").to_numpy(), c.field("e").to_numpy())
                    removed[i], spans[i] = out.sum(), len(A.runs(out)[0])
                    text = text[~out]
                digest.append(hashlib.sha256(text).hexdigest())
                texts.append(None if drop else text.tobytes())
            yield pa.record_batch([batch.column("doc_id"), pa.array(size), pa.array(removed), pa.array(spans), pa.array(digest), pa.array(texts, pa.binary())], schema=schema)

    return run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def suffix_dedup(docs: DataFrame, length: int = LENGTH, texts: bool = True) -> DataFrame:
    """Every document without its repeated bytes: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary; null unless ``texts``).

    A null text is empty; texts shorter than ``length`` lose nothing; a row that is there twice is a copy of itself and
    loses all of a text of ``length`` bytes or more.  Null doc_ids are allowed.  Other columns are ignored.
    """
    cuts = repeats(docs, length).groupBy("doc_id", "dh").agg(F.collect_set(F.struct("s", "e")).alias("cuts"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("dh"))
    c = cuts.toDF("c_id", "c_dh", "cuts")
    joined = docs.join(c, docs["doc_id"].eqNullSafe(c["c_id"]) & (docs["dh"] == c["c_dh"]), "left").select("doc_id", "text", "cuts")
    return joined.mapInArrow(*_cut_out(not texts))


def op3(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False).drop("kept")
