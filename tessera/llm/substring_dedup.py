"""Removal of word passages that an earlier document already has: seed, extend, keep maximal repeats.

A window is ``length`` consecutive words.  Winnowing gives every window one
anchor, the least hash of its ``seed``-word grams; equal windows have equal
anchors.

1.  Seed: anchors that two rows have enter a bitmap; the others' windows are unique.
2.  Extend: consecutive windows with such anchors are matched in blocks whose
    borders depend on content alone, by content hash, not word by word.  A block that a
    document with a smaller doc_id also has is removed as a whole.
3.  What is left, the first copy of each block and the ends of matches, is
    compared window by window.  A window's first document keeps it within such
    a block, so this finds the first document of every window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.llm import arrays as A
from tessera.llm.shared import bitmap, kept, maybe

LENGTH = 13
SEED = 5
LAST = 2**63 - 1
#: A block's place; ``_windows`` computes the same.
PLACE = "xxhash64(key, doc_id, start)"


def anchors(w: A.Words, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and anchor hash of every window within one text."""
    low = A.least(A.grams(w.hash, seed), length - seed + 1)
    p = np.flatnonzero(A.within(w.doc, length))
    return p, low[p]


def _seeds(length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, at in A.chunks(batch.column("text")):
                w = A.words(buf, at, A.SPACED, lower=False)
                p, low = anchors(w, length, seed)
                new = np.ones(len(p), bool)
                new[1:] = (low[1:] != low[:-1]) | (p[1:] != p[:-1] + 1)
                low, doc = low[new], w.doc[p[new]]
                order = np.lexsort((low, doc))
                low, doc = low[order], doc[order]
                new = np.ones(len(low), bool)
                new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
                yield pa.record_batch([A.signed(low[new])], names=["seed"])

    return run, "seed long"


def blocks(w: A.Words, length: int, seed: int, joined: np.ndarray) -> tuple[np.ndarray, ...]:
    """Content hash, text, first word and number of windows of each block."""
    p, low = anchors(w, length, seed)
    hit = maybe(joined, low)
    p, low = p[hit], low[hit]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1] + 1) | (w.doc[p[1:]] != w.doc[p[:-1]]) | ((low[1:] != low[:-1]) & (low[1:] >> A.U(61) == 0))
    b = np.flatnonzero(new)
    start, count = p[b], np.diff(np.append(b, len(p)))
    powers, inverse = A.powers(len(w.hash) + 1)
    s = np.zeros(len(w.hash) + 1, A.U)
    np.cumsum(w.hash * powers[:-1], out=s[1:])
    key = A.mix((s[start + count - 1 + length] - s[start]) * inverse[start] + count.astype(A.U))
    return key, w.doc[start], start, count


def _blocks(length: int, seed: int, joined):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dh = batch.column("doc_id"), batch.column("dh")
            for i, _, buf, at in A.chunks(batch.column("text")):
                w = A.words(buf, at, A.SPACED, lower=False)
                key, doc, start, count = blocks(w, length, seed, joined.value)
                rows = pa.array(i + doc)
                yield pa.record_batch([A.signed(key), ids.take(rows), dh.take(rows), pa.array(start - w.first[doc]), pa.array(count.astype(np.int32))], names=["key", "doc_id", "dh", "start", "n"])

    return run, "key long, doc_id long, dh long, start long, n int"


def _windows(length: int, seed: int, joined, first):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dh = batch.column("doc_id"), batch.column("dh")
            nums = ids.to_numpy()
            for i, _, buf, at in A.chunks(batch.column("text")):
                w = A.words(buf, at, A.SPACED, lower=False)
                key, doc, start, count = blocks(w, length, seed, joined.value)
                hit = maybe(first.value, A.xxhash64(key.view(np.int64), nums[i + doc], start - w.first[doc]))
                p = A.spread(start[hit], count[hit])
                doc = w.doc[p]
                rows = pa.array(i + doc)
                yield pa.record_batch([A.signed(A.grams(w.hash, length)[p]), ids.take(rows), dh.take(rows), pa.array((p - w.first[doc]).astype(np.int32))], names=["window", "doc_id", "dh", "start"])

    return run, "window long, doc_id long, dh long, start int"


def repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(doc_id, dh, s, e): word intervals that windows of a document with a smaller doc_id cover."""
    sc = docs.sparkSession.sparkContext
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), "text", F.xxhash64("text").alias("dh"))
    seeds = docs.mapInArrow(*_seeds(length, seed)).groupBy("seed").agg(F.count("*").alias("n")).where("n > 1")
    joined = sc.broadcast(bitmap(seeds, F.col("seed")))
    found = docs.mapInArrow(*_blocks(length, seed, joined)).withColumn("first", F.min("doc_id").over(W.partitionBy("key")))
    found = kept(found, "blocks")
    first = sc.broadcast(bitmap(found.where("doc_id = first"), F.expr(PLACE)))
    whole = found.where("doc_id > first").select("doc_id", "dh", F.col("start").alias("s"), (F.col("start") + F.col("n") - 1 + length).alias("e"))
    rest = docs.mapInArrow(*_windows(length, seed, joined, first)).withColumn("first", F.min("doc_id").over(W.partitionBy("window")))
    rest = rest.where("doc_id > first").select("doc_id", "dh", F.col("start").cast("long").alias("s"), (F.col("start") + length).cast("long").alias("e"))
    return whole.union(rest)


def _cut_out(texts: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, at = A.utf8(batch.column("text"))
            data = buf.tobytes()
            cuts, ids = batch.column("cuts"), batch.column("doc_id")
            some = cuts.is_valid().to_numpy(zero_copy_only=False)
            n, removed, digest, out = [], [], [], []
            for i in range(len(at) - 1):
                w = data[at[i] : at[i + 1]].split()
                n.append(len(w))
                if some[i]:
                    c = cuts[i].values
                    w = list(compress(w, ~A.covered(len(w), c.field("s").to_numpy(), c.field("e").to_numpy())))
                removed.append(n[-1] - len(w))
                text = b" ".join(w)
                digest.append(hashlib.sha256(text).hexdigest())
                out.append(text.decode("utf-8", "replace") if texts else None)
            yield pa.record_batch([ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest), pa.array(out, pa.string())], schema=schema)

    return run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def substring_dedup(docs: DataFrame, length: int = LENGTH, texts: bool = True) -> DataFrame:
    """Every document without passages of ``length`` words that a smaller doc_id has: doc_id, n_words, n_removed, kept_sha256, kept (null unless ``texts``).

    A null text has no words.  Rows with one doc_id are one document: they do not remove each other's words.  A null doc_id
    ranks after all others.  Other columns are ignored.
    """
    cuts = repeats(docs, length).groupBy("doc_id", "dh").agg(F.collect_set(F.struct("s", "e")).alias("cuts")).toDF("c_id", "c_dh", "cuts")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("dh"))
    joined = docs.join(cuts, (F.coalesce("doc_id", F.lit(LAST)) == F.col("c_id")) & (F.col("dh") == F.col("c_dh")), "left").select("doc_id", "text", "cuts")
    return joined.mapInArrow(*_cut_out(texts))


def op6(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False).drop("kept")
