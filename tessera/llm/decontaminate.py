"""Benchmark decontamination: test suffixes searched in suffix arrays of training shards.

A shard is a run of whole documents.  Its suffix array holds, in word order,
the suffixes that open with two words which also open some test suffix; no
other suffix can match one.  Every test suffix, that is every place of a
benchmark item that has a window's length left, is searched in it by bisection
and its matches are extended word by word to the longest verbatim match.

The test side travels to the shards in blocks of at most ``BLOCK`` bytes of
item text; a larger benchmark takes one pass over the documents per block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import arrays as A
from tessera.llm.shared import kept, spare

LENGTH = 10
BLOCK = 1 << 25
MATCH = pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("item_start", pa.int64()), ("length", pa.int64())])


@dataclass
class Suffixes:
    """Test suffixes whose windows have one length: sorted distinct window keys, and for each the suffixes with it."""

    size: int
    opens: np.ndarray  # bitmap of the hashes of the first two words
    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    at: np.ndarray


def keys_of(h: np.ndarray, p: np.ndarray, size: int) -> np.ndarray:
    """The size word hashes from each place on, as bytes that sort as the hashes do."""
    table = np.stack([h[p + k] for k in range(size)], 1).astype(">u8")
    return np.ascontiguousarray(table).view(f"S{8 * size}").ravel()


def opening(h: np.ndarray, size: int) -> np.ndarray:
    return A.grams(h, min(size, 2))


def test_suffixes(texts: pa.Array, length: int) -> tuple[list[Suffixes], A.Words]:
    buf, at = A.utf8(texts)
    w = A.words(buf, at, A.ALNUM, lower=True)
    w.hash |= A.U(1)  # no key ends in a zero byte
    count = np.diff(w.first)
    size_of = np.minimum(count, length)
    out = []
    for size in np.unique(size_of[size_of > 0]).tolist():
        p = np.flatnonzero(A.within(w.doc, size))
        p = p[size_of[w.doc[p]] == size]
        keys = keys_of(w.hash, p, size)
        order = np.argsort(keys, kind="stable")
        keys, p = keys[order], p[order]
        new = np.ones(len(p), bool)
        new[1:] = keys[1:] != keys[:-1]
        first = np.flatnonzero(new)
        opens = np.zeros(1 << 14, np.int64)
        k = opening(w.hash, size)[p].view(np.int64) & (len(opens) * 64 - 1)
        np.bitwise_or.at(opens, k >> 6, np.int64(1) << (k & 63))
        out.append(Suffixes(size, opens, keys[first], np.append(first, len(p)), w.doc[p], p))
    return out, w


def search(w: A.Words, tests: list[Suffixes], items: A.Words) -> list[np.ndarray]:
    """(text, row of the item, start word, item's start word, words) of every longest match that starts at its window, not being the inside of a longer one with the same alignment."""
    found = [np.zeros((0, 5), np.int64)]
    for t in tests:
        if len(w.hash) < t.size:
            continue
        k = opening(w.hash, t.size)[: len(w.hash) - t.size + 1].view(np.int64) & (len(t.opens) * 64 - 1)
        p = np.flatnonzero((t.opens[k >> 6] >> (k & 63)) & 1)
        p = p[w.doc[p] == w.doc[p + t.size - 1]]
        if not len(p):
            continue
        keys = keys_of(w.hash, p, t.size)
        order = np.argsort(keys, kind="stable")
        keys, p = keys[order], p[order]  # the shard's suffix array
        lo, hi = np.searchsorted(keys, t.keys, "left"), np.searchsorted(keys, t.keys, "right")
        some = np.flatnonzero(hi > lo)
        # every pair of a test suffix and a place with its window
        n_test, n_here = t.first[some + 1] - t.first[some], (hi - lo)[some]
        tests_of = A.spread(t.first[some], n_test)
        reps = np.repeat(n_here, n_test)
        here = A.spread(np.repeat(lo[some], n_test), reps)
        place, at, item = p[here], np.repeat(t.at[tests_of], reps), np.repeat(t.item[tests_of], reps)
        # a match whose words before are equal as well is the inside of a longer one
        b, i = np.maximum(place - 1, 0), np.maximum(at - 1, 0)
        inner = (place > 0) & (at > 0) & (w.doc[b] == w.doc[place]) & (items.doc[i] == items.doc[at]) & (w.hash[b] == items.hash[i])
        place, at, item = place[~inner], at[~inner], item[~inner]
        size = np.full(len(place), t.size)
        going = np.arange(len(place))
        while len(going):
            b, i = place[going] + size[going], at[going] + size[going]
            on = (b < len(w.hash)) & (i < len(items.hash))
            b, i = np.minimum(b, len(w.hash) - 1), np.minimum(i, len(items.hash) - 1)
            on &= (w.doc[b] == w.doc[place[going]]) & (items.doc[i] == items.doc[at[going]]) & (w.hash[b] == items.hash[i])
            going = going[on]
            size[going] += 1
        doc = w.doc[place]
        found.append(np.stack([doc, item, place - w.first[doc], at - items.first[items.doc[at]], size], 1))
    return found


def _matches(tests):
    schema = pa.schema([("doc_id", pa.int64()), ("dh", pa.int64()), ("n_words", pa.int64()), ("matches", pa.list_(MATCH))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes, items, item_ids = tests.value
        for batch in batches:
            n, sizes, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
            for i, j, buf, at in A.chunks(batch.column("text")):
                w = A.words(buf, at, A.ALNUM, lower=True)
                w.hash |= A.U(1)
                m = np.concatenate(search(w, suffixes, items))
                m = m[np.argsort(m[:, 0], kind="stable")]
                n.append(np.diff(w.first))
                sizes.append(np.bincount(m[:, 0], minlength=j - i))
                rows.append(m)
            m = np.concatenate(rows) if rows else np.zeros((0, 5), np.int64)
            offsets = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int32)
            values = pa.StructArray.from_arrays([item_ids.take(pa.array(m[:, 1])), *[pa.array(np.ascontiguousarray(m[:, k])) for k in range(2, 5)]], fields=list(MATCH))
            yield pa.record_batch([batch.column("doc_id"), batch.column("dh"), pa.array(np.concatenate(n)), pa.ListArray.from_arrays(pa.array(offsets), values)], schema=schema)

    return spare(run), "doc_id long, dh long, n_words long, matches array<struct<item_id:long,start:long,item_start:long,length:long>>"


def find_matches(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """(doc_id, dh, n_words, matches) of every document; matches have item_id, start, item_start and length, in words, and are as long as they can be.

    Words are lower-cased (A-Z) runs of digits, letters and non-ASCII characters.  An item of fewer than ``length`` words
    matches as a whole; items and documents without words, nulls included, match nothing.  Items whose item_id is null are
    found with a null item_id.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("dh"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text")).where("item_text is not null").distinct()
    blocks = 1 + (items.agg(F.sum(F.octet_length("item_text") + 16)).first()[0] or 0) // block
    out = None
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(blocks)) == b) if blocks > 1 else items
        table = part.toArrow()
        tests = spark.sparkContext.broadcast((*test_suffixes(table["item_text"].combine_chunks(), length), table["item_id"].combine_chunks()))
        found = docs.mapInArrow(*_matches(tests))
        if out is None:
            out = found
        else:
            out = out.union(found)
    if blocks > 1:
        some = F.aggregate(F.collect_list("matches"), F.expr("array()").cast("array<struct<item_id:long,start:long,item_start:long,length:long>>"), lambda a, x: F.concat(a, x))
        out = out.groupBy("doc_id", "dh").agg((F.count("*") / blocks).cast("int").alias("copies"), F.max("n_words").alias("n_words"), some.alias("matches"))
        out = out.withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))).select("doc_id", "dh", "n_words", F.array_distinct("matches").alias("matches"))
    return out


def _digest():
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("longest", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            m = batch.column("matches")
            n = batch.column("n_words").to_numpy()
            size = np.diff(m.offsets.to_numpy())
            hit, items, longest, digest = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), [empty] * len(n)
            for i in np.flatnonzero(size).tolist():
                v = m[i].values
                start, length = v.field("start").to_numpy(), v.field("length").to_numpy()
                hit[i] = A.covered(n[i], start, start + length).sum()
                longest[i] = length.max()
                ids = set(v.field("item_id").to_pylist())
                items[i], digest[i] = len(ids), hashlib.sha256(",".join(sorted(str(x) for x in ids if x is not None)).encode()).hexdigest()
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_words"), pa.array(hit), pa.array(items), pa.array(digest), pa.array(hit > 0), pa.array(longest)], schema=schema)

    return run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long"


def decontaminate(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH, least: int = 1) -> DataFrame:
    """The documents, all columns, that share no window with a benchmark item of ``least`` words or more; rows whose text is null stay.

    ``least`` is at most ``length``.
    """
    if least > length:
        raise ValueError(f"least = {least} is more than length = {length}")
    # a match of an item of fewer than length words is the whole item
    bad = find_matches(docs, benchmark, length).where(F.exists("matches", lambda m: m["length"] >= least)).select("doc_id", "dh").distinct().toDF("c_id", "c_dh")
    bad = kept(bad, "contaminated")  # so that its size is known when the join is planned
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col("c_id")) & (F.xxhash64("text") == F.col("c_dh")), "left_anti")


def op4(spark, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return find_matches(read("documents"), read("benchmark")).mapInArrow(*_digest())
