"""Exact Jaccard join of word n-gram sets by universe partition and the pigeonhole principle.

Sets fall into size bands so that linked sets lie in one band or in
neighbouring ones.  For the sets of two neighbouring bands, linked sets differ
in at most H elements, so of m > H segments into which the hashed universe is
cut, some segment holds the same elements of both.  Each set is indexed under
the hash of its part of each segment, for its own band and for the next.

A set's empty segments would put it into one list with all others that are
empty there, so each set takes the cheapest allocation that still finds all its
partners:

*   level 0: its non-empty segments alone, if there are more than H of them;
*   level 1: also the one-deletion neighbourhoods of segments with two or more
    elements, which then count twice;
*   level 2: also its empty segments, found by other sets of that level.

Members of a list are compared with the list's least member only.  Lists that
still hold several components after that are compared with a few more members,
and what even then holds several components pair by pair, each set in its
smallest lists only: as many of its largest are left out as it must share with
any partner beyond one.  Two members of one largest list meet in that list
alone and not in each that they share, and wide sketches decide there which
pairs are formed.
Nodes of one component are not compared again, and pairs whose parity sketches
differ in more bits than linked sets can are never formed.  Every comparison that decides
is of whole sets.  Equal sets are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.llm import arrays as A
from tessera.llm.graph import components
from tessera.llm.shared import bitmap, drop, kept, maybe, spare

WIDTH = 4
NUM, DEN = 85, 100
SKETCH, WIDE = 4, 32  # words of 64 bits
#: Members of a list with which all others are compared, round by round; None: all that are left.
REPS = (4, None)
PLACE = "xxhash64(node, coalesce(doc_id, 0L))"


@cache
def bands(num: int, den: int, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sizes up to ``top``: the least size of each band, and by band H and m for it and the band below."""
    low = [1]
    while low[-1] <= top:
        low.append(low[-1] * den // num + 1)
    low.append(low[-1] * den // num + 1)
    apart, cuts = [], []
    for j in range(len(low) - 1):
        h = (den - num) * 2 * (low[j + 1] - 1) // (den + num)
        n = low[max(j - 1, 0)]
        m = h + 1
        while h and m < 2 * h + 2:  # so many that the usual set of the least size needs no more than level 0
            empty = m * np.exp(-n / m)
            if m - empty - 2 * np.sqrt(empty) >= h + 1:
                break
            m += 1
        apart.append(h)
        cuts.append(m)
    return np.array(low[:-1]), np.array(apart), np.array(cuts)


def shingles(buf: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and where each text's begin."""
    w = A.words(buf, at, A.SPACED, lower=True)
    g, ok = A.grams(w.hash, width), A.within(w.doc, width)
    g, doc = g[ok], w.doc[: len(ok)][ok]
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        own = np.array([A.grams(w.hash[w.first[i] : w.first[i + 1]], int(count[i]))[0] for i in short.tolist()], A.U)
        g, doc = np.concatenate((g, A.mix(own + count[short].astype(A.U)))), np.concatenate((doc, short))
    order = np.argsort(g)
    small = np.uint16 if len(at) < 65536 else np.int64
    order = order[np.argsort(doc[order].astype(small), kind="stable")]
    g, doc = g[order], doc[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    g, doc = g[new], doc[new]
    return g, np.searchsorted(doc, np.arange(len(at)))


def totals(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    s = np.zeros(len(x) + 1, x.dtype)
    np.cumsum(x, out=s[1:])
    return s[first[1:]] - s[first[:-1]]


def nodes_of(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each whole set."""
    n = np.diff(first)
    return A.mix(totals(A.mix(g), first) + n.astype(A.U))


def sketches(g: np.ndarray, first: np.ndarray, words: int = SKETCH) -> np.ndarray:
    """Parity of the elements that fall on each bit: two sets differ in at least as many elements as bits."""
    n, bits, step = len(first) - 1, 64 * words, (1 << 14) // words
    out = np.zeros((n, words), np.int64)
    for i in range(0, n, step):
        j = min(n, i + step)
        part = g[first[i] : first[j]]
        row = np.repeat(np.arange(j - i), np.diff(first[i : j + 1]))
        bit = (A.mix(part + A.U(7)) & A.U(bits - 1)).astype(np.int64)
        odd = (np.bincount(row * bits + bit, minlength=(j - i) * bits) & 1).astype(np.uint8)
        out[i:j] = np.packbits(odd.reshape(j - i, -1), axis=1).view(np.int64)
    return out


def segments(g: np.ndarray, m: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The segment of each element where its set's universe is cut into m[set], and where each set's parts begin."""
    seg = ((g >> A.U(32)) * m[doc].astype(A.U) >> A.U(32)).astype(np.int64)
    new = np.ones(len(g), bool)
    new[1:] = (seg[1:] != seg[:-1]) | (doc[1:] != doc[:-1])
    return seg, np.flatnonzero(new)


def shared(g: np.ndarray, first: np.ndarray, num: int, den: int) -> np.ndarray:
    """Least number of lists that each set shares with a linked one, in the scheme with an even and the one with an odd number.

    At level 0 at most H of its non-empty segments differ; at others one list is certain.
    """
    n = np.diff(first)
    out = np.ones((2, len(n)), np.int64)
    if not n.any():
        return out
    low, apart, cuts = bands(num, den, 1 << int(n.max()).bit_length())
    own = np.searchsorted(low, n, "right") - 1
    doc = np.repeat(np.arange(len(n)), n)
    for scheme in (own, own + 1):
        _, b = segments(g, cuts[scheme], doc)
        out[scheme & 1, np.arange(len(n))] = np.maximum(np.bincount(doc[b], minlength=len(n)) - apart[scheme], 1)
    return out


def signatures(g: np.ndarray, first: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set) of every list that each non-empty set is in; the lowest bit is that of the scheme's number."""
    n = np.diff(first)
    live = np.flatnonzero(n)
    if not len(live):
        return np.zeros(0, A.U), np.zeros(0, np.int64)
    low, apart, cuts = bands(num, den, 1 << int(n.max()).bit_length())
    own = np.searchsorted(low, n, "right") - 1
    doc = np.repeat(np.arange(len(n)), n)
    mixed = A.mix(g + A.U(3))
    sig, who, odd = [], [], []
    for scheme in (own, own + 1):
        m, h = cuts[scheme], apart[scheme]
        seg, b = segments(g, m, doc)
        part = np.append(b, len(g))
        size, of, s = np.diff(part), doc[b], totals(mixed, part)
        salt = A.mix((scheme[of] * 2**32 + seg[b]).astype(A.U))
        sig.append(A.mix(s + salt))
        who.append(of)
        weight = np.bincount(of, minlength=len(n))
        level = (weight <= h).astype(np.int8)
        level[np.bincount(of, np.minimum(size, 2), len(n)) <= h] = 2
        level[n == 0] = 0
        wide = np.flatnonzero((level[of] > 0) & (size > 1))
        if len(wide):
            k = A.spread(b[wide], size[wide])
            part = np.repeat(wide, size[wide])
            sig.append(A.mix(s[part] - mixed[k] + salt[part]))
            who.append(of[part])
        bare = np.flatnonzero(level == 2)
        if len(bare):
            d = np.repeat(bare, m[bare])
            k = A.spread(np.zeros(len(bare), np.int64), m[bare])
            at = np.zeros(len(n), np.int64)
            at[bare] = np.cumsum(m[bare]) - m[bare]
            none = np.ones(len(d), bool)
            full = level[of] == 2
            none[at[of[full]] + seg[b][full]] = False
            sig.append(A.mix(A.mix((scheme[d] * 2**32 + k).astype(A.U)[none]) + A.U(11)))
            who.append(d[none])
        odd += [scheme[w] & 1 for w in who[len(odd) :]]
    return np.concatenate(sig) & ~A.U(1) | np.concatenate(odd).astype(A.U), np.concatenate(who)


def _sets(width: int, num: int, den: int):
    names = ["doc_id", "dh", "n", "node", "even", "odd", *[f"s{k}" for k in range(SKETCH)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, at in A.chunks(batch.column("text")):
                g, first = shingles(buf, at, width)
                s = sketches(g, first)
                wide = pa.ListArray.from_arrays(pa.array(np.arange(0, WIDE * (j - i) + 1, WIDE, np.int32)), pa.array(sketches(g, first, WIDE).ravel()))
                yield pa.record_batch([batch.column("doc_id").slice(i, j - i), batch.column("dh").slice(i, j - i), pa.array(np.diff(first)), A.signed(nodes_of(g, first)), *map(pa.array, shared(g, first, num, den)), *[pa.array(np.ascontiguousarray(s[:, k])) for k in range(SKETCH)], wide], names=[*names, "wide"])

    return spare(run), ", ".join([*[f"{c} long" for c in names], "wide array<long>"])


def _lists(width: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, at in A.chunks(batch.column("text")):
                g, first = shingles(buf, at, width)
                node = nodes_of(g, first)
                sig, who = signatures(g, first, num, den)
                once = np.zeros(len(node), bool)
                once[np.unique(node, return_index=True)[1]] = True
                sig, who = sig[once[who]], who[once[who]]
                yield pa.record_batch([A.signed(sig), A.signed(node[who])], names=["sig", "node"])

    return spare(run), "sig long, node long"


def _whole(width: int, want):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nums = batch.column("doc_id").fill_null(0).to_numpy()
            for i, j, buf, at in A.chunks(batch.column("text")):
                g, first = shingles(buf, at, width)
                node = nodes_of(g, first)
                hit = np.flatnonzero(maybe(want.value, A.xxhash64(node.view(np.int64), nums[i:j])) & (np.diff(first) > 0))
                size = np.diff(first)[hit]
                cells = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), A.signed(g[A.spread(first[hit], size)]))
                yield pa.record_batch([A.signed(node[hit]), cells], names=["node", "cells"])

    return spare(run), "node long, cells array<long>"


def near(num: int, den: int) -> str:
    """What every linked pair fulfils: sizes close enough, and no more odd sketch bits than elements that may differ."""
    odd = " + ".join(f"bit_count(x.s{k} ^ y.s{k})" for k in range(SKETCH))
    return f"{den} * least(x.n, y.n) >= {num} * greatest(x.n, y.n) and {den + num} * ({odd}) <= {den - num} * (x.n + y.n)"


def close(num: int, den: int) -> str:
    """As ``near``, by the wide sketches: with long sets nearly every bit of the others is as often odd as not."""
    odd = " + ".join(f"bit_count(x.wide[{k}] ^ y.wide[{k}])" for k in range(WIDE))
    return f"{den + num} * ({odd}) <= {den - num} * (x.n + y.n)"


def wides(of: DataFrame, table: DataFrame) -> DataFrame:
    """(node, n, wide) of the nodes of ``of``(node, doc_id), once each."""
    e = of.toDF("e_node", "e_id")
    return table.join(e, (F.col("node") == F.col("e_node")) & F.col("doc_id").eqNullSafe(F.col("e_id"))).select("node", "n", "wide").dropDuplicates(["node"])


def verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, table: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets link, as a table; a pair may be there twice.

    Sets are moved for pairs that also fulfil the bound on odd bits of their wide sketches.
    """
    spark = docs.sparkSession
    ends = lambda p: p.select(F.col("a").alias("node")).union(p.select("b")).distinct().join(nodes.select("node", "doc_id"), "node")
    wide = wides(ends(pairs), table)
    both = pairs.join(wide.toDF("a", "na", "x"), "a").join(wide.toDF("b", "nb", "y"), "b")
    odd = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    pairs = kept(both.where((den + num) * odd <= (den - num) * (F.col("na") + F.col("nb"))).select("a", "b"), "close")
    ends = ends(pairs)
    want = spark.sparkContext.broadcast(bitmap(ends, F.expr(PLACE)))
    sets = docs.mapInArrow(*_whole(width, want))
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    # row by row in the JVM, so that long sets never meet in one batch
    both = both.withColumn("common", F.size(F.array_intersect("x", "y")))
    linked = F.expr(f"{den}L * common >= {num}L * (size(x) + size(y) - common)")
    out = kept(both.where(linked).select("a", "b"), "links")
    drop(pairs)
    return out


def rarest(of: DataFrame) -> DataFrame:
    """The rows (sig, node, component, even, odd) of open lists in which each node meets all that it links with outside its component.

    Such a node shares at least ``need`` open lists with the other, of the same scheme.  In one order of all lists, the least that they
    share is thus followed by need - 1 others in the order of either, so of its o lists each node needs only the first o - need + 1.
    Lists come in the order of their sizes: what very many sets have in common is left to nodes that share too little else.
    """
    by, own = W.partitionBy("sig"), W.partitionBy("node", F.expr("sig & 1"))
    of = of.withColumn("need", F.when(F.expr("sig & 1 = 0"), F.col("even")).otherwise(F.col("odd")))
    for _ in range(2):
        of = of.withColumn("o", F.count("*").over(own)).where("o >= need")
        of = of.withColumn("c0", F.min("component").over(by)).withColumn("c1", F.max("component").over(by)).where("c0 < c1").drop("c0", "c1")
    of = of.withColumn("members", F.count("*").over(by)).withColumn("o", F.count("*").over(own))
    return of.withColumn("place", F.row_number().over(own.orderBy("members", "sig"))).where("place <= o - need + 1").drop("place", "o", "need")


def ngram_components(docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id, dh) of every row of docs; sets link when den * intersection >= num * union.

    Words are lower-cased (A-Z) runs without white space.  Fewer words than ``width`` make one shingle; a text without
    words, null included, has none, links with nothing and is its own component.  component_id is the smallest doc_id
    reachable by links.  Rows with equal texts are linked; a null doc_id is never a component's smallest while another
    is there.  Other columns are ignored.  dh is xxhash64 of the text.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("dh"))
    table = kept(docs.mapInArrow(*_sets(width, num, den)), "sets")
    nodes = kept(table.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), *[F.min(c).alias(c) for c in ("n", "even", "odd")], *[F.min(f"s{k}").alias(f"s{k}") for k in range(SKETCH)]), "nodes")
    by = W.partitionBy("sig")
    lists = docs.mapInArrow(*_lists(width, num, den)).select("*", F.min("node").over(by).alias("rep"), F.max("node").over(by).alias("top"))
    lists = kept(lists.where("rep < top").select("sig", "node", "rep"), "lists")
    x, y = nodes.alias("x"), nodes.alias("y")
    stars = lists.where("node <> rep").select("node", "rep").distinct()
    stars = stars.join(x, F.col("x.node") == stars["node"]).join(y, F.col("y.node") == stars["rep"]).where(near(num, den))
    stars = kept(stars.select(F.col("y.node").alias("a"), F.col("x.node").alias("b")), "pairs")
    links = verified(docs, stars, nodes, table, width, num, den)
    comps = kept(components(links), "components")
    tested = [stars]
    for reps in REPS:
        of = lists.join(comps, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("component")).distinct()
        of = of.select("*", F.min("component").over(by).alias("c0"), F.max("component").over(by).alias("c1"), F.row_number().over(by.orderBy("node")).alias("nth"))
        of = kept(of.where("c0 < c1").drop("c0", "c1").join(nodes.drop("doc_id"), "node"), "open")
        if not reps:
            old, of = of, kept(rarest(of), "rarest")
            homes = of.groupBy("node").agg(F.max(F.struct("members", "sig")).alias("home")).select("node", "home.sig")
            drop(old)
            wide = wides(homes.select("node").join(nodes.select("node", "doc_id"), "node"), table).drop("n")
            old, of = of, kept(of.join(homes.toDF("node", "home"), "node").join(wide, "node"), "open")
            drop(old)
        x, y = of.alias("x"), (of.where(F.col("nth") <= reps) if reps else of).alias("y")
        apart = "x.component <> y.component" if reps else "x.component < y.component and (x.home <> y.home or x.home = x.sig)"
        links_maybe = near(num, den) if reps else f"{near(num, den)} and {close(num, den)}"
        pairs = x.join(y, (F.col("x.sig") == F.col("y.sig")) & F.expr(f"{apart} and {links_maybe}"))
        pairs = pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        for done in tested:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        tested.append(kept(pairs, "pairs"))
        drop(of)
        if not tested[-1].isEmpty():
            late, old = verified(docs, tested[-1], nodes, table, width, num, den), comps
            comps = kept(components(old.toDF("a", "b").union(late)), "components")
            drop(old, late)
    drop(lists, links, *tested)
    table = table.select("doc_id", "dh", "n", "node").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = table.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("least")).toDF("c", "least")
    out = table.join(least, (F.col("component") == F.col("c")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), "dh")


def one_of_each(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs, all columns, with one row of each component: the one with the smallest doc_id.  Rows without words all stay."""
    rows = ngram_components(docs, width, num, den).where("n_shingles > 0")
    rows = kept(rows, "rows")
    first = rows.groupBy("component_id").agg(F.min(F.struct("doc_id", "dh")).alias("first"))
    gone = rows.join(first, rows["component_id"].eqNullSafe(first["component_id"])).where(~F.struct("doc_id", "dh").eqNullSafe(F.col("first")))
    gone = kept(gone.select(F.col("doc_id").alias("g_id"), F.col("dh").alias("g_dh")).distinct(), "gone")
    twice = kept(rows.groupBy("doc_id", "dh").agg(F.count("*").alias("n")).where("n > 1").toDF("t_id", "t_dh", "n").select("t_id", "t_dh"), "twice")
    same = lambda a, b: F.col("doc_id").cast("long").eqNullSafe(F.col(a)) & (F.xxhash64("text") == F.col(b))
    # only rows that may be gone are moved; the texts of all others stay where they are read
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(gone, F.col("g_dh")))

    @F.pandas_udf("boolean")
    def near_gone(dh: pd.Series) -> pd.Series:
        return pd.Series(maybe(sent.value, dh.to_numpy()))

    flag = near_gone(F.xxhash64("text"))
    out = docs.where(~flag).unionByName(docs.where(flag).join(gone, same("g_id", "g_dh"), "left_anti"))
    if twice.isEmpty():
        return out
    again = out.join(twice, same("t_id", "t_dh"), "left_semi").dropDuplicates(["doc_id", "text"])
    return out.join(twice, same("t_id", "t_dh"), "left_anti").unionByName(again)


def op1(spark, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("dh")
