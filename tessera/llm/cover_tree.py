"""Embedding near-duplicates by dual traversal of cover trees.

Vectors are compared on the unit sphere, where cosine c is the chord
sqrt(2 - 2c).  A cover tree's nodes at each level have at most half the radius
of those above; a pair of nodes whose centres are further apart than the sum of
their covering radii and the chord of the threshold holds no linked pair.

Equal vectors are one point with a count.  The points of a label are dealt into
blocks of bounded size, and each pair of blocks is one task's two trees.  Tasks
return counts and local components, not pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.graph import components
from tessera.llm.shared import kept

COSINE = 0.98
BLOCK = 2048
LEAF = 16


class Node:
    __slots__ = ("center", "radius", "points", "children")

    def __init__(self, center: int, radius: float, points: np.ndarray) -> None:
        self.center, self.radius, self.points = center, radius, points
        self.children: list[Node] = []


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


def tree(x: np.ndarray, points: np.ndarray) -> Node:
    """A cover tree of the given rows of x; children have their true covering radius, at most half of the level's bound."""
    d = apart(x[points], x[points[:1]])[:, 0]
    root = Node(int(points[0]), float(d.max()), points)
    todo = [(root, 2.0)]
    while todo:
        node, bound = todo.pop()
        bound = min(bound, max(node.radius, 1e-12)) / 2
        if len(node.points) <= LEAF or node.radius < 1e-9:
            continue
        rest = node.points
        while len(rest):
            c = rest[0]
            d = apart(x[rest], x[c : c + 1])[:, 0]
            inside = d <= bound
            inside[0] = True
            node.children.append(Node(int(c), float(d[inside].max()), rest[inside]))
            rest = rest[~inside]
        todo += [(k, bound) for k in node.children]
    return root


def linked(x: np.ndarray, a: Node, b: Node, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of every pair with i under a, j under b and cosine at least the threshold; of one tree with itself, i < j."""
    reach = np.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    todo = [(a, b)]
    while todo:
        p, q = todo.pop()
        if not p.children and not q.children:
            i, j = np.nonzero(x[p.points] @ x[q.points].T >= cosine)
            left.append(p.points[i])
            right.append(q.points[j])
            continue
        ps, qs = p.children or [p], q.children or [q]
        d = apart(x[[n.center for n in ps]], x[[n.center for n in qs]])
        near = d <= np.array([n.radius for n in ps])[:, None] + np.array([n.radius for n in qs])[None, :] + reach
        if p is q:
            near = np.triu(near)
        todo += [(ps[i], qs[j]) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True)]
    i, j = np.concatenate(left), np.concatenate(right)
    if a is b:
        i, j = np.minimum(i, j), np.maximum(i, j)
        both = np.unique(i * len(x) + j)
        i, j = both // len(x), both % len(x)
        i, j = i[i < j], j[i < j]
    return i, j


def local(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least place that each of n places reaches."""
    low = np.arange(n)
    while len(i):
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[new]
        if (new == low).all():
            break
        low = new
    return low


def _pair(cosine: float):
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("rep", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        first = table["i"][0].as_py() == table["j"][0].as_py()
        block, nodes, copies = table["b"].to_numpy(), table["node"].to_numpy(), table["copies"].to_numpy()
        flat = table["embedding"].combine_chunks()
        x = flat.flatten().to_numpy().astype(float).reshape(len(nodes), -1)
        order = np.lexsort((nodes, block))
        x, block, nodes, copies = x[order], block[order], nodes[order], copies[order]
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        if first:
            root = tree(x, np.arange(len(x)))
            i, j = linked(x, root, root, cosine)
        else:
            cut = int(np.searchsorted(block, block[-1]))
            if not 0 < cut < len(x):
                return schema.empty_table()
            i, j = linked(x, tree(x, np.arange(cut)), tree(x, np.arange(cut, len(x))), cosine)
        links = np.bincount(i, copies[j], len(x)) + np.bincount(j, copies[i], len(x))
        some = links > 0
        rep = nodes[local(len(x), i, j)]
        return pa.table([pa.array(nodes[some]), pa.array(links[some].astype(np.int64)), pa.array(rep[some])], schema=schema)

    return run, "node long, links long, rep long"


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors(vec_id, embedding, label).

    Rows link when their labels are equal and not null and their cosine, in double precision, is at least ``cosine``.
    Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing, nor do vectors of
    different length.  Rows with equal vectors and labels link; a row that is there twice links with itself.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("embedding", lambda x: x != 0)
    v = v.withColumn("ok", F.col("label").isNotNull() & F.coalesce(~bad, F.lit(False)))
    v = v.withColumns({"h": F.when(F.col("ok"), F.xxhash64("label", "embedding")), "h2": F.when(F.col("ok"), F.hash("embedding", "label"))})
    ids = v.select("vec_id", "h", "h2")
    points = v.where("ok").groupBy("h", "h2").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    points = kept(points.withColumns({"dim": F.size("embedding"), "node": F.coalesce("node", "h")}), "points")
    sizes = points.groupBy("label", "dim").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = points.join(sizes, ["label", "dim"]).withColumn("b", F.pmod(F.xxhash64("h", F.lit(1)), "blocks").cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("b", "o"), "j": F.greatest("b", "o")})
    run, schema = _pair(cosine)
    pairs = dealt.groupBy("label", "dim", "i", "j").applyInArrow(run, schema)
    pairs = kept(pairs, "links")
    counts = pairs.groupBy("node").agg(F.sum("links").alias("links"))
    comps = components(pairs.select(F.col("node").alias("a"), F.col("rep").alias("b")))
    of = points.select("node", "copies", F.col("h").alias("c"), F.col("h2").alias("c2")).join(counts, "node", "left").join(comps, "node", "left")
    out = ids.join(of, (F.col("h") == F.col("c")) & (F.col("h2") == F.col("c2")), "left")
    out = out.select("vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"), F.coalesce("component", "node", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op5(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
