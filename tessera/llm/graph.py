"""Connected components of a link table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import drop, kept


def settled(edges: DataFrame) -> bool:
    """Whether each v of edges(v, m), v > m, has one m and no m is a v: then each m is the least of its component."""
    ends = edges.selectExpr("v as node", "1 as up", "0 as down").union(edges.selectExpr("m", "0", "1"))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not ends.where("up > 1 or up = 1 and down = 1").agg(F.count("*")).first()[0]


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of links(a, b); component is the smallest node that it reaches.

    Alternating large-star and small-star rounds: each node's larger, then its smaller neighbours move to
    its least neighbour, until all are stars; the number of rounds grows with the logarithm of the longest path.
    Nothing is gathered by node, so a node with very many links is no single task's matter.  Null ends and
    self-links are ignored; an empty table gives no rows.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct()
    edges = kept(edges, "edges")
    for _ in range(rounds):
        if settled(edges):
            break
        both = edges.union(edges.select("m", "v"))
        low = both.groupBy("v").agg(F.min("m").alias("m2")).select("v", F.least("v", "m2").alias("low"))
        large = both.join(low, "v").where("m > v").select(F.col("m").alias("v"), F.col("low").alias("m")).where("v <> m")
        low = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(low, "v")
        small = small.select("v", F.col("low").alias("m")).union(small.select(F.col("m").alias("v"), F.col("low").alias("m"))).where("v <> m").distinct()
        new = kept(small, "edges")
        drop(edges)
        edges = new
    else:
        raise RuntimeError("components did not settle")
    lows = edges.groupBy("v").agg(F.min("m").alias("component"))
    return lows.select(F.col("v").alias("node"), "component").union(edges.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct())
