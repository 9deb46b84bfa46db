"""What edges lead to: all reachable pairs, and components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.sources.folders import cut


def reachable(edges: DataFrame) -> DataFrame:
    """All pairs (a, b) with a path of one or more edges (a, b) from a to b; rows with a null are no edge.

    Semi-naive with doubling: each round joins the pairs that the last one found with all pairs so far, on
    either side, so paths twice as long are found each round and no join is made twice. The number of
    rounds is the logarithm of the longest shortest path. Pairs of a round are cut from their lineage.
    """
    fresh = known = cut(edges.where("a is not null and b is not null").select("a", "b").distinct())
    while True:
        onwards = fresh.select("a", F.col("b").alias("x")).join(known.select(F.col("a").alias("x"), "b"), "x")
        before = known.select("a", F.col("b").alias("x")).join(fresh.select(F.col("a").alias("x"), "b"), "x")
        found = onwards.select("a", "b").unionByName(before.select("a", "b")).distinct()
        fresh = cut(found.join(known, ["a", "b"], "left_anti"))
        if fresh.isEmpty():
            return known
        known = cut(known.unionByName(fresh))


def components(edges: DataFrame) -> DataFrame:
    """v, root for each vertex of the edges (a, b), taken both ways: the smallest vertex of its component.

    Each round a vertex takes the smallest root around it and then that root's root (pointer doubling), so
    rounds grow with the logarithm of a component's width. The smallest root around a vertex is summed
    in the tasks first, so a vertex with very many edges is many tasks. Rows with a null are no edge; an
    edge from a vertex to itself is one.
    """
    pairs = edges.where("a is not null and b is not null")
    both = cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = cut(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("a"), F.min("b")).alias("root")))
    while True:
        around = both.join(roots.select(F.col("v").alias("b"), "root"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("near"))
        nearer = roots.join(around, "v").select("v", "root", F.least("root", "near").alias("x"))
        jump = roots.select(F.col("v").alias("x"), F.col("root").alias("far"))
        moved = cut(nearer.join(jump, "x").select("v", "root", F.least("x", "far").alias("new")))
        roots = moved.select("v", F.col("new").alias("root"))
        if moved.where("new != root").isEmpty():
            return roots
