"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from larder.session import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the least of that node's neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, are tied to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    down = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(node, component) for every node of the undirected edges (u, v); the component is its least node.

    Loops, repeats and nulls are ignored. Both steps reduce each node's neighbours with
    a plain minimum, which combines before the shuffle, so a hub costs one row per task;
    its edges are then joined with that one value. Each round is written to the shared
    folder, and the last but one removed, so a lost executor repeats one round at most.
    """
    seen, current = None, work.keep(
        edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges")
    while True:
        mark = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen, before = mark, current
        large = _large_star(current).filter("u != v").distinct()
        current = work.keep(_small_star(large).filter("u != v").distinct(), "edges")
        work.drop(before)
