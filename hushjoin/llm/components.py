"""Connected components by alternating large-star and small-star, all on the executors. Hubs are dealt to several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushjoin.llm.common import Scratch, join_hot


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(20,0)))")).first())


def large_star(edges: DataFrame, n: int) -> DataFrame:
    """Link every larger neighbour of a node to the least of the node and its neighbours. edges: n / 2 at most of u, v with v < u."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
    return join_hot(both.filter("v > u"), least, "u", n, "v").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame, n: int) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them. edges: n at most."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    far = join_hot(edges, least, "u", n, "v").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return far.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (least node reachable) for every node that can reach a smaller one. edges: u, v (long) in any direction; loops are ignored."""
    now = scratch.write(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _mark(now)
    while seen[0]:
        nxt = scratch.write(small_star(large_star(now, 2 * seen[0]), seen[0]))
        mark = _mark(nxt)
        scratch.drop(now)
        now = nxt
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
