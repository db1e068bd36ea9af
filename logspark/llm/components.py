"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm.shared import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """node, root (the smallest node reachable) of every node with an edge, but for roots themselves.

    Edges are a, b of any order.  Each half step is a minimum by node, aggregated before the shuffle and written, then
    joined back, so a node of very many edges is dealt out by the adaptive skew join and nothing is collected."""
    now = scratch.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), f"{name}0")
    k = 0
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = scratch.write(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), f"{name}{k}l")
        large = scratch.write(both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), f"{name}{k}s")
        least = scratch.write(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}{k}m")
        met = large.join(least, "a")
        after = met.select("a", F.col("m").alias("b")).union(met.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        k += 1
        after = scratch.write(after, f"{name}{k}")
        scratch.drop(f"{name}{k - 1}l", f"{name}{k - 1}s", f"{name}{k - 1}m", f"{name}{k - 1}")
        # done when all are stars: every a has one b, which is no a itself
        stars = after.groupBy("a").count().filter("count > 1").isEmpty() and after.select("b").distinct().join(after.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty()
        if stars:
            return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now = after
