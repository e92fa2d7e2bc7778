"""Connected components by alternating large-star and small-star steps, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm._spark import Scratch


def components(edges: DataFrame, tmp: Scratch) -> DataFrame:
    """node, root (the least node reachable) for every node of edges (u, v) that is not its own root.

    Each step writes its edges to the shared folder. Steps grow with the logarithm of the largest component.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = tmp.table(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = None
    while (found := state(now)) != last:
        last = found
        both = now.union(now.select("v", "u"))
        # tables on both sides of a join, so that Spark can split the neighbours of a star's centre
        least = tmp.table(both.groupBy("u").agg(F.min("v").alias("m")))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = tmp.table(large)
        small_least = tmp.table(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(small_least, "u").select("u", "v", "m")
        after = tmp.table(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        tmp.drop(now, large, least, small_least)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
