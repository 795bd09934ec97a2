"""Connected components of a link table, on the cluster: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of `links` (a, b); root is the smallest node that can be reached.

    Large-star links every larger neighbour of a node to the smallest of the node and its neighbours; small-star does so
    for smaller neighbours. Both keep the components and turn each one into a star around its smallest node after few
    rounds (about the square of the logarithm of the longest path). All steps are aggregates and merge joins on the node (a
    broadcast would be built on the driver); nothing but a row count comes to the driver. Self-links and repeated links are fine; no links give no rows.
    """
    edges = checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = checkpointed(small.filter("u <> v").distinct())
        # a fixed point shows as the same links twice: compare their number and a sum of hashes
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
