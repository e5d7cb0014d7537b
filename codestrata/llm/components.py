"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (smallest node reachable) for each node that has an edge.

    Each step is a minimum per node (combined before the shuffle) and a join of
    two stored tables, so a node with very many neighbours is split by adaptive
    execution. Every step is written to the shared folder. Nulls and loops are
    ignored; an empty table gives an empty result.
    """
    pairs = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    pairs = stored(pairs.distinct(), "edges")
    while True:
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a"))
        lowest = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lowest")
        large = stored(pairs.join(lowest, pairs["b"] == lowest["u"]).select("a", F.col("m").alias("b")).distinct(), "large")
        own = stored(large.groupBy("a").agg(F.min("b").alias("m")), "own")
        small = large.join(own, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = stored(small.union(own.select("a", F.col("m").alias("b"))).distinct(), "edges")
        roots = pairs.select(F.col("b").alias("a")).distinct()
        several = pairs.groupBy("a").count().where("count > 1").select("a")
        if not pairs.select("a").join(roots, "a", "left_semi").select("a").union(several).limit(1).count():
            break
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(pairs.select("b", "b").distinct())
