"""Transitive closure over parent-child edges."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def closure(edges: DataFrame, parent: str, child: str, max_depth: int | None = None) -> DataFrame:
    """``ancestor, descendant, depth`` (the least) over any graph, cycles included.

    Rounds go on until one finds nothing new; beyond a given ``max_depth`` that is an error.

    Semi-naive: each round joins only the pairs that the round before has found
    and keeps those that are new. A round is checkpointed, so the plan stays short.
    """
    step = edges.select(F.col(parent).alias("p"), F.col(child).alias("c")).where("p is not null and c is not null").distinct()
    fresh = step.select(F.col("p").alias("ancestor"), F.col("c").alias("descendant"), F.lit(1).alias("depth"))
    reached = fresh
    for depth in count(2):
        longer = fresh.join(step, F.col("descendant") == F.col("p")).select("ancestor", F.col("c").alias("descendant"), F.lit(depth).alias("depth")).distinct()
        fresh = checkpointed(longer.join(reached.select("ancestor", "descendant"), ["ancestor", "descendant"], "left_anti"))
        if fresh.isEmpty():
            return reached
        if max_depth is not None and depth > max_depth:
            raise ValueError(f"pairs more than {max_depth} steps apart")
        reached = checkpointed(reached.unionByName(fresh)) if depth % 16 == 0 else reached.unionByName(fresh)


def tree_closure_sql(spark, edges: DataFrame, parent: str, child: str) -> DataFrame:
    """The same over a forest, as one recursive query; rows repeat if a node has two paths.

    Spark itself stops a recursion of over 100 levels with an error; ``closure`` has no such limit.
    """
    edges.select(F.col(parent).alias("p"), F.col(child).alias("c")).createOrReplaceTempView("__tree_edges")
    return spark.sql(
        """
        WITH RECURSIVE walk (ancestor, descendant, depth) AS (
            SELECT p, c, 1 FROM __tree_edges
            UNION ALL
            SELECT w.ancestor, e.c, w.depth + 1 FROM walk w JOIN __tree_edges e ON w.descendant = e.p
        )
        SELECT * FROM walk
        """
    )
