"""Differences between a new and a stored state, and incremental replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_diff(current: DataFrame, stored: DataFrame, key: str, hash_column: str) -> DataFrame:
    """``key, status``: ``new``, ``changed`` or ``same`` for each current unit; a null hash counts as changed."""
    old = stored.select(F.col(key).alias("__key"), F.col(hash_column).alias("__hash"), F.lit(True).alias("__there"))
    status = (
        F.when(F.col("__there").isNull(), "new")
        .when(F.col(hash_column).isNull() | ~F.col(hash_column).eqNullSafe(F.col("__hash")), "changed")
        .otherwise("same")
    )
    return current.join(old, F.col(key) == F.col("__key"), "left").select(key, status.alias("status"))


def changed_units(current: DataFrame, stored: DataFrame, key: str, hash_column: str) -> DataFrame:
    return hash_diff(current, stored, key, hash_column).where("status != 'same'").select(key)


def vanished(current: DataFrame, stored: DataFrame, key: str, full_run: bool = True) -> DataFrame:
    """Stored keys that are no longer there; a partial run can tell of none."""
    gone = stored.select(key).join(current.select(key), key, "left_anti")
    return gone if full_run else gone.limit(0)


def overlay(old: DataFrame, new: DataFrame, key: str, flag: str = "is_modified") -> DataFrame:
    """Old rows without new ones, and the new rows, which are marked."""
    kept = old.join(new.select(key), key, "left_anti").withColumn(flag, F.lit(False))
    return kept.unionByName(new.withColumn(flag, F.lit(True)), allowMissingColumns=True)


def replace_units(
    stored_nodes: DataFrame,
    stored_edges: DataFrame,
    new_nodes: DataFrame,
    new_edges: DataFrame,
    changed: DataFrame,
    *,
    full_run: bool = True,
    key: str = "key",
    unit: str = "unit",
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after the changed units were replaced.

    Stored edges out of a changed unit go first. Nodes of a changed unit that the
    new state lacks go with every edge at them; edges from other units live on as
    long as both ends do. Nodes without a unit are shared: they are always merged
    and never vanish. In a full run, units that the new state lacks vanish too.
    Edges have ``type, src, dst`` and the ``unit`` of their source.
    """
    touched = changed.select(F.col(unit).alias("__unit")).distinct()
    if full_run:
        gone = stored_nodes.where(F.col(unit).isNotNull()).select(unit).distinct().join(new_nodes.select(unit).distinct(), unit, "left_anti")
        touched = touched.union(gone.select(F.col(unit).alias("__unit"))).distinct()
    in_touched = lambda df, how: df.join(touched, F.col(unit) == F.col("__unit"), how)
    keep_nodes = in_touched(stored_nodes, "left_anti")
    fresh = new_nodes.where(F.col(unit).isNull()).unionByName(in_touched(new_nodes, "left_semi"))
    nodes = keep_nodes.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)
    fresh_edges = new_edges.where(F.col(unit).isNull()).unionByName(in_touched(new_edges, "left_semi"))
    kept_edges = in_touched(stored_edges, "left_anti").join(fresh_edges.select("type", "src", "dst"), ["type", "src", "dst"], "left_anti")
    edges = kept_edges.unionByName(fresh_edges, allowMissingColumns=True)
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(F.col(key).alias(end)), end, "left_semi")
    return nodes, edges
