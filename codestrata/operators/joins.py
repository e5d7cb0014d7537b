"""Joins of names that are spelled in different ways, and call resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fuzzy_signature_join(sites: DataFrame, declared: DataFrame, site_id: str) -> DataFrame:
    """``sites`` with ``declared_id``: same owner, name and arity, each parameter a suffix of the other's; the first declared wins.

    Both have ``owner, name, params (array)``; ``declared`` also ``declared_id``.
    An equi-join on owner, name and arity; only the suffix test is a filter.
    """
    left = sites.withColumn("__arity", F.size("params"))
    right = declared.select(F.col("owner").alias("__o"), F.col("name").alias("__n"), F.size("params").alias("__a"), F.col("params").alias("__p"), "declared_id")
    suffix = F.forall(F.arrays_zip("params", "__p"), lambda x: x["params"].endswith(x["__p"]) | x["__p"].endswith(x["params"]))
    joined = left.join(right, (F.col("owner") == F.col("__o")) & (F.col("name") == F.col("__n")) & (F.col("__arity") == F.col("__a")) & suffix)
    best = joined.groupBy(site_id).agg(F.min("declared_id").alias("declared_id"))
    return sites.join(best, site_id, "left")


def virtual_targets(sites: DataFrame, subtypes: DataFrame, instantiated: DataFrame, callables: DataFrame) -> DataFrame:
    """``caller, callee, site``: rapid type analysis in one pass.

    ``sites`` (site, caller, receiver, signature), ``subtypes`` (ancestor,
    descendant, depth, each type with itself at 0), ``instantiated`` (type) and
    ``callables`` (callable_id, owner, signature). Every type below the receiver
    that is ever created answers with its nearest declaration upwards. What a
    receiver and signature lead to is found once, however many sites have them.
    """
    below = subtypes.select(F.col("ancestor").alias("receiver"), F.col("descendant").alias("runtime"))
    live = below.join(instantiated.select(F.col("type").alias("runtime")).distinct(), "runtime", "left_semi")
    upwards = subtypes.select(F.col("descendant").alias("runtime"), F.col("ancestor").alias("owner"), "depth")
    answers = live.select("runtime").distinct().join(upwards, "runtime").join(callables, "owner")
    nearest = answers.groupBy("runtime", "signature").agg(F.min_by("callable_id", F.struct("depth", "callable_id")).alias("callee"))
    asked = sites.select("receiver", "signature").distinct()
    targets = asked.join(live, "receiver").join(nearest, ["runtime", "signature"]).select("receiver", "signature", "callee").distinct()
    return sites.join(targets, ["receiver", "signature"]).select("caller", "callee", "site").distinct()
