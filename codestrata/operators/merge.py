"""Merging rows into graph nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def present(value: Column, kind: str) -> Column:
    """Whether a property counts as given: not null, and not an empty list."""
    return value.isNotNull() & (F.size(value) > 0) if kind.startswith("array") else value.isNotNull()


def merge_nodes(rows: DataFrame, keys: list[str], seq: str, labels: str | None = None) -> DataFrame:
    """One row for each key: of each property the latest that is given, labels as an ordered union.

    Every aggregate combines before the shuffle, so a shared node that almost
    every row mentions stays cheap.
    """
    kinds = dict(rows.dtypes)
    out = []
    for name in rows.columns:
        if name in (*keys, seq, labels):
            continue
        out.append(F.max_by(name, F.when(present(F.col(name), kinds[name]), F.col(seq))).alias(name))
    if labels is None:
        return rows.groupBy(*keys).agg(*out)
    # First-seen order: the least (seq, place) of each label; labels are few, rows are not.
    each = rows.select(*keys, seq, F.posexplode(labels).alias("__at", "__label"))
    first = each.groupBy(*keys, "__label").agg(F.min(F.struct(seq, "__at")).alias("__first"))
    union = first.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("__first", "__label"))), lambda x: x["__label"]).alias(labels))
    merged = rows.groupBy(*keys).agg(*out) if out else rows.select(*keys).distinct()
    return merged.join(union, keys)


def dedupe_edges(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The latest whole row of each (type, from, to)."""
    rest = [c for c in rows.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("__row"))
    return latest.select(*keys, "__row.*")


def weighted_edges(pairs: DataFrame, source: str = "src", target: str = "dst", drop_self: bool = True) -> DataFrame:
    """``source, target, weight``; edges from a node to itself go if asked."""
    kept = pairs.where(F.col(source) != F.col(target)) if drop_self else pairs
    return kept.groupBy(source, target).agg(F.count("*").alias("weight"))


def number_within(rows: DataFrame, owner: list[str], order: list, name: str = "ordinal") -> DataFrame:
    """Zero-based place of each row in its owner."""
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(*owner).orderBy(*order)) - 1).cast("long"))


def in_batches(rows: DataFrame, group: list[str], order: list, size: int = 500, name: str = "batch", spread: int = 100_000) -> DataFrame:
    """Batches of ``size`` rows in each group, in the order of ``order`` (nulls last), all full but the last.

    Rows are dealt by ranges of about ``spread`` rows, so that a group of any size
    is spread over tasks; a range's first place in a group is the sum of the ranges
    before it. The deal is written, as another one would have other ranges.
    ``order`` tells the rows of a group apart.
    """
    by = [F.col(c).asc_nulls_last() for c in order]
    ranges = max(1, -(-rows.count() // spread))
    dealt = checkpointed(rows.repartitionByRange(ranges, *group, *by).withColumn("__part", F.spark_partition_id()))
    alike = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in group]
    place = F.row_number().over(Window.partitionBy(*group, "__part").orderBy(*by)) - 1
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(*group, "__part").agg(F.count("*").alias("__k")).withColumn("__first", F.coalesce(F.sum("__k").over(before), F.lit(0)))
    parts = parts.select(*[F.col(c).alias(f"__{c}") for c in group], F.col("__part").alias("__p"), "__first")
    numbered = dealt.withColumn("__at", place).join(parts, [*alike, F.col("__part") == F.col("__p")])
    return numbered.withColumn(name, F.floor((F.col("__at") + F.col("__first")) / F.lit(size)).cast("long")).select(*rows.columns, name)


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has; empty if the keys are unique."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def assert_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows``, or an error that names some keys that repeat."""
    found = duplicate_keys(rows, keys).limit(3).collect()
    if found:
        raise ValueError(f"duplicate keys {keys}: {found}")
    return rows


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first whole row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("__row")).select(*keys, "__row.*")


def implicit_members(owners: DataFrame, members: DataFrame, on: str, default: dict[str, Column]) -> DataFrame:
    """``members`` and, for each owner without one, a row made of ``default`` columns."""
    missing = owners.select(on).join(members.select(on), on, "left_anti").withColumns(default)
    return members.unionByName(missing, allowMissingColumns=True)


def joined_text(rows: DataFrame, owner: list[str], order: str, text: str, separator: str = "\n", name: str = "joined") -> DataFrame:
    """Texts of each owner in order, nulls skipped."""
    parts = F.sort_array(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(order, text))))
    return rows.groupBy(*owner).agg(F.array_join(F.transform(parts, lambda x: x[text]), separator).alias(name))


def sorted_set(rows: DataFrame, owner: list[str], value: str, name: str) -> DataFrame:
    """The distinct values of each owner, sorted."""
    return rows.groupBy(*owner).agg(F.sort_array(F.collect_set(value)).alias(name))
