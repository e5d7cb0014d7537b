"""Python functions over small groups of rows, many groups in one call."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Calls that groups are dealt to by hash: a call costs some milliseconds however little it does.
CALLS = 4096


def _frame(made: list[tuple], schema: str) -> pd.DataFrame:
    columns = [c.split() for c in schema.split(", ")]
    out = pd.DataFrame(made, columns=[name for name, _ in columns])
    return out.astype({name: "Int64" for name, kind in columns if kind in ("int", "long")})


def _split(frame: pd.DataFrame, keys: list[str], order: list[str]) -> Iterator[tuple[tuple, list[list]]]:
    """Key and columns, as lists, of each group."""
    frame = frame.sort_values([*keys, *order])
    columns = [frame[c].tolist() for c in frame.columns if c not in (*keys, "__call")]
    at = 0
    for key, same in groupby(zip(*[frame[k].tolist() for k in keys], strict=True)):
        size = sum(1 for _ in same)
        yield key, [c[at : at + size] for c in columns]
        at += size


def _dealt(rows: DataFrame, keys: list[str]):
    return rows.withColumn("__call", F.pmod(F.xxhash64(*keys), F.lit(CALLS))).groupBy("__call")


def by_group(rows: DataFrame, keys: list[str], order: list[str], one: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """``keys`` and what ``one`` makes of each group: it takes the other columns as lists in ``order`` and gives rows.

    ``schema`` names the keys first. Groups go to ``one`` whole, and a task holds
    those of one call: a 4096th of the rows, or the largest group.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return _frame([(*key, *row) for key, columns in _split(frame, keys, order) for row in one(*columns)], schema)

    return _dealt(rows, keys).applyInPandas(run, schema)


def by_groups(left: DataFrame, right: DataFrame, keys: list[str], one: Callable[[list[list], list[list]], list[tuple]], schema: str) -> DataFrame:
    """The same over groups of two tables: ``one`` takes the columns of either; none are of a group that is in the other alone."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        left, right = dict(_split(a, keys, [])), dict(_split(b, keys, []))
        return _frame([(*key, *row) for key in sorted({*left, *right}) for row in one(left.get(key, []), right.get(key, []))], schema)

    return _dealt(left, keys).cogroup(_dealt(right, keys)).applyInPandas(run, schema)
