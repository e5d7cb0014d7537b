"""Analyses kept in a folder: a refresh reads the files that changed and those that use what these declare.

A table of the words of each file is the index from names to their users. A file
is analysed again if it has a word that names a declaration which a refreshed file
no longer has, has anew, or has with another meaning (signature after resolution,
supertypes, modifiers). A type that gained or lost an ancestor also stands for the
members of that ancestor and for what returns or holds the type, as a call on such a
value need not spell it. A changed body has no such words, so its file is the only
one. Users whose own declarations change their meaning by it are followed in turn.

Headers, names and the call graph are joined over the stored tables of the whole
project at each refresh; tokens, statements and calls are not.

Tables lie in buckets by file. A refresh writes the buckets of its files as a new
version, and last of all a manifest that says which version of each bucket counts,
so a run that is cut short leaves the state before it. Versions that no manifest
needs any more are not removed here.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..operators import diff
from ..plans.analyze import Analysis, analyze, call_edges
from ..session import checkpointed

_OF_TYPE = {"enum_constants": "type_id", "record_components": "type_id", "field_types": "holder", "above": "type_id"}
_OF_CALLABLE = {"arguments": "callable_id", "references": "callable_id", "methods": "callable_id"}
_TABLES = [f.name for f in fields(Analysis) if f.name != "call_edges"]


@dataclass
class Refresh:
    """``status`` (file_key, status) of the given files and ``analysed`` (file_key, round): those read, the changed ones in round 0."""

    analysis: Analysis
    status: DataFrame
    analysed: DataFrame
    version: int


def _each(build: Callable[[str], DataFrame], edges: DataFrame) -> Analysis:
    return Analysis(**{name: build(name) for name in _TABLES}, call_edges=edges)


def _with_units(a: Analysis, headers: DataFrame) -> Analysis:
    """``a`` with the file of each row as ``unit``; ``headers`` has all types of the project. Of a type declared twice the least file counts."""
    of_type = checkpointed(headers.groupBy("type_id").agg(F.min("file_key").alias("unit")))
    of_callable = checkpointed(a.callables.groupBy("callable_id").agg(F.min("file_key").alias("unit")))

    def build(name: str) -> DataFrame:
        rows = getattr(a, name)
        for keys, owner in ((_OF_TYPE, of_type), (_OF_CALLABLE, of_callable)):
            if name in keys:
                return rows.join(owner.withColumnsRenamed({owner.columns[0]: keys[name]}), keys[name])
        return rows.withColumn("unit", F.col("file_key"))

    return _each(build, a.call_edges)


def _plain(a: Analysis) -> Analysis:
    return _each(lambda name: getattr(a, name).drop("unit"), a.call_edges)


def _without(a: Analysis, units: DataFrame) -> Analysis:
    return _each(lambda name: getattr(a, name).join(units, "unit", "left_anti"), a.call_edges)


def _declared(a: Analysis, units: DataFrame) -> DataFrame:
    """``unit, word, what``: what the files of ``units`` declare, and what it means to other files."""
    simple = lambda column: F.substring_index(column, ".", -1)
    as_text = lambda *columns: F.to_json(F.struct(*columns))
    rows = [
        a.headers.select("unit", F.col("name").alias("word"), as_text("type_id", "kind", "parent_id", "modifiers", "extends_list", "implements_list", "type_parameters", "components").alias("what")),
        a.supertypes.select("unit", simple("type_id").alias("word"), as_text("type_id", "role", "ordinal", "resolved").alias("what")),
        a.methods.select("unit", F.when(F.col("name") == "<init>", simple("declarer")).otherwise(F.col("name")).alias("word"), as_text("callable_id", "wanted", "variadic", "returns", "modifiers").alias("what")),
        a.field_types.select("unit", F.col("field").alias("word"), as_text("holder", "field", "field_type").alias("what")),
    ]
    return reduce(DataFrame.unionByName, rows).join(units, "unit", "left_semi")


def _differing(before: DataFrame, after: DataFrame) -> DataFrame:
    """Distinct rows that only one of the two has."""
    both = before.withColumn("side", F.lit(0)).unionByName(after.withColumn("side", F.lit(1)))
    return both.groupBy(*before.columns).agg(F.min("side").alias("least"), F.max("side").alias("most")).where("least = most").drop("least", "most")


def changed_words(before: Analysis, after: Analysis, units: DataFrame) -> DataFrame:
    """``word``: names whose meaning to other files differs between two states, of which ``units`` were read anew."""
    words = _differing(_declared(before, units), _declared(after, units)).select("word")
    pairs = lambda a: a.above.select("type_id", "ancestor", "depth")
    moved = checkpointed(_differing(pairs(before), pairs(after)))
    out = [words, moved.select(F.substring_index("type_id", ".", -1).alias("word"))]
    of, above = moved.select(F.col("type_id").alias("key")).distinct(), moved.select(F.col("ancestor").alias("key")).distinct()
    item = lambda column: F.regexp_replace(column, r"(\[\])+$", "")
    for a in (before, after):
        named = lambda rows, key, word, keys: rows.select(key.alias("key"), F.col(word).alias("word")).join(keys, "key", "left_semi").select("word")
        out += [named(a.methods, F.col("declarer"), "name", above), named(a.field_types, F.col("holder"), "field", above), named(a.headers, F.col("parent_id"), "name", above)]
        out += [named(a.methods, item("returns"), "name", of), named(a.field_types, item("field_type"), "field", of)]
    return reduce(DataFrame.unionByName, out).distinct()


def _bucket(count: int) -> Column:
    return F.pmod(F.xxhash64("unit"), F.lit(count)).cast("int")


def _manifest(spark: SparkSession, folder: str) -> dict | None:
    """The latest manifest, if any: ``version, buckets, of`` (the version of each bucket), ``schemas``."""
    try:
        found = spark.read.schema("version long, value string").json(f"{folder}/manifest").agg(F.max_by("value", "version").alias("value")).first()
    except AnalysisException:
        return None
    return json.loads(found["value"]) if found["value"] else None


def _stored(spark: SparkSession, folder: str, manifest: dict, edges: DataFrame | None = None) -> Analysis:
    by_version: dict[int, list[int]] = {}
    for bucket, version in enumerate(manifest["of"]):
        by_version.setdefault(version, []).append(bucket)
    valid = reduce(Column.__or__, [(F.col("v") == v) & F.col("bucket").isin(b) for v, b in by_version.items()])

    def read(name: str, which: Column) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schemas"][name]).add("v", T.LongType()).add("bucket", T.IntegerType())
        return spark.read.schema(schema).parquet(f"{folder}/{name}").where(which).drop("v", "bucket")

    return _each(lambda name: read(name, valid), read("call_edges", F.col("v") == manifest["version"]) if edges is None else edges)


def load(spark: SparkSession, folder: str) -> Analysis:
    """The analysis as the last refresh left it."""
    manifest = _manifest(spark, folder)
    if manifest is None:
        raise ValueError(f"no analysis in {folder}")
    return _plain(_stored(spark, folder, manifest))


def version_of(spark: SparkSession, folder: str) -> int | None:
    manifest = _manifest(spark, folder)
    return manifest and manifest["version"]


def refresh(files: DataFrame, folder: str, full_run: bool = True, eager: bool = False, buckets: int = 16, compat: bool = False, before_commit: Callable[[Refresh], None] | None = None) -> Refresh:
    """Brings the analysis in ``folder`` up to date with ``files``; the result equals an analysis of all files.

    A full run forgets stored files that are not given; a partial one keeps them.
    ``eager`` reads all given files. ``buckets`` counts for a new folder: a bucket is
    what one task writes. ``before_commit`` is called when all is written but the
    manifest, for results that must stand or fall with it. Null or equal hashes,
    empty files and an empty table of files are as in ``diff.hash_diff`` and ``analyze``.
    """
    spark = files.sparkSession
    files = checkpointed(files)
    manifest = _manifest(spark, folder)
    if manifest is None:
        fresh = analyze(files, compat)
        state = _with_units(fresh, fresh.headers)
        status = files.select("file_key", F.lit("new").alias("status"))
        touched, version, of = list(range(buckets)), 0, [0] * buckets
        analysed = files.select("file_key", F.lit(0).alias("round"))
    else:
        state = _stored(spark, folder, manifest)
        status = diff.hash_diff(files, state.files, "file_key", "content_hash")
        if eager:
            status = status.withColumn("status", F.when(F.col("status") == "same", "changed").otherwise(F.col("status")))
        status = checkpointed(status)
        todo = files.join(status.where("status != 'same'"), "file_key", "left_semi")
        gone = checkpointed(diff.vanished(files, state.files, "file_key", full_run).withColumnRenamed("file_key", "unit"))
        none = files.limit(0).select("file_key", F.lit(0).alias("round"))
        if todo.isEmpty() and gone.isEmpty():
            return Refresh(_plain(state), status, none, manifest["version"])
        state, analysed = _follow(state, todo, gone, none, compat)
        buckets, version = manifest["buckets"], manifest["version"] + 1
        units = analysed.select(F.col("file_key").alias("unit")).unionByName(gone)
        touched = [r["bucket"] for r in units.select(_bucket(buckets).alias("bucket")).distinct().collect()]
        of = [version if b in touched else v for b, v in enumerate(manifest["of"])]
    for name in _TABLES:
        rows = getattr(state, name).withColumn("bucket", _bucket(buckets)).where(F.col("bucket").isin(touched))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/{name}/v={version}")
    schemas = {name: json.loads(getattr(state, name).schema.json()) for name in [*_TABLES, "call_edges"]}
    made = {"version": version, "buckets": buckets, "of": of, "schemas": schemas}
    # The call graph depends on all files: from the tables as they now are.
    now = _stored(spark, folder, made, state.call_edges)
    edges = state.call_edges if manifest is None else call_edges(now.call_sites, now.types, now.above, now.callables)
    edges.withColumn("bucket", F.lit(0)).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/call_edges/v={version}")
    out = Refresh(_plain(_stored(spark, folder, made)), status, analysed, version)
    if before_commit is not None:
        before_commit(out)
    spark.createDataFrame([(version, json.dumps(made))], "version long, value string").coalesce(1).write.mode("append").json(f"{folder}/manifest")
    return out


def _follow(state: Analysis, todo: DataFrame, gone: DataFrame, analysed: DataFrame, compat: bool) -> tuple[Analysis, DataFrame]:
    """``state`` after ``todo`` and the files that use what it declares are read anew, round by round, and ``gone`` left."""
    number = 0
    while True:
        todo = checkpointed(todo)
        read = todo.select("file_key")
        units = checkpointed(read.withColumnRenamed("file_key", "unit").unionByName(gone).distinct())
        others = _without(state, units)
        headers = others.headers.drop("unit")
        fresh = analyze(todo, compat, _plain(others))
        fresh = _with_units(fresh, fresh.headers.unionByName(headers))
        after = _each(lambda name: checkpointed(getattr(fresh, name) if name == "above" else getattr(others, name).unionByName(getattr(fresh, name))), state.call_edges)  # noqa: B023
        words = changed_words(state, after, units)
        analysed = analysed.unionByName(read.withColumn("round", F.lit(number)))
        users = checkpointed(after.words.join(words, "word").select("unit").distinct().join(units, "unit", "left_anti"))
        state, number, gone = after, number + 1, gone.limit(0)
        if users.isEmpty():
            return state, checkpointed(analysed)
        todo = state.files.join(users, "unit", "left_semi").drop("unit")
