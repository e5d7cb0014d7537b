"""Incremental upkeep of a stored graph: all sources are analysed when one changed, changed units are replaced."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators import diff
from ..plans.analyze import analyze, property_graph
from ..session import checkpointed


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The stored table, or an empty one if there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


UNITS = "file_key string, content_hash string, source string, app string, size_bytes long"
NODES = "merge_label string, key string, labels array<string>, name string, props map<string,string>, unit string"
EDGES = "type string, src string, dst string, props map<string,string>, unit string"


def upsert(files: DataFrame, folder: str, app: str, full_run: bool = True, eager: bool = False) -> DataFrame:
    """Bring the graph stored in ``folder`` up to date with ``files``; returns ``file_key, status``.

    Names resolve across files, so resolution runs over the stored sources of all
    units, while the stored graph is replaced for changed units only. A new
    version is written beside the old one and named last, so a run that is cut
    short leaves the old one in place.
    """
    spark = files.sparkSession
    versions = read_or_empty(spark, f"{folder}/versions", "version long")
    version = versions.agg(F.max("version").alias("v")).first()["v"]
    base = f"{folder}/v{version}" if version is not None else f"{folder}/none"
    old = read_or_empty(spark, f"{base}/units", UNITS)
    status = diff.hash_diff(files, old, "file_key", "content_hash")
    if eager:
        status = status.withColumn("status", F.when(F.col("status") == "same", "changed").otherwise(F.col("status")))
    status = checkpointed(status)
    changed = status.where("status != 'same'").select("file_key")
    if changed.isEmpty() and (not full_run or diff.vanished(files, old, "file_key").isEmpty()):
        return status
    kept = old if not full_run else old.join(files.select("file_key"), "file_key", "left_semi")
    units = kept.join(files.select("file_key"), "file_key", "left_anti").unionByName(files.select(*old.columns))
    nodes, edges = property_graph(analyze(units), app)
    nodes = nodes.withColumnRenamed("module", "unit").drop("seq")
    owner = nodes.where("unit is not null").groupBy(F.col("key").alias("src")).agg(F.min("unit").alias("unit"))
    edges = edges.join(owner, "src", "left").select("type", "src", "dst", "props", "unit")
    new_nodes, new_edges = diff.replace_units(
        read_or_empty(spark, f"{base}/nodes", NODES), read_or_empty(spark, f"{base}/edges", EDGES), nodes.select("merge_label", "key", "labels", "name", "props", "unit"), edges, changed.withColumnRenamed("file_key", "unit"), full_run=full_run
    )
    number = 0 if version is None else version + 1
    units.write.mode("overwrite").parquet(f"{folder}/v{number}/units")
    new_nodes.write.mode("overwrite").parquet(f"{folder}/v{number}/nodes")
    new_edges.write.mode("overwrite").parquet(f"{folder}/v{number}/edges")
    spark.createDataFrame([(number,)], "version long").write.mode("append").parquet(f"{folder}/versions")
    return status


def stored_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    version = spark.read.parquet(f"{folder}/versions").agg(F.max("version").alias("v")).first()["v"]
    return spark.read.schema(NODES).parquet(f"{folder}/v{version}/nodes"), spark.read.schema(EDGES).parquet(f"{folder}/v{version}/edges")


def watch(stream: DataFrame, folder: str, app: str, checkpoint: str, apply: Callable = upsert):
    """A streaming query that upserts each batch of ``app, file_key, source, content_hash, size_bytes`` as a partial run."""
    return (
        stream.writeStream.foreachBatch(lambda batch, _: apply(batch.dropDuplicates(["file_key"]), folder, app, full_run=False))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
