"""The property-graph schema as data, checks of tables against it, and its constraints."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = "1.0.0"
# Labels with their merge label and key, and relationships with the labels at their ends.
LABELS = {
    "JApplication": ("JApplication", "name"),
    "JCompilationUnit": ("JCompilationUnit", "file_key"),
    "JType": ("JSymbol", "id"),
    "JCallable": ("JSymbol", "id"),
    "JField": ("JField", "id"),
    "JParameter": ("JParameter", "id"),
    "JVariable": ("JVariable", "id"),
    "JCallSite": ("JCallSite", "id"),
    "JEnumConstant": ("JEnumConstant", "id"),
    "JRecordComponent": ("JRecordComponent", "id"),
    "JInitializationBlock": ("JInitializationBlock", "id"),
    "JCrudOperation": ("JCrudOperation", "id"),
    "JCrudQuery": ("JCrudQuery", "id"),
    "JComment": ("JComment", "id"),
    "JPackage": ("JPackage", "name"),
    "JAnnotation": ("JAnnotation", "name"),
}
MARKER = "JEntrypoint"
RELATIONSHIPS = {
    "J_HAS_UNIT": ("JApplication", "JCompilationUnit"),
    "J_DECLARES_TYPE": ("JCompilationUnit", "JType"),
    "J_HAS_NESTED_TYPE": ("JType", "JType"),
    "J_HAS_CALLABLE": ("JType", "JCallable"),
    "J_HAS_FIELD": ("JType", "JField"),
    "J_HAS_PARAMETER": ("JCallable", "JParameter"),
    "J_HAS_CALLSITE": ("JCallable JInitializationBlock", "JCallSite"),
    "J_DECLARES_VAR": ("JCallable JInitializationBlock", "JVariable"),
    "J_HAS_ENUM_CONSTANT": ("JType", "JEnumConstant"),
    "J_HAS_RECORD_COMPONENT": ("JType", "JRecordComponent"),
    "J_HAS_INIT_BLOCK": ("JType", "JInitializationBlock"),
    "J_EXTENDS": ("JType", "JType"),
    "J_IMPLEMENTS": ("JType", "JType"),
    "J_ANNOTATED_BY": ("JType JCallable JField", "JAnnotation"),
    "J_IMPORTS": ("JCompilationUnit", "JType JPackage"),
    "J_RESOLVES_TO": ("JCallSite", "JCallable"),
    "J_CALLS": ("JCallable", "JCallable"),
    "J_HAS_CRUD_OPERATION": ("JCallable JCallSite", "JCrudOperation"),
    "J_HAS_CRUD_QUERY": ("JCallable JCallSite", "JCrudQuery"),
    "J_HAS_COMMENT": ("JCompilationUnit JType JCallable JField JCallSite JVariable JRecordComponent JInitializationBlock", "JComment"),
}
#: What an application holds and takes along when it goes; shared symbols, packages and annotations stay.
CONTAINMENT = [k for k in RELATIONSHIPS if k.startswith(("J_HAS_", "J_DECLARES_"))]


def contract() -> str:
    """The schema as JSON, made by the driver without a job."""
    labels = [{"label": k, "merge_label": m, "key": key} for k, (m, key) in LABELS.items()]
    relationships = [{"type": k, "from": a.split(), "to": b.split()} for k, (a, b) in RELATIONSHIPS.items()]
    return json.dumps({"schema_version": SCHEMA_VERSION, "marker": MARKER, "node_labels": labels, "relationship_types": relationships, "constraints": constraints()}, indent=2)


def constraints() -> list[str]:
    """A uniqueness constraint for each merge label, once."""
    keys = dict(LABELS.values())
    return [f"CREATE CONSTRAINT {m.lower()}_{k} IF NOT EXISTS FOR (n:{m}) REQUIRE n.{k} IS UNIQUE" for m, k in keys.items()]


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``problem, what, n``: undeclared labels or types, edges at wrong or missing ends, keys that repeat. Empty if all is well."""
    known = [*LABELS, *{m for m, _ in LABELS.values()}, MARKER]
    labels = nodes.select(F.explode("labels").alias("what")).where(~F.col("what").isin(known)).groupBy("what").agg(F.count("*").alias("n")).select(F.lit("label").alias("problem"), "what", "n")
    kinds = edges.where(~F.col("type").isin(*RELATIONSHIPS)).groupBy(F.col("type").alias("what")).agg(F.count("*").alias("n")).select(F.lit("type").alias("problem"), "what", "n")
    repeats = nodes.groupBy("merge_label", "key").count().where("count > 1").groupBy(F.col("merge_label").alias("what")).agg(F.count("*").alias("n")).select(F.lit("key").alias("problem"), "what", "n")
    allowed = edges.sparkSession.createDataFrame([(k, a.split(), b.split()) for k, (a, b) in RELATIONSHIPS.items()], "type string, sources array<string>, targets array<string>")
    # A key may serve nodes of several merge labels: an end is right if one of them has an allowed label.
    by_key = nodes.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("labels"))).alias("all_labels"))
    ends = edges.join(F.broadcast(allowed), "type")
    for end, want in (("src", "sources"), ("dst", "targets")):
        ends = ends.join(by_key.select(F.col("key").alias(end), F.col("all_labels").alias(f"{end}_labels")), end, "left")
        ends = ends.withColumn(f"{end}_ok", F.coalesce(F.arrays_overlap(f"{end}_labels", want), F.lit(False)))
    wrong = ends.where("not (src_ok and dst_ok)").groupBy(F.col("type").alias("what")).agg(F.count("*").alias("n")).select(F.lit("ends").alias("problem"), "what", "n")
    return labels.unionByName(kinds).unionByName(repeats).unionByName(wrong)
