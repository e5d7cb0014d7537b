"""Schema checks, the graph script, JSON, and incremental replacement."""

import json

import pytest
from pyspark.sql import functions as F

from codestrata.operators import diff, gate, merge
from codestrata.plans import catalog
from codestrata.plans.analyze import analyze, property_graph
from codestrata.sources import java_source as J
from codestrata.sources import sinks
from codestrata.streaming import upsert as U

A = "package p;\nclass A { B b; void f() { b.g(); } void h() { f(); } }\n"
B = "package p;\nclass B { void g() { } }\n"
C = "package p;\nclass C extends B { String it = \"it's\"; }\n"


def table(spark, **files):
    return J.from_rows(spark.createDataFrame([("app", k, v) for k, v in files.items()], "app string, file_key string, source string"))


def triples(edges):
    return {(r.type, r.src, r.dst) for r in edges.collect()}


def test_graph_conforms_and_renders(spark, tmp_path):
    nodes, edges = property_graph(analyze(table(spark, a=A, b=B, c=C)), "app")
    assert catalog.violations(nodes, edges).count() == 0
    script = [r.statement for r in sinks.cypher_statements(nodes, edges, "app", batch=3).orderBy("part", "ordinal").collect()]
    assert script[0].startswith("CREATE CONSTRAINT") and sum(s.count("{k: ") for s in script) == nodes.count()
    assert sum(s.count("{f: ") for s in script) == edges.count()
    assert max(s.count("{k: ") for s in script) == 3
    bad = nodes.limit(1).withColumn("labels", F.array(F.lit("Nope")))
    assert catalog.violations(bad, edges.limit(0)).first().problem == "label"
    assert json.loads(catalog.contract())["schema_version"] == catalog.SCHEMA_VERSION


def test_json_round_trip(spark, tmp_path):
    sinks.write_json(analyze(table(spark, a=A, c=C)), str(tmp_path / "out"))
    rows = {r["file_key"]: r for r in map(json.loads, (r.value for r in spark.read.text(str(tmp_path / "out")).collect()))}
    assert [c["signature"] for c in rows["a"]["types"][0]["callables"]] == ["<init>()", "f()", "h()"]
    assert "imports" not in rows["a"] and rows["c"]["types"][0]["extends_list"] == ["B"]
    assert sinks.read_saved(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "old.json").write_text('{"file_key": "x", "imports": ["java.util.List"]}\n')
    with pytest.raises(ValueError):
        sinks.read_saved(spark, str(tmp_path / "old.json"))


def test_upsert_is_idempotent_and_prunes(spark, tmp_path):
    folder = str(tmp_path / "g")
    assert {r.status for r in U.upsert(table(spark, a=A, b=B, c=C), folder, "app").collect()} == {"new"}
    first = triples(U.stored_graph(spark, folder)[1])
    assert ("J_CALLS", "p.A#f()", "p.B#g()") in first and ("J_EXTENDS", "p.C", "p.B") in first
    assert {r.status for r in U.upsert(table(spark, a=A, b=B, c=C), folder, "app").collect()} == {"same"}
    assert triples(U.stored_graph(spark, folder)[1]) == first
    changed = U.upsert(table(spark, a=A, b=B.replace("g()", "k()")), folder, "app", full_run=False)
    assert {r.file_key: r.status for r in changed.collect()} == {"a": "same", "b": "changed"}
    nodes, edges = U.stored_graph(spark, folder)
    keys = {r.key for r in nodes.collect()}
    assert "p.B#k()" in keys and "p.B#g()" not in keys and "p.C" in keys
    assert ("J_CALLS", "p.A#f()", "p.B#g()") not in triples(edges)
    U.upsert(table(spark, a=A), folder, "app")
    nodes, edges = U.stored_graph(spark, folder)
    assert {r.unit for r in nodes.collect()} == {"a", None}
    for end in ("src", "dst"):
        assert edges.join(nodes.select(F.col("key").alias(end)), end, "left_anti").count() == 0


def test_stream_of_files(spark, tmp_path):
    table(spark, a=A, b=B).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    query = U.watch(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "g"), "app", str(tmp_path / "ck"))
    query.awaitTermination(120)
    assert ("J_CALLS", "p.A#f()", "p.B#g()") in triples(U.stored_graph(spark, str(tmp_path / "g"))[1])


def test_scan_of_a_folder(spark, tmp_path):
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "x" / "A.java").write_text(A)
    (tmp_path / "x" / "y" / "B.java").write_text(B)
    (tmp_path / "x" / "y" / "B.txt").write_text("no")
    files = J.scan_files(spark, str(tmp_path / "x"))
    assert {(r.app, r.file_key, r.source) for r in files.collect()} == {("x", "A.java", A), ("x", "y/B.java", B)}
    assert J.only_files(files, spark.createDataFrame([("A.java",)], "file_key string")).count() == 1


def test_row_operators(spark):
    rows = spark.createDataFrame([(1, 1, "a", ["x"]), (1, 2, None, ["y"]), (1, 3, "c", []), (2, 1, None, None)], "k int, seq int, name string, tags array<string>")
    found = {r.k: (r["name"], r.tags) for r in merge.merge_nodes(rows, ["k"], "seq").collect()}
    assert found == {1: ("c", ["y"]), 2: (None, None)}
    with pytest.raises(ValueError):
        merge.assert_unique(rows, ["k"])
    assert merge.assert_unique(rows, ["k", "seq"]).count() == 4
    with pytest.raises(ValueError):
        gate.gate_edges(rows, rows, "k", mode="none")
    assert diff.vanished(rows.limit(0), rows.select("k").distinct(), "k", full_run=False).count() == 0
