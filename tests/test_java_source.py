"""Java source tables on small inline files."""

import pytest
from pyspark.sql import functions as F

from codestrata.plans.analyze import analyze, durable_ids, property_graph
from codestrata.sources import java_source as J

FILES = {
    "a/User.java": """package a;

import java.util.List;
import java.util.*;
import static org.junit.Assert.fail;
import static org.junit.Assert.*;

/** A user. */
@Entity(name = "u")
public class User extends Base<String> implements Comparable<User>, Runnable {
    private String name = "x { y", other;
    static { int n = 1; if (n > 0) { log("a"); } }
    // a line comment
    public User(String name) { this.name = name; }
    private void log(String s) { loglog(); }
    private void loglog() { }
    @GetMapping("/x") public List<String> names(final List<Map<String, Integer>> in, int... rest) throws java.io.IOException {
        for (String s : in) { if (s == null || rest.length > 0 ? true : false) { log(s); } }
        Helper h = new Helper(1);
        h.run();
        Runnable r = new Runnable() { public void run() { loglog(); } };
        return null;
    }
    public void run() { switch (1) { case 1: break; default: break; } try { em.persist(this); } catch (Exception e) { } }
    private EntityManager em;
    enum Kind { A, B }
    interface Shape { double area(); default double twice() { return 2 * area(); } }
}
""",
    "a/Helper.java": "package a;\nclass Helper extends Base<Integer> { Helper(int n) { super(); } void run() { new User(\"q\").names(null); } }\n",
    "a/Base.java": "package a;\nabstract class Base<T> { }\nrecord Point(int x, List<String> y) { Point { if (x < 0) { x = 0; } } }\n",
    "b/Ctl.java": 'package b;\nimport a.User;\n@RestController class Ctl { String é = "ü"; User u; void go() { u.run(); go(); Math.max(1, 2); } }\n',
    "src/test/resources/Skip.java": "class Skip { }",
}


@pytest.fixture(scope="module")
def analysis(spark):
    rows = spark.createDataFrame([("app", k, v) for k, v in FILES.items()], "app string, file_key string, source string")
    return analyze(J.from_rows(rows))


def pairs(frame, *columns):
    return {tuple(r[c] for c in columns) for r in frame.collect()}


def test_tokens_cover_the_source(spark):
    rows = spark.createDataFrame([(k, v) for k, v in FILES.items()], "file_key string, source string")
    for r in J.tokens(rows).join(rows, "file_key").collect():
        assert r.source[r.start : r.start + len(r.text)] == r.text
        line = r.source.split("\n")[r.line - 1]
        assert line[r.col - 1 :].startswith(r.text.split("\n")[0])


def test_excluded_roots(analysis):
    assert "src/test/resources/Skip.java" not in {r.file_key for r in analysis.files.collect()}


def test_imports(analysis):
    wanted = {("java.util.List", False, False), ("java.util", False, True), ("org.junit.Assert.fail", True, False), ("org.junit.Assert", True, True), ("a.User", False, False)}
    assert pairs(analysis.imports, "path", "is_static", "is_wildcard") == wanted


def test_types(analysis):
    found = {r.type_id: r for r in analysis.types.collect()}
    assert {k: v.kind for k, v in found.items() if "$" not in k} == {
        "a.User": "class", "a.User.Kind": "enum", "a.User.Shape": "interface", "a.Helper": "class", "a.Base": "class", "a.Point": "record", "b.Ctl": "class",
    }
    user = found["a.User"]
    assert user.extends_list == ["Base<String>"] and user.implements_list == ["Comparable<User>", "Runnable"]
    assert user.annotations == ['@Entity(name = "u")'] and user.modifiers == ["public"]
    assert found["a.User.Kind"].parent_id == "a.User" and (user.start_line, user.end_line) == (9, 28)
    assert found["b.Ctl"].is_entrypoint_class and not found["a.Helper"].is_entrypoint_class
    assert any(k.endswith("$anon$0") for k in found)


def test_callables(analysis):
    found = {r.callable_id: r for r in analysis.callables.collect()}
    names = {"a.User#<init>(String)", "a.User#log(String)", "a.User#loglog()", "a.User#names(List, int[])", "a.User#run()", "a.User.Shape#area()", "a.User.Shape#twice()", "a.Helper#<init>(int)", "a.Helper#run()", "a.Point#<init>(int, List)", "b.Ctl#go()", "a.User#<clinit>$0()"}
    assert names <= set(found)
    assert {"a.Base#<init>()", "a.User.Kind#<init>()", "b.Ctl#<init>()"} <= {k for k, r in found.items() if r.is_implicit}
    method = found["a.User#names(List, int[])"]
    assert method.return_type == "List<String>" and method.parameter_types == ["List<Map<String,Integer>>", "int"]
    assert method.thrown == ["java.io.IOException"] and method.is_entrypoint and method.cyclomatic == 4
    assert found["a.User#run()"].cyclomatic == 4 and found["a.User#<clinit>$0()"].cyclomatic == 2
    assert found["a.Point#<init>(int, List)"].cyclomatic == 2 and not found["a.Point#<init>(int, List)"].is_implicit


def test_variables(analysis):
    found = pairs(analysis.variables, "owner", "name", "type")
    assert {("field", "name", "String"), ("field", "other", "String"), ("field", "em", "EntityManager"), ("local", "h", "Helper"), ("local", "n", "int"), ("field", "u", "User")} <= found


def test_call_sites(analysis):
    found = {(r.callable_id, r.method_name): r for r in analysis.call_sites.collect()}
    persist = found[("a.User#run()", "persist")]
    assert persist.receiver_type == "EntityManager" and persist.crud_operation == "CREATE"
    assert found[("a.User#names(List, int[])", "<init>")].receiver_type in ("a.Helper", "java.lang.Runnable")
    assert found[("a.Helper#run()", "<init>")].receiver_type == "a.User"
    assert found[("b.Ctl#go()", "max")].is_static_call and found[("b.Ctl#go()", "max")].receiver_type == "java.lang.Math"
    assert found[("a.User#log(String)", "loglog")].local_id == "15:34"


def test_call_edges(analysis):
    found = pairs(analysis.call_edges, "src", "dst", "weight")
    assert {("a.User#log(String)", "a.User#loglog()", 1), ("b.Ctl#go()", "a.User#run()", 1), ("a.User#names(List, int[])", "a.Helper#run()", 1), ("a.Helper#run()", "a.User#<init>(String)", 1)} <= found
    assert not any(s == d for s, d, _ in found)


def test_comments(analysis):
    assert {("A user.", True), ("a line comment", False)} == pairs(analysis.comments, "content", "is_javadoc")


def test_property_graph(analysis):
    nodes, edges = property_graph(analysis, "app")
    keys = nodes.groupBy("merge_label", "key").count()
    assert keys.where("count > 1").count() == 0
    for end in ("src", "dst"):
        assert edges.join(nodes.select(F.col("key").alias(end)), end, "left_anti").count() == 0
    found = pairs(edges, "type", "src", "dst")
    assert ("J_EXTENDS", "a.Helper", "a.Base") in found and ("J_HAS_UNIT", "app", "b/Ctl.java") in found
    assert ("J_IMPORTS", "b/Ctl.java", "a.User") in found and ("J_HAS_NESTED_TYPE", "a.User", "a.User.Kind") in found
    labels = {r.key: r.labels for r in nodes.where("merge_label = 'JSymbol'").collect()}
    assert labels["b.Ctl"] == ["JSymbol", "JType", "JEntrypoint"]
    again = property_graph(analysis, "app")
    assert pairs(again[1], "type", "src", "dst") == found


def test_enum_constants_and_record_components(analysis):
    assert pairs(analysis.enum_constants, "type_id", "name", "ordinal") == {("a.User.Kind", "A", 0), ("a.User.Kind", "B", 1)}
    assert pairs(analysis.record_components, "type_id", "name", "type") == {("a.Point", "x", "int"), ("a.Point", "y", "List<String>")}


def test_record_defaults_and_references(analysis):
    assert pairs(analysis.record_components, "name", "default_value") == {("x", "0"), ("y", None)}
    found = pairs(analysis.references, "callable_id", "kind", "target")
    assert {("a.User#<init>(String)", "field", "a.User.name"), ("a.User#names(List, int[])", "type", "a.Helper"), ("b.Ctl#go()", "field", "b.Ctl.u"), ("a.User#run()", "field", "a.User.em")} <= found


def test_durable_ids(analysis):
    ids = {r.callable_id: r.can_id for r in durable_ids(analysis, "app").collect()}
    assert ids["a.User#run()"] == "can://java/app/a/User.java/a/User/run()"
