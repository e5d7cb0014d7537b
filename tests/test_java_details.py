"""Creations, arguments, thrown types, type parameters, owners of comments and graph properties on two small files."""

import pytest
from pyspark.sql import functions as F

from codestrata.plans import catalog
from codestrata.plans.analyze import analyze, property_graph
from codestrata.sources import java_source as J
from codestrata.sources import sinks

FILES = {
    "c/More.java": """package c;
import java.util.*;
/** Holds things. */
class More<K, V extends Comparable<V> & java.io.Serializable> {
    // the manager
    EntityManager em;
    // one
    /** Finds. */
    <T extends Number> T find(String jpql, int n) throws java.io.IOException {
        Box<String> b = new Box<String>("x, y");
        Object o = new Box<>(n, new HashMap<String, Integer>());
        Object p = new c.Box<String>("q");
        em.createQuery("SELECT u FROM User u WHERE u.id = 1", More.class);
        em.createNamedQuery(jpql);
        em.createQuery("delete from User");
        if (n > 1 && 2 < n) { throw new IllegalStateException("n"); }
        RuntimeException e = null;
        throw e;
    }
    void go() { find("a", 2 + 3); find("b", 4); boxed(new Box<String>("z")); }
    void boxed(Box<String> x) { x.open(1, 2); x.open(1); int[] k = new int[3]; }
}
""",
    "c/Kinds.java": """package c;
import java.util.List;
enum Kinds {
    ONE(1, "a") { @Override int size() { return 1; } }, TWO(2, "b"), THREE(3, "c") { int size() { return 3; } };
    int n;
    Kinds(int n, String s) { this.n = n; }
    @Deprecated(since = "1, 2", forRemoval = true) @Rule({1, 2}) int size() {
        Object o = (Number) pick();
        if (o instanceof List<?>) { return (int) n; }
        try { pick(); } catch (IllegalStateException | java.io.IOException e) { }
        return 0;
    }
    private Object pick() { return null; }
}
enum Plain { A, B }
""",
    "c/Box.java": "package c;\nclass Box<T> { Box(T t) { } Box(int a, Map m) { } void open(int... n) { } void open(int n) { } }\n",
}


@pytest.fixture(scope="module")
def analysis(spark):
    rows = spark.createDataFrame([("app", k, v) for k, v in FILES.items()], "app string, file_key string, source string")
    return analyze(J.from_rows(rows))


@pytest.fixture(scope="module")
def graph(analysis):
    return property_graph(analysis, "it's")


def test_creations_of_generic_and_qualified_types(analysis):
    made = [r for r in analysis.call_sites.where("is_constructor_call").collect()]
    assert sorted(r.receiver_type for r in made) == ["HashMap", "c.Box", "c.Box", "c.Box", "c.Box", "java.lang.IllegalStateException"]
    assert all(r.receiver is None for r in made)


def test_arguments(analysis):
    sites = [(r.method_name, r.argument_expr) for r in analysis.call_sites.orderBy("file_key", "line", "col").collect()]
    assert ("<init>", ['"x, y"']) in sites and ("<init>", ["n", "new HashMap<String,Integer>()"]) in sites and ("<init>", []) in sites
    assert ("createQuery", ['"SELECT u FROM User u WHERE u.id = 1"', "More.class"]) in sites and ("find", ['"a"', "2+3"]) in sites
    kinds = {(r.expression, r.type) for r in analysis.arguments.collect()}
    assert {('"a"', "java.lang.String"), ("jpql", "String"), ("n", "int"), ("4", "int"), ("2+3", None), ("new HashMap<String,Integer>()", "HashMap")} <= kinds
    ids = {(r.expression, r.argument_id) for r in analysis.arguments.collect()}
    assert ("jpql", "14:29") in ids


def test_queries_and_callees(analysis):
    found = {(r.argument_expr[0], r.crud_query) for r in analysis.call_sites.where("crud_query is not null").collect()}
    assert {q for _, q in found} == {"READ", "WRITE", "NAMED"} and ("jpql", "NAMED") in found and ('"delete from User"', "WRITE") in found
    callees = {(r.method_name, tuple(r.argument_expr)): r.callee_id for r in analysis.call_sites.collect()}
    assert callees[("open", ("1", "2"))] == "c.Box#open(int[])" and callees[("open", ("1",))] == "c.Box#open(int)"
    assert callees[("find", ('"b"', "4"))] == "c.More#find(String, int)" and callees[("<init>", ('"q"',))] == "c.Box#<init>(T)"
    assert callees[("createNamedQuery", ("jpql",))] is None


def test_thrown_and_type_parameters(analysis):
    find = analysis.callables.where("name = 'find'").first()
    assert find.thrown == ["java.io.IOException"] and find.raised == ["java.lang.IllegalStateException", "java.lang.RuntimeException"]
    assert [(p.name, p.bounds) for p in find.type_parameters] == [("T", ["Number"])] and find.return_type == "T"
    more = analysis.types.where("name = 'More'").first()
    assert [(p.name, p.bounds) for p in more.type_parameters] == [("K", []), ("V", ["Comparable<V>", "java.io.Serializable"])]


def test_comments_belong_to_what_follows(analysis):
    found = {(r.content, r.owner) for r in analysis.comments.collect()}
    assert found == {("Holds things.", "c.More"), ("the manager", "c.More#field#em"), ("one", None), ("Finds.", "c.More#find(String, int)")}


def test_enum_constants_with_bodies(analysis):
    found = {(r.type_id, r.name, r.ordinal, tuple(r.arguments)) for r in analysis.enum_constants.collect()}
    assert found == {("c.Kinds", "ONE", 0, ("1", '"a"')), ("c.Kinds", "TWO", 1, ("2", '"b"')), ("c.Kinds", "THREE", 2, ("3", '"c"')), ("c.Plain", "A", 0, ()), ("c.Plain", "B", 1, ())}


def test_bodies_of_enum_constants_are_types(analysis):
    found = {r.type_id: r for r in analysis.types.where("file_key = 'c/Kinds.java'").collect()}
    assert set(found) == {"c.Kinds", "c.Kinds.$enum$ONE", "c.Kinds.$enum$THREE", "c.Plain"}
    assert found["c.Kinds.$enum$ONE"].extends_list == ["Kinds"] and found["c.Kinds.$enum$ONE"].ancestors == ["c.Kinds"]
    members = {r.callable_id for r in analysis.callables.where("file_key = 'c/Kinds.java'").collect()}
    assert members == {"c.Kinds.$enum$ONE#size()", "c.Kinds.$enum$THREE#size()", "c.Kinds#<init>(int, String)", "c.Kinds#size()", "c.Kinds#pick()", "c.Plain#<init>()"}


def test_types_of_casts_instanceof_and_catch(analysis):
    found = {r.target for r in analysis.references.where("callable_id = 'c.Kinds#size()' and kind = 'type'").collect()}
    assert {"java.lang.Number", "java.util.List", "java.lang.IllegalStateException", "java.io.IOException", "java.lang.Object"} <= found


def test_decorators_and_accessibility(analysis):
    row = analysis.callables.where("callable_id = 'c.Kinds#size()'").select(J.decorators(F.col("annotations")).alias("d")).first()
    assert [(d.name, d.args) for d in row.d] == [("Deprecated", ['since="1, 2"', "forRemoval=true"]), ("Rule", ["{1 , 2}"])]
    assert {r.accessibility for r in analysis.call_sites.where("method_name = 'pick'").collect()} == {"private"}


def test_listing_and_envelope(spark, analysis, tmp_path):
    for name in ("src/A.java", "target/B.java", "src/main/resources/C.java", "lib/d.jar"):
        (tmp_path / "p" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "p" / name).write_text("class A { }")
    names = lambda suffix: {r.path.rsplit("/", 1)[1] for r in J.listing(spark, str(tmp_path / "p"), suffix).collect()}
    assert names("java") == {"A.java"} and names("jar") == {"d.jar"}
    sinks.write_envelope(analysis, str(tmp_path / "out"))
    assert sinks.read_saved(spark, str(tmp_path / "out/symbol_table")).count() == 3
    assert spark.read.json(str(tmp_path / "out/call_graph")).count() == analysis.call_edges.count()
    assert spark.read.json(str(tmp_path / "out/version")).first().version == catalog.SCHEMA_VERSION


def test_graph_properties_and_edges(graph, analysis):
    nodes, edges = graph
    assert catalog.violations(nodes, edges).count() == 0
    held = {r.key: r.props for r in nodes.where("props is not null").collect()}
    assert held["c.More"]["docstring"] == "'Holds things.'" and held["c.More"]["is_interface"] == "false" and "parent_type" not in held["c.More"]
    find = held["c.More#find(String, int)"]
    assert find["thrown_exceptions"] == "['java.io.IOException', 'java.lang.IllegalStateException', 'java.lang.RuntimeException']" and find["cyclomatic_complexity"] == "2"
    found = {(r.type, r.src, r.dst): r.props for r in edges.collect()}
    assert found[("J_CALLS", "c.More#go()", "c.More#find(String, int)")]["weight"] == "2"
    assert sum(k[0] == "J_HAS_CRUD_QUERY" for k in found) == 6 and ("J_HAS_CRUD_QUERY", "c.More#find(String, int)", "c.More#find(String, int)#crudq#2") in found
    assert sum(k[0] == "J_RESOLVES_TO" for k in found) == analysis.call_sites.where("callee_id is not null").count()
    assert ("J_HAS_COMMENT", "c/More.java", "c/More.java#comment@7:5") in found


def test_script_has_properties_and_wipes_by_containment(graph):
    script = [r.statement for r in sinks.cypher_statements(*graph, "it's").orderBy("part", "ordinal").collect()]
    wipe = next(s for s in script if "DETACH DELETE" in s)
    assert "{name: 'it\\'s'}" in wipe and "J_HAS_CALLABLE" in wipe and "J_CALLS" not in wipe and "J_IMPORTS" not in wipe
    assert any("p: {type: 'CALL_DEP', weight: 2}" in s for s in script) and any("cyclomatic_complexity: 2" in s for s in script)


def test_batches_are_full_across_buckets(spark):
    from codestrata.operators import merge

    rows = spark.range(1000).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 3 > 0, "x").alias("h"), "id")
    sizes = sorted(r["count"] for r in merge.in_batches(rows, ["g", "h"], ["id"], 70, spread=40).groupBy("g", "h", "batch").count().collect())
    assert sum(sizes) == 1000 and sizes.count(70) == 2 * (333 // 2 // 70) + 2 * (666 // 2 // 70)


def test_batches_follow_the_order_across_ranges(spark):
    from codestrata.operators import merge

    rows = spark.range(1000).select((F.col("id") % 2).alias("g"), F.when(F.col("id") < 998, F.col("id") * 7919 % 1009).alias("k"), "id")
    found = merge.in_batches(rows, ["g"], ["k", "id"], 70, spread=40).collect()
    for g in (0, 1):
        keys = sorted((r for r in found if r.g == g), key=lambda r: (r.k is None, r.k or 0, r.id))
        assert [r.batch for r in keys] == [i // 70 for i in range(500)]


def test_closure_of_a_long_chain(spark):
    from codestrata.operators import closure

    chain = spark.createDataFrame([(k, k + 1) for k in range(20)], "p int, c int")
    assert closure.closure(chain, "p", "c").count() == 210
    with pytest.raises(ValueError):
        closure.closure(chain, "p", "c", max_depth=5)
