"""Names by scope, erasure, overloads, chained calls and calls through library interfaces, on a varied small project."""

import pytest

from codestrata.plans.analyze import analyze, property_graph
from codestrata.sources import java_source as J

FILES = {
    "q/Other.java": "package q;\npublic class Other { public Other next; public String name; public void ping() { } public Other self() { return this; } public static Other make() { return new Other(); } public static class Part { public int size() { return 1; } } }\n",
    "q/Util.java": "package q;\npublic class Util { public static int go(int a, int b) { return a; } public static String go(String s) { return s; } public static final Other ONE = null; }\n",
    "r/Other.java": "package r;\npublic class Other { public void ping() { } }\n",
    "p/Base.java": """package p;
public class Base<T extends Comparable<T>> {
    protected Inner held;
    public class Inner { public void touch() { } }
    void top(int n) { }
    void id(T t) { }
    <U extends T> void low(U u) { }
}
""",
    "p/A.java": """package p;
import q.*;
import static q.Util.go;
class A extends Base<String> {
    int k = go(1, 2);
    A() { this(1); }
    A(int n) { super(); }
    A(Integer n, String... rest) { }
    void print(int n) { } void print(long n) { } void print(String s) { } void print(Object o) { } void print(int... n) { }
    Other get() { return new Other(); }
    void calls(Object o, Other[] some, byte b) {
        print(2); print(2L); print("s"); print(new Other()); print(1, 2); print(b); print(get().name); print('c'); print(2.5);
        Other x = new Other();
        x.ping(); get().ping(); get().self().next.ping(); this.get().ping(); Other.make().self().ping(); some[0].ping(); ((Other) o).ping();
        var y = get().self();
        y.ping();
        if (o instanceof Other t) { t.ping(); }
        Inner inner = held; inner.touch(); held.touch();
        new Other.Part().size(); q.Util.go("z"); q.Util.ONE.ping(); go("w"); super.top(1); top(2);
        new A(); new A(3); new A(3, "a", "b"); new A(Integer.valueOf(3));
        print(null);
        Runnable r = new Runnable() { public void run() { helper(); } void other() { } };
        r.run();
    }
    void helper() { }
    class Deep { void use() { helper(); calls(null, null, (byte) 1); } void print(String s) { } void own() { print("deep"); } }
}
""",
    "p/Both.java": "package p;\nimport q.*;\nimport r.*;\nclass Both { void f(Other o) { o.ping(); } }\n",
    "p/Task.java": "package p;\nclass Task implements Runnable { public void run() { } }\nclass Calm { static void start(Runnable r) { r.run(); new Thread(r).start(); Calm.start(new Task()); } static void start(Task t) { } }\n",
    "p/Shape.java": """package p;
interface Shape { double area(); default void show() { area(); } }
record Dot(int x, int y) implements Shape { Dot { x(); } public double area() { return x; } }
enum Mood { GOOD { void act() { } }, BAD(2); Mood() { } Mood(int n) { } void act() { Mood.GOOD.act(); } }
class Pick {
    int choose(int k) { int v = switch (k) { case 1 -> 10; case 2 -> 20; default -> 30; }; return v; }
    int old(int k) { switch (k) { case 1: return 1; default: return 2; } }
    Dot dot = new Dot(1, 2);
    void go(Shape s) { s.area(); s.show(); dot.x(); dot.area(); }
}
""",
}


@pytest.fixture(scope="module")
def analysis(spark):
    rows = spark.createDataFrame([("app", k, v) for k, v in FILES.items()], "app string, file_key string, source string")
    return analyze(J.from_rows(rows))


@pytest.fixture(scope="module")
def sites(analysis):
    return [(r.callable_id, r.method_name, ",".join(r.argument_expr), r.receiver_type, r.callee_id) for r in analysis.call_sites.orderBy("file_key", "line", "col").collect()]


CALLS = "p.A#calls(Object, Other[], byte)"


def callees(sites, name, where=CALLS):
    return [(a, c and c.removeprefix("p.A#")) for i, m, a, _, c in sites if i == where and m == name]


def test_overloads(sites):
    assert callees(sites, "print") == [
        ("2", "print(int)"), ("2L", "print(long)"), ('"s"', "print(String)"), ("new Other()", "print(Object)"), ("1,2", "print(int[])"), ("b", "print(int)"), ("get().name", None), ("'c'", "print(int)"), ("2.5", "print(Object)"),
        ("null", None),
    ]


def test_constructors(sites, analysis):
    made = [(a, c) for i, m, a, t, c in sites if i == CALLS and m == "<init>" and t == "p.A"]
    assert made == [("", "p.A#<init>()"), ("3", "p.A#<init>(int)"), ('3,"a","b"', "p.A#<init>(Integer, String[])"), ("Integer.valueOf(3)", "p.A#<init>(int)")]  # to unbox comes before a variable number
    assert [(a, t, c) for i, m, a, t, c in sites if i == "p.A#<init>()"] == [("1", "p.A", "p.A#<init>(int)")]
    assert [(t, c) for i, m, a, t, c in sites if i == "p.A#<init>(int)"] == [("p.Base", "p.Base#<init>()")]
    edges = {(r.src, r.dst): r.weight for r in analysis.call_edges.collect()}
    assert [edges[CALLS, f"p.A#<init>({x})"] for x in ("", "int", "Integer, String[]")] == [1, 2, 1]


def test_receivers_of_all_forms(sites):
    pings = [(t, c) for i, m, _, t, c in sites if i == CALLS and m == "ping"]
    assert pings == [("q.Other", "q.Other#ping()")] * 10
    assert [(t, c) for i, m, _, t, c in sites if i == CALLS and m == "touch"] == [("p.Base.Inner", "p.Base.Inner#touch()")] * 2
    assert [(t, c) for i, m, _, t, c in sites if m == "size"] == [("q.Other.Part", "q.Other.Part#size()")]
    assert [(a, t, c) for i, m, a, t, c in sites if m == "go" and t] == [("1,2", "q.Util", "q.Util#go(int, int)"), ('"z"', "q.Util", "q.Util#go(String)"), ('"w"', "q.Util", "q.Util#go(String)")]
    assert [c for i, m, _, _, c in sites if m == "top"] == ["p.Base#top(int)"] * 2


def test_enclosing_types_and_anonymous_classes(sites, analysis):
    found = {r.callable_id: r for r in analysis.callables.collect()}
    assert "p.A.$anon$0#run()" in found and found["p.A.$anon$0#run()"].kind == "method" and "p.A.$anon$0#other()" in found
    helper = [(i, t, c) for i, m, _, t, c in sites if m == "helper"]
    assert helper == [("p.A.$anon$0#run()", "p.A", "p.A#helper()"), ("p.A.Deep#use()", "p.A", "p.A#helper()")]
    assert [(i, c) for i, m, a, _, c in sites if m == "print" and a == '"deep"'] == [("p.A.Deep#own()", "p.A.Deep#print(String)")]
    roles = {(r.type_id, r.role, r.resolved) for r in analysis.supertypes.collect()}
    assert ("p.A.$anon$0", "implements", "java.lang.Runnable") in roles and ("p.A", "extends", "p.Base") in roles


def test_two_candidates_of_one_rank_give_none(sites):
    assert [(t, c) for i, m, _, t, c in sites if i == "p.Both#f(Other)"] == [("Other", None)]


def test_calls_through_library_interfaces(analysis):
    edges = {(r.src, r.dst): r.weight for r in analysis.call_edges.collect()}
    assert {d for s, d in edges if s == "p.Calm#start(Runnable)"} == {"p.Task#run()", "p.A.$anon$0#run()", "p.Task#<init>()", "p.Calm#start(Task)"}
    assert {d for s, d in edges if s == "p.Pick#go(Shape)"} == {"p.Dot#area()", "p.Shape#area()", "p.Shape#show()"}  # a type answers for itself
    assert ("p.Shape#show()", "p.Dot#area()") in edges and (CALLS, "p.A.$anon$0#run()") in edges and (CALLS, "p.Task#run()") in edges


def test_erasure(analysis):
    erased = {r.callable_id: r.erased_signature for r in analysis.callables.collect()}
    assert erased["p.Base#id(T)"] == "id(java.lang.Comparable)" and erased["p.Base#low(U)"] == "low(java.lang.Comparable)"
    assert erased[CALLS] == "calls(java.lang.Object, q.Other[], byte)" and erased["p.A#print(int[])"] == "print(int[])"


def test_no_call_where_something_is_declared(sites):
    assert [s for s in sites if s[0] is None] == [(None, "go", "1,2", "q.Util", "q.Util#go(int, int)"), (None, "<init>", "1,2", "p.Dot", "p.Dot#<init>(int, int)")]


def test_switch_expressions_have_no_branches_of_their_own(analysis):
    points = {r.callable_id: r.cyclomatic for r in analysis.callables.collect()}
    assert points["p.Pick#choose(int)"] == 1 and points["p.Pick#old(int)"] == 3


def test_initializers_and_blocks(spark):
    source = """package z;
class Z {
    int[] xs = {1, 2}, ys = new int[] { 3 };
    String f = "a, b; c", g = null;
    java.util.Map<String, Integer> m = new java.util.HashMap<String, Integer>(), k;
    Runnable r = () -> { int in = 1; };
    static { int s = make(); }
    static int make() {
        for (int i = 0, j = i + 1; i < j; i++) { }
        try (AutoCloseable c = open( 1 )) { }
        int v = switch (xs.length) { case 1 -> 10; default -> 30; };
        for (String x : names) { }
        return v;
    }
}
"""
    found = analyze(J.from_rows(spark.createDataFrame([("app", "z/Z.java", source)], "app string, file_key string, source string")))
    got = {r.name: r.initializer for r in found.variables.collect()}
    assert got == {
        "xs": "{1, 2}", "ys": "new int[] { 3 }", "f": '"a, b; c"', "g": "null", "m": "new java.util.HashMap<String, Integer>()", "k": None, "r": "() -> { int in = 1; }", "in": "1",
        "s": "make()", "i": "0", "j": "i + 1", "c": "open( 1 )", "v": "switch (xs.length) { case 1 -> 10; default -> 30; }", "x": None,
    }
    nodes, edges = property_graph(found, "app")
    keys = {r.key for r in nodes.collect()}
    assert "z.Z#init#0" in keys and not any("<clinit>" in k for k in keys)
    pairs = {(r.type, r.src, r.dst) for r in edges.collect()}
    assert {("J_HAS_INIT_BLOCK", "z.Z", "z.Z#init#0"), ("J_HAS_CALLSITE", "z.Z#init#0", "z.Z#init#0@7:22"), ("J_RESOLVES_TO", "z.Z#init#0@7:22", "z.Z#make()")} <= pairs
    assert not any("<clinit>" in x for p in pairs for x in p)
