"""Control flow and control dependence: a method for each construct, edges as a reader of Java would draw them."""

import itertools

import pytest

from codestrata.plans.analyze import analyze
from codestrata.plans.flow import flow
from codestrata.sources import java_source as J

# One statement a line, so that a node is told by its line within the method.
METHODS = {
    "straight": "a = 1;\nb = 2;",
    "empty": "",
    "branch": "if (x)\na = 1;\nelse\nb = 2;\nc = 3;",
    "chain": "if (x) {\na = 1;\n} else if (y) {\n}\nc = 3;",
    "loops": "for (int i = 0; i < 3; i++) {\nif (x) continue;\nif (y) {\nbreak; }\na = 1;\n}\nwhile (z);\nb = 2;",
    "until": "do {\na = 1;\n} while (x);\nb = 2;",
    "endless": "while (true) {\na = 1;\n}",
    "labels": "outer:\nfor (;;) {\nwhile (x) {\nif (y) { break outer; }\ncontinue outer;\n}\n}\nb = 2;",
    "colons": "switch (k) {\ncase 1:\na = 1;\ncase 2: case 3:\nb = 2;\nbreak;\ndefault:\nc = 3;\n}\nd = 4;",
    "arrows": "switch (k) {\ncase 1, 2 -> a = 1;\ncase 3 -> {\nb = 2;\n}\n}\nd = 4;",
    "handlers": "try {\nf();\na = 1;\n} catch (E e) {\ng();\n} catch (G e) { }\nb = 2;",
    "last": "try {\nif (x)\nreturn;\nf();\n} finally {\na = 1;\n}\nb = 2;",
    "both": "while (x) {\ntry {\nf();\nbreak;\n} catch (E e) {\nthrow e;\n} finally {\na = 1;\n}\n}\nb = 2;",
    "resources": "try (R r = new R()) {\n} catch (E e) {\na = 1;\n}\nb = 2;",
    "values": "int v = switch (k) {\ncase 1 -> { yield 2; }\ndefault -> 3;\n};\nRunnable r = () -> {\nreturn;\n};\nsynchronized (this) {\nb = 2;\n}",
    "paths": "P p = make();\nthis.f = p.x;\np.x.y = f;\np.a.b.c.d = 1;\nq[i] = p.a.b.c.e;\nuse(q[j], p.x.z);\np = null;\nuse(p.x, String.valueOf(1));\ni += q.length;\nfor (P r : list) use(r);\nif (o instanceof P t) use(t.x);",
    "locals": "class In { int z() { return 1; } }\na = 1;",
}
SOURCE = "class T {\nint f; int[] q; int i, j; java.util.List<P> list; Object o;\n" + "".join(f"void {name}() {{\n{text}\n}}\n" for name, text in METHODS.items()) + "}\n"
F, T, N, L, X, R = "fallthrough", "true", "false", "loop_back", "exception", "return"
CFG = {
    "straight": [("@entry", 1, F), (1, 2, F), (2, "@exit", F)],
    "empty": [("@entry", "@exit", F)],
    "branch": [("@entry", 1, F), (1, 2, T), (1, 4, N), (2, 5, F), (4, 5, F), (5, "@exit", F)],
    "chain": [("@entry", 1, F), (1, 2, T), (1, 3, N), (2, 5, F), (3, 5, T), (3, 5, N), (5, "@exit", F)],
    "until": [("@entry", 2, F), (2, 1, F), (1, 2, L), (1, 4, N), (4, "@exit", F)],
    "endless": [("@entry", 1, F), (1, 2, T), (2, 1, L)],
    "colons": [("@entry", 1, F), (1, 3, "switch_case"), (1, 5, "switch_case"), (1, 8, "switch_case"), (3, 5, F), (5, 6, F), (6, 10, "break"), (8, 10, F), (10, "@exit", F)],
    "arrows": [("@entry", 1, F), (1, 2, "switch_case"), (1, 4, "switch_case"), (1, 7, "switch_case"), (2, 7, F), (4, 7, F), (7, "@exit", F)],
    "handlers": [("@entry", 1, F), (1, 2, F), (2, 3, F), (2, 4, X), (2, 6, X), (3, 7, F), (4, 5, F), (5, 7, F), (5, "@exit", X), (6, 7, F), (7, "@exit", F)],
    "last": [("@entry", 1, F), (1, 2, F), (2, 3, T), (2, 4, N), (3, 5, R), (4, 5, F), (4, 5, X), (5, 6, F), (6, 8, F), (6, "@exit", R), (6, "@exit", X), (8, "@exit", F)],
    "both": [
        ("@entry", 1, F), (1, 2, T), (1, 11, N), (2, 3, F), (3, 4, F), (3, 5, X), (4, 7, "break"), (5, 6, F), (6, 7, X), (7, 8, F), (8, 1, L), (8, 11, "break"), (8, "@exit", X), (11, "@exit", F),
    ],
    "resources": [("@entry", 1, F), (1, 5, F), (1, 2, X), (2, 3, F), (3, 5, F), (5, "@exit", F)],
    "values": [("@entry", 1, F), (1, 5, F), (5, 8, F), (8, 9, F), (9, "@exit", F)],
    "locals": [("@entry", 2, F), (2, "@exit", F)],
}


@pytest.fixture(scope="module")
def graphs(spark):
    return flow(analyze(J.from_rows(spark.createDataFrame([("app", "T.java", SOURCE)], "app string, file_key string, source string"))))


def edges(found, name):
    start = SOURCE[: SOURCE.index(f"void {name}(")].count("\n") + 1
    line = lambda x: x if x[0] == "@" else int(x.split(":")[0]) - start
    return sorted(((line(r.src), line(r.dst), r.kind) for r in found.where(f"callable_id = 'T#{name}()'").collect()), key=str)


@pytest.fixture(scope="module")
def found(graphs):
    return graphs.cfg.cache()


@pytest.mark.parametrize("name", CFG)
def test_control_flow(found, name):
    assert edges(found, name) == sorted(CFG[name], key=str)


def test_loops_and_labels(found):
    got = [(r.src, r.dst, r.kind) for r in found.where("callable_id = 'T#loops()'").collect()]
    kinds = sorted(k for *_, k in got)
    assert kinds == sorted([F, T, N, T, N, T, N, "continue", "break", L, T, N, F])
    at = SOURCE[: SOURCE.index("void labels(")].count("\n") + 1
    got = {(int(a.split(":")[0]) - at, b if b[0] == "@" else int(b.split(":")[0]) - at, k) for a, b, k in ((r.src, r.dst, r.kind) for r in found.where("callable_id = 'T#labels()'").collect()) if a[0] != "@"}
    assert got == {(2, 3, T), (3, 4, T), (3, 2, N), (4, 4, T), (4, 5, N), (4, 8, "break"), (5, 2, "continue"), (8, "@exit", F)}


def _reach(pairs, start, without):
    seen, todo = set(), [start]
    while todo:
        node = todo.pop()
        if node != without and node not in seen:
            seen.add(node)
            todo += [b for a, b in pairs if a == node]
    return seen


def test_control_dependence_is_what_its_definition_says(graphs, found):
    """Brute force: b depends on edge a -> s if b post-dominates s and not strictly a; by reachability of the exit without b."""
    for name in [n for n in METHODS if n != "endless"]:
        cfg = [(r.src, r.dst, r.kind) for r in found.where(f"callable_id = 'T#{name}()'").collect()] + [("@entry", "@exit", F)]
        pairs = {(a, b) for a, b, _ in cfg}
        nodes = {x for p in pairs for x in p}
        post = {(b, a) for a, b in itertools.product(nodes, nodes) if a == b or "@exit" not in _reach(pairs, a, b)}
        wanted = {(a, b, k) for a, s, k in cfg for b in nodes if (b, s) in post and ((b, a) not in post or a == b) and b != "@exit"}
        assert {(r.src, r.dst, r.kind) for r in graphs.cdg.where(f"callable_id = 'T#{name}()'").collect()} == wanted, name


def test_endless_loops_depend_on_the_entry(graphs):
    assert ("@entry", 1, F) in edges(graphs.cdg, "endless")


def test_data_dependence(graphs):
    start = SOURCE[: SOURCE.index("void paths(")].count("\n") + 1
    line = lambda x: x if x[0] == "@" else int(x.split(":")[0]) - start
    got = {(line(r.src), line(r.dst), r.var, r.base) for r in graphs.ddg.where("callable_id = 'T#paths()'").collect()}
    assert got == {
        (1, 2, "p.x", "local"), (2, 3, "this.f", "field"),
        (1, 5, "p.a.b.c.*", "local"), (4, 5, "p.a.b.c.*", "local"), ("@entry", 5, "this.i", "field"),
        ("@entry", 6, "this.q[*]", "field"), (5, 6, "this.q[*]", "field"), ("@entry", 6, "this.j", "field"), (1, 6, "p.x.z", "local"),
        (7, 8, "p.x", "local"), ("@entry", 9, "this.i", "field"), ("@entry", 9, "this.q.length", "field"),
        ("@entry", 10, "this.list", "field"), (10, 10, "r", "local"), ("@entry", 11, "this.o", "field"), (11, 11, "t.x", "local"),
    }


def test_nodes(graphs):
    rows = [(r.node_id, r.kind) for r in graphs.nodes.where("callable_id = 'T#colons()'").collect()]
    assert sorted(k for _, k in rows) == ["entry", "exit", "statement", "statement", "statement", "statement", "statement", "switch"]


def test_text_that_is_no_java_and_no_files(spark):
    rows = [("app", "B.java", "class B { void f() { if ( else } case ; ) for while { try catch } void g() { switch (x) { case } }"), ("app", "N.java", None), ("app", "E.java", "")]
    for some in (rows, []):
        found = flow(analyze(J.from_rows(spark.createDataFrame(some, "app string, file_key string, source string"))))
        assert found.cfg.count() >= 0 and found.cdg.count() >= 0 and found.ddg.count() >= 0
