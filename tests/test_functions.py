"""Scalar functions and rules on single values."""

import pytest
from pyspark.sql import functions as F

from codestrata.functions import text as T
from codestrata.operators import joins, rules


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("source", "line", "col", "wanted"),
    [("abc\ndef\n", 1, 0, 0), ("abc\ndef\n", 1, 3, 3), ("abc\ndef\n", 2, 0, 4), ("abc\ndef\n", 2, 3, 7), ("é = 1\n", 1, 1, 2), ("é = 1\n", 1, 3, 4), ("é\nx\n", 2, 0, 3), ("é\nx\n", 2, 1, 4)],
)
def test_byte_offsets(spark, source, line, col, wanted):
    files = spark.createDataFrame([("f", source)], "file_key string, source string")
    spans = spark.createDataFrame([("f", line, col)], "file_key string, line int, col int")
    assert T.byte_offset(spans, T.line_table(files, "file_key", "source"), files, "file_key", "source").first()["byte"] == wanted


@pytest.mark.parametrize(("source", "line", "col", "size"), [("ab\r\ncd\r\n", 3, 1, 8), ("ab\ncd", 2, 3, 5), ("", 1, 1, 0), ("é\r", 2, 1, 3)])
def test_whole_span(spark, source, line, col, size):
    found = one(spark, T.whole_span("s"), s=source)
    assert (found.end_line, found.end_col, found.n_bytes) == (line, col, size)


def test_names(spark):
    assert one(spark, T.simple_name("s"), s="a.b.C") == "C" and one(spark, T.package_of("s"), s="a.b.C") == "a.b" and one(spark, T.package_of("s"), s="C") == ""
    assert one(spark, T.callable_name("s"), s="a.B.run(int, x.Y)") == "run" and one(spark, T.upper_snake("s"), s="getSingleResult") == "GET_SINGLE_RESULT"
    assert one(spark, T.dotted_name("s"), s="a/b$C") == "a.b.C" and one(spark, T.first_of_union("s"), s="A | B") == "A"
    assert one(spark, T.int_or_null("s"), s="12") == 12 and one(spark, T.int_or_null("s"), s="x") is None
    assert one(spark, T.first_non_blank("a", "b"), a="  ", b="q") == "q"
    assert one(spark, T.durable_id("a", "f", F.lit("T")), a="myapp", f=".\\a\\b/C.java") == "can://java/myapp/a/b/C.java/T"
    assert one(spark, T.constructor_display("s", "t"), s="<init>(int)", t="a.Foo") == "Foo(int)"


def test_literals(spark):
    assert one(spark, T.cypher_string("s"), s="it's\n\\") == "'it\\'s\\n\\\\'" and one(spark, T.cypher_string(F.lit(None).cast("string")), s="") == "null"
    assert one(spark, T.cypher_list("s"), s=["a", "b"]) == "['a', 'b']"
    assert one(spark, T.slice_bytes("s", F.lit(2), F.lit(5)), s="é€x") == "€" and one(spark, T.slice_bytes("s", F.lit(2), F.lit(3)), s="éab") == "a"


@pytest.mark.parametrize(
    ("receiver", "method", "argument", "operation", "query"),
    [
        ("javax.EntityManager", "persist", None, "CREATE", None),
        ("EntityManager", "find", None, "READ", None),
        ("EntityManager", "merge", None, "UPDATE", None),
        ("EntityManager", "remove", None, "DELETE", None),
        ("Query", "getResultList", None, "READ", None),
        ("TypedQuery<X>", "executeUpdate", None, "UPDATE", None),
        ("EntityManager", "createQuery", '"SELECT x"', None, "READ"),
        ("EntityManager", "createQuery", '"delete from x"', None, "WRITE"),
        ("EntityManager", "createNamedQuery", "NAME", None, "NAMED"),
        ("Other", "persist", None, None, None),
    ],
)
def test_data_access_rules(spark, receiver, method, argument, operation, query):
    row = {"receiver_type": receiver, "method_name": method, "argument_expr": [argument] if argument else []}
    assert one(spark, rules.data_access("operation", compat=False), **row) == operation
    assert one(spark, rules.data_access("query", compat=False), **row) == query
    assert one(spark, rules.crud_query(), **row) == (query if query == "NAMED" else None)


def test_json_members(spark):
    texts = ['{"a.b": "x", "n": 1.50, "o": {"p": [1, 2]}, "z": null}', '{"n": true}', "[1]", "{", "", None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string")
    found = rows.select("i", *[T.json_member("text", k).alias(k.replace(".", "_")) for k in ("a.b", "n", "o", "z")]).orderBy("i").collect()
    assert [tuple(r)[1:] for r in found] == [("x", "1.5", '{"p":[1,2]}', None), (None, "true", None, None)] + [(None,) * 4] * 4


def test_rules_by_name():
    for call in (lambda: rules.crud_rule("operation", "struts"), lambda: rules.entrypoint_rule("class", "none")):
        with pytest.raises(ValueError):
            call()


def test_fuzzy_signatures(spark):
    sites = spark.createDataFrame([(1, "T", "m", ["java.util.List", "int"]), (2, "T", "m", []), (3, "T", "m", ["int"])], "site int, owner string, name string, params array<string>")
    declared = spark.createDataFrame([("T", "m", ["List", "int"], 10), ("T", "m", [], 11)], "owner string, name string, params array<string>, declared_id int")
    assert {r.site: r.declared_id for r in joins.fuzzy_signature_join(sites, declared, "site").collect()} == {1: 10, 2: 11, 3: None}
