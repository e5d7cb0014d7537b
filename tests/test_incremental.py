"""A refreshed analysis equals one of all files, and reads few of them."""

from dataclasses import fields

import pytest
from pyspark.sql import functions as F

from codestrata.plans.analyze import Analysis, analyze
from codestrata.sources import java_source as J
from codestrata.streaming import incremental

FILES = {
    "p/A.java": "package p;\nimport q.*;\nclass A {\n  B b = new B();\n  void f() { b.g(); var x = b.peer(); x.tail(); take(Maker.make()); }\n  void take(Top t) { }\n  void take(Object o) { }\n}\n",
    "p/Top.java": "package p;\npublic class Top { void tail() { } }\n",
    "p/Maker.java": "package p;\nimport q.B;\nclass Maker { static B make() { return new B(1); } }\n",
    "q/B.java": "package q;\nimport p.Top;\npublic class B extends Top {\n  public B() { }\n  public B(int n) { }\n  public void g() { int i = 0; if (i > 0) { i++; } }\n  public B peer() { return this; }\n}\n",
    "r/Lone.java": "package r;\nenum Lone { X, Y(2); Lone() { } Lone(int n) { } void run() { Runnable z = () -> { }; z.run(); } }\n",
    "r/Rec.java": "package r;\n// note\nrecord Rec(int a, String b) { Rec { a = 1; } static { Lone.X.run(); } }\n",
}


def table(spark, files):
    return J.from_rows(spark.createDataFrame([("app", k, v) for k, v in files.items()], "app string, file_key string, source string"))


def rows(frame):
    return sorted(r.value for r in frame.select(F.to_json(F.struct(*sorted(frame.columns)), {"ignoreNullFields": "false"}).alias("value")).collect())


@pytest.fixture(autouse=True)
def interpreted(spark):
    """Many small jobs: compiling each costs more than it saves."""
    few = {"spark.sql.codegen.wholeStage": "false", "spark.sql.shuffle.partitions": "1"}
    before = {key: spark.conf.get(key) for key in few}
    for key, value in few.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def assert_same(found, spark, files):
    whole = analyze(table(spark, files))
    for name in (f.name for f in fields(Analysis)):
        assert rows(getattr(found, name)) == rows(getattr(whole, name)), name


def test_refresh_reads_users_only(spark, tmp_path):
    folder, files = str(tmp_path), dict(FILES)
    out = incremental.refresh(table(spark, files), folder, buckets=4)
    assert {r.status for r in out.status.collect()} == {"new"}
    # An ancestor less: who names the class, a member of the ancestor, or (here by the word `b`) what holds the class.
    files["q/B.java"] = files["q/B.java"].replace(" extends Top", "")
    out = incremental.refresh(table(spark, files), folder)
    users = {"p/A.java", "p/Maker.java", "p/Top.java", "r/Rec.java"}
    assert {(r["round"], r.file_key) for r in out.analysed.collect()} == {(0, "q/B.java")} | {(1, key) for key in users}
    assert_same(incremental.load(spark, folder), spark, files)
