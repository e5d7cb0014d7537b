from codestrata.sources.groups import by_group, by_groups


def test_many_groups_share_a_call_and_stay_apart(spark, monkeypatch):
    from codestrata.sources import groups

    monkeypatch.setattr(groups, "CALLS", 2)
    rows = spark.createDataFrame([(f"f{i % 7}", i, f"t{i}" if i % 3 else None) for i in range(70)], "key string, n int, text string")
    joined = by_group(rows.orderBy("text"), ["key"], ["n"], lambda n, text: [(n[0], None if None in text[:1] else text[0], n)], "key string, first int, text string, all array<int>")
    found = {r.key: r for r in joined.collect()}
    assert joined.rdd.getNumPartitions() <= 4 and len(found) == 7
    assert all(found[f"f{i}"].all == list(range(i, 70, 7)) and found[f"f{i}"].text == (f"t{i}" if i % 3 else None) for i in range(7))
    both = by_groups(rows.where("n < 3"), rows.select("key", "n").where("n > 1 and n < 5"), ["key"], lambda a, b: [(len(a[0]) if a else None, len(b[0]) if b else None)], "key string, a long, b long")
    assert {tuple(r) for r in both.collect()} == {("f0", 1, None), ("f1", 1, None), ("f2", 1, 1), ("f3", None, 1), ("f4", None, 1)}
