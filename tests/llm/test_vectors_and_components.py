"""Near-duplicate vectors and connected components against brute force."""

import collections

import numpy as np
import pytest

from codestrata.llm import components as cc
from codestrata.llm import embedding_dedup


def brute(rows):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)]
    unit = [v / np.linalg.norm(v) for _, v in good]
    links, parent = collections.Counter(), list(range(len(good)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(good)):
        for b in range(a):
            if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    low = {}
    for a, (i, _) in enumerate(good):
        low[find(a)] = min(low.get(find(a), i), i)
    out = [(i, links[a], low[find(a)]) for a, (i, _) in enumerate(good)]
    rest = [(i, 0, i) for i, v in rows if not any(i == g for g, _ in good)]
    return collections.Counter(out + rest)


@pytest.mark.parametrize("options", [{}, {"leaf": 30, "sample": 100}, {"max_leaf": 120, "leaf": 40, "sample": 60, "spill": 0.3}])
def test_forest(spark, options):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((60, 24))
    rows = []
    for k in range(600):
        v = centres[k % 60] + rng.standard_normal(24) * (0.12 if k % 3 else 0.4)
        rows.append((k, [float(np.float32(x)) for x in v]))
    rows += [(1000 + k, rows[7][1]) for k in range(5)]
    rows += [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] + [1.0] * 23), (2003, [None] + [1.0] * 23), (2004, [float("inf")] * 24), (2005, [1.0, 2.0]), (2006, []), (None, rows[3][1])]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, cell string")
    found = embedding_dedup.near_duplicates(frame, **options).collect()
    wanted = brute(rows)
    got = collections.Counter((r.vec_id, r.n_links, r.component_id) for r in found)
    assert len(found) == len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    total = sum(k[1] * n for k, n in wanted.items())
    assert sum(k[1] * n for k, n in got.items()) >= 0.97 * total and total > 1000
    limit = {k[0]: k[1] for k in wanted}
    assert all(r.n_links <= limit[r.vec_id] for r in found)
    if not options:
        assert got == wanted


def test_forest_with_a_third_alike(spark):
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(64)
    alike = centre / np.linalg.norm(centre) + rng.standard_normal((800, 64)) * 0.225 / 8  # cosines about the threshold
    x = np.concatenate([alike, rng.standard_normal((1600, 64))]).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    wanted = (unit @ unit.T >= 0.95).sum(1) - 1
    frame = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "vec_id long, embedding array<float>")
    found = embedding_dedup.near_duplicates(frame, leaf=20, sample=1200, max_leaf=200, block=150).collect()
    links = np.zeros(len(x), int)
    for r in found:
        links[r.vec_id] = r.n_links
    assert wanted.sum() > 200_000 and (links <= wanted).all()
    assert links.sum() >= 0.995 * wanted.sum()


def test_forest_ends_on_collinear_vectors(spark):
    rows = [(k, [float(k + 1), 0.0, 0.0]) for k in range(900)] + [(2000 + k, [0.0, 1.0 + k, 0.0]) for k in range(3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = embedding_dedup.near_duplicates(frame, max_leaf=40, block=200).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in found} == {(k, 899, 0) for k in range(900)} | {(2000 + k, 2, 2000) for k in range(3)}


def test_forest_ends_where_a_split_parts_next_to_nothing(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.eye(8)[0] + rng.standard_normal((300, 8)) * 0.03, rng.standard_normal((20, 8))])
    frame = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "vec_id long, embedding array<double>")
    found = embedding_dedup.near_duplicates(frame, max_leaf=30, block=100).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert [r.n_links for r in sorted(found, key=lambda r: r.vec_id)] == ((unit @ unit.T >= 0.95).sum(1) - 1).tolist()


def test_forest_over_one_large_group(spark):
    """More vectors alike than a leaf may hold, at the default parameters: every link is found."""
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(48)
    alike = centre / np.linalg.norm(centre) + rng.standard_normal((4600, 48)) * 0.215 / 48**0.5
    x = np.concatenate([alike, rng.standard_normal((400, 48))]).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    wanted = (unit @ unit.T >= 0.95).sum(1) - 1
    frame = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "vec_id long, embedding array<float>")
    links = np.zeros(len(x), int)
    for r in embedding_dedup.near_duplicates(frame).collect():
        links[r.vec_id] = r.n_links
    assert wanted.sum() > 5_000_000 and (links == wanted).all()


def test_forest_of_nothing(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicates(frame).count() == 0


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)] + [(5, 5), (None, 3), (7, None)]
    found = {r.node: r.component for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    assert found == {x: find(x) for x in list(parent)}
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_large_hub(spark):
    edges = spark.range(5000).selectExpr("7000000L AS a", "id * 3 + 10 AS b").union(spark.range(40).selectExpr("id AS a", "id + 1 AS b").union(spark.sql("SELECT 40L, 10L")))
    found = {(r.component, r["count"]) for r in cc.components(edges).groupBy("component").count().collect()}
    assert found == {(0, 5001 + 41 - len(set(range(41)) & set(range(10, 15010, 3))))}
