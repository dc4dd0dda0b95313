"""Searches against brute force: ties, hot vectors, clusters, awkward vectors, small groups and blocks."""

from __future__ import annotations

import math

import numpy as np
import pytest

from cartlore.llm import pivots

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v string, cell string, score string, rank string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y", "z", "s", "r") for i, v in rows], SCHEMA).repartition(3)


def brute(rows, k=5, every=50):
    kept = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * x) for x in map(float, np.float32(v))]))
    found = []
    for q, v in kept:
        if q is not None and q % every == 0:
            scores = [(-sum(a * b for a, b in zip(v, w)), i is None, i) for i, w in kept if i != q]
            found += [(q, n + 1, i, -s) for n, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(found, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def clustered(n, dims, seed, spread):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(8, dims))
    return (centres[draw.integers(0, 8, n)] + spread * draw.normal(size=(n, dims))).tolist()


@pytest.mark.parametrize("spread", [0.05, 5.0])
def test_whole_search(spark, spread):
    rows = list(enumerate(clustered(700, 12, 3, spread)))
    assert found(pivots.nearest(table(spark, rows))) == brute(rows)


def test_small_groups_and_blocks(spark, monkeypatch):
    rows = [(i, [float(math.floor(256 * x)) for x in v]) for i, v in enumerate(clustered(600, 6, 4, 0.1))]
    vectors = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    index = pivots.build_index(vectors, pivots=7, sample=50, block=16)
    result = pivots.search(index, vectors.filter("id % 7 = 0"), 4, group=9)
    expected = brute([(i, [x / 256 for x in v]) for i, v in rows], 4, 7)
    assert found(result.selectExpr("query_id", "rank", "id", "CAST(score AS LONG)")) == expected
    assert index.rows.count() == 600 and index.blocks.count() >= 38


def test_bounds_exclude_blocks_of_other_clusters(spark):
    rows = [(i, v) for i, v in enumerate(clustered(2000, 8, 5, 0.01))]
    vectors = pivots.quantized(table(spark, rows))
    index = pivots.build_index(vectors, pivots=8, block=64)
    asked = pivots._grouped(index, vectors.filter("id % 50 = 0"), 4)
    bounds = pivots._bounds(index, asked)
    away = np.sqrt(np.array([r[0] for r in bounds.select("least").collect()]) ** 2)
    assert (away > 100).mean() > 0.5


def test_hot_vectors_and_ties(spark):
    same = [0.5, -0.25, 0.125]
    rows = [(i, same if i % 3 else [0.0, 0.0, 0.0]) for i in range(400)] + [(1000 + i, [0.5, 0.0, 0.0]) for i in range(5)]
    assert found(pivots.nearest(table(spark, rows))) == brute(rows)


def test_awkward_vectors(spark):
    rows = [
        (0, [1.0, 2.0]), (50, None), (100, [1.0, None]), (150, [float("nan"), 1.0]), (200, [float("inf"), 1.0]), (250, []),
        (300, [3.0]), (350, [1.0, 2.0, 3.0]), (None, [5.0, 5.0]), (None, [5.0, 5.0]), (7, [1e4, -1e4]), (8, [0.001, -0.001]),
        (-50, [-1.0, 0.5]),
    ]
    assert found(pivots.nearest(table(spark, rows))) == brute(rows)
    vast = found(pivots.nearest(table(spark, [(0, [3e38, 3e38]), (1, [3e38, 3e38]), (2, [-3e38, 1.0])])))
    assert [r[:3] for r in vast] == [(0, 1, 1), (0, 2, 2)] and vast[0][3] > 9e18 > -9e18 > vast[1][3]


def test_repeated_and_few_rows(spark):
    twice = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0])]
    assert found(pivots.nearest(table(spark, twice))) == brute(twice)
    assert found(pivots.nearest(table(spark, [(0, [1.0])]))) == []
    assert found(pivots.nearest(table(spark, []))) == []
    assert found(pivots.nearest(table(spark, [(0, []), (1, [])]))) == [(0, 1, 1, 0)]
