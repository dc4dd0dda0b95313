"""Vector search against numpy."""

from __future__ import annotations

import numpy as np
import pytest

from cartlore.operators import recommend
from cartlore.operators import similarity as sim
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def data(spark):
    """Vectors of which a third are copies of one, so ties and a crowded cell occur."""
    rng = np.random.default_rng(3)
    corpus = rng.normal(size=(150, 8)).astype(np.float32)
    corpus[50:100] = corpus[50]
    corpus[149] = 0
    queries = rng.normal(size=(23, 8)).astype(np.float32) * 5
    queries[4] = corpus[50]

    def frame(rows, prefix, name):
        return spark.createDataFrame([(f"{prefix}{i:03d}", r.tolist()) for i, r in enumerate(rows)], f"{name} string, vec array<float>").repartition(3)

    return queries, corpus, sim.Side(frame(queries, "q", "qid"), "qid", "vec"), sim.Side(frame(corpus, "c", "cid"), "cid", "vec")


def brute(queries, corpus, k):
    def unit(m):
        m = m.astype(np.float64)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

    scores = np.round(unit(queries) @ unit(corpus).T, 9)
    out = {}
    for i, row in enumerate(scores):
        best = sorted(range(len(row)), key=lambda j: (-row[j], f"c{j:03d}"))[:k]
        out[f"q{i:03d}"] = [(f"c{j:03d}", row[j]) for j in best]
    return out


def found(df, query="qid", item="cid"):
    out = {}
    for r in df.orderBy(query, "rank").collect():
        out.setdefault(r[query], []).append((r[item], r.score))
    return out


@pytest.mark.parametrize("way", [{}, {"broadcast_queries": 3}, {"broadcast_queries": 3, "block_rows": 7}])
@pytest.mark.parametrize("k", [1, 5, 60, 200])
def test_exact_search(data, way, k):
    queries, corpus, q, c = data
    actual, expected = found(sim.vector_topk(q, c, k, **way)), brute(queries, corpus, k)
    assert actual.keys() == expected.keys()
    for key in expected:
        assert [i for i, _ in actual[key]] == [i for i, _ in expected[key]]
        assert [s for _, s in actual[key]] == pytest.approx([s for _, s in expected[key]], abs=1e-8)


@pytest.mark.parametrize("way", [{}, {"broadcast_queries": 3, "block_rows": 20}])
def test_payload_comes_with_the_hits(data, way):
    _, _, q, c = data
    rich = sim.Side(c.df.withColumn("note", F.concat(F.lit("n"), "cid")).withColumn("tags", F.array("cid")), "cid", "vec")
    rows = sim.vector_topk(q, rich, 7, ["note", "tags"], **way).collect()
    assert len(rows) == 23 * 7 and all(r.note == "n" + r.cid and r.tags == [r.cid] for r in rows)


def test_block_search_plans_no_product(data):
    _, _, q, c = data
    hits = sim.vector_topk(q, c, 3, broadcast_queries=3)
    plan = hits._sc._jvm.PythonSQLUtils.explainString(hits._jdf.queryExecution(), "simple")
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_index_search(data):
    _, _, q, c = data
    index = sim.build_ivf(c, 6)
    exact = sim.vector_topk(q, c, 10)

    def mean_recall(nprobe):
        hits = sim.search_ivf(q, index, nprobe, 10, block_rows=9)
        return sim.recall(exact, hits, "qid", "cid").agg(F.avg("recall")).first()[0]

    assert mean_recall(6) == 1.0
    assert 0.3 < mean_recall(2) <= 1.0


def test_index_is_stored_by_cell(data, spark, tmp_path):
    _, _, _, c = data
    index = sim.build_ivf(c, 4, train_share=0.9)
    sim.write_vectors(index, f"{tmp_path}/ivf")
    stored = sim.read_vectors(spark, f"{tmp_path}/ivf").rows
    assert stored.count() == 150
    plan = stored.filter("cell = 1").select("cid")
    assert "PartitionFilters: [isnotnull(cell" in plan._sc._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "simple")


def test_filter_falls_back_to_all(spark):
    hits = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "y", 1), ("b", None, 2)], "q string, item string, rank int")
    kept = sim.prefer_matching(hits, "q", F.col("item") == "x").collect()
    assert sorted((r.q, r.rank) for r in kept) == [("a", 1), ("b", 1), ("b", 2)]


def test_tower_matches_numpy(spark):
    rng = np.random.default_rng(0)
    w = recommend.TowerWeights(rng.normal(size=(16, 10)), rng.normal(size=16), rng.normal(size=(8, 16)), rng.normal(size=8))
    e, c = rng.normal(size=(5, 8)).astype(np.float32), rng.normal(size=(5, 2)).astype(np.float32)
    df = spark.createDataFrame([(i, e[i].tolist(), c[i].tolist()) for i in range(5)], "id int, e array<float>, c array<float>")
    rows = recommend.tower(df, w, "e", "c").orderBy("id").collect()
    x = np.concatenate([e, c], axis=1).astype(np.float64)
    y = np.maximum(x @ w.hidden.T + w.hidden_bias, 0) @ w.out.T + w.out_bias
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    assert np.allclose([r.vector for r in rows], y, atol=1e-5)
