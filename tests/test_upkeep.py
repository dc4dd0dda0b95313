"""Index upkeep and two-level centres: recall after increments, untouched cells, splits, awkward rows."""

from __future__ import annotations

import numpy as np
import pytest

from cartlore.operators import centres as ce
from cartlore.operators import similarity as sim
from cartlore.operators import upkeep
from cartlore.sources import files
from pyspark.sql import functions as F

DIMS = 16


def clustered(n, seed, clusters=40, spread=0.25):
    rng = np.random.default_rng(seed)
    middle = np.random.default_rng(99).normal(size=(clusters, DIMS))
    return middle[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, DIMS))


def table(spark, x, first=0, prefix="c"):
    rows = [(f"{prefix}{first + i}", [float(v) for v in r], f"note{i}") for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "cid string, vec array<double>, note string")


def mean_recall(spark, index, rows, nprobe, k=10):
    queries = sim.Side(rows.filter(F.xxhash64("cid") % 7 == 0).select(F.col("cid").alias("qid"), "vec"), "qid", "vec")
    exact = sim.vector_topk(queries, sim.Side(rows, "cid", "vec"), k)
    hits = sim.search_ivf(queries, index, nprobe, k)
    return sim.recall(exact, hits, "qid", "cid").agg(F.avg("recall")).first()[0]


def cell_files(spark, path):
    found = files.glob(spark, f"{path}/rows/cell=*/*.parquet")
    return {int(f.split("/cell=")[1].split("/")[0]): frozenset(g for g in found if f.rsplit("/", 1)[0] + "/" in g) for f in found}


def test_increments_keep_the_recall_of_a_rebuild(spark, tmp_path):
    path = f"{tmp_path}/index"
    x = clustered(3000, 1)
    rows = table(spark, x)
    first = rows.filter("substring(cid, 2)::int < 1800")
    sim.write_vectors(sim.build_tree(sim.Side(first, "cid", "vec"), 48), path)
    moved = table(spark, clustered(300, 2))  # new vectors for c0 to c299
    upkeep.update_index(spark, path, rows.filter("substring(cid, 2)::int BETWEEN 1800 AND 2399"))
    upkeep.update_index(spark, path, rows.filter("substring(cid, 2)::int >= 2400"), first.filter("substring(cid, 2)::int >= 1700").select("cid"))
    upkeep.update_index(spark, path, moved)
    left = "substring(cid, 2)::int >= 300 AND NOT substring(cid, 2)::int BETWEEN 1700 AND 1799"
    now = rows.filter(left).unionByName(moved)
    index = sim.read_vectors(spark, path)
    assert index.rows.count() == now.count() == index.rows.select("cid").distinct().count()
    assert index.rows.join(now, ["cid", "vec", "note"], "left_anti").count() == 0
    kept = mean_recall(spark, index, now, 12)
    rebuilt = mean_recall(spark, sim.build_tree(sim.Side(now, "cid", "vec"), 48), now, 12)
    assert kept >= 0.9 and kept >= rebuilt - 0.02
    assert mean_recall(spark, index, now, len(index.centres)) == 1.0


def test_untouched_cells_are_not_written(spark, tmp_path):
    path = f"{tmp_path}/index"
    rows = table(spark, clustered(600, 3))
    sim.write_vectors(sim.build_tree(sim.Side(rows, "cid", "vec"), 20), path)
    before = cell_files(spark, path)
    one = rows.filter("cid = 'c5'").withColumn("note", F.lit("new"))
    (cell,) = upkeep.update_index(spark, path, one)
    after = cell_files(spark, path)
    assert {c for c in after if after[c] != before.get(c)} == {cell} and set(after) == set(before)
    assert [r.note for r in sim.read_vectors(spark, path).rows.filter("cid = 'c5'").collect()] == ["new"]
    upkeep.update_index(spark, path, one)  # the same again
    assert sim.read_vectors(spark, path).rows.count() == 600
    assert upkeep.update_index(spark, path) == []
    assert upkeep.update_index(spark, path, deleted=spark.createDataFrame([("nobody",)], "cid string")) == []


def test_a_cell_without_rows_goes(spark, tmp_path):
    path = f"{tmp_path}/index"
    x = np.vstack([clustered(200, 4), np.full((3, DIMS), 50.0) + np.eye(3, DIMS)])
    rows = table(spark, x)
    index = sim.IvfIndex(None, ce.Centres(np.vstack([np.eye(2, DIMS) * -1, np.full((1, DIMS), DIMS**-0.5)])), "cid", "vec")
    placed = sim.nearest_cells(rows, index.centres, 1, "vec")
    sim.write_vectors(sim.IvfIndex(placed, index.centres, "cid", "vec"), path)
    lone = [r.cid for r in sim.read_vectors(spark, path).rows.filter("cell = 2").collect()]
    cells = upkeep.update_index(spark, path, deleted=spark.createDataFrame([(c,) for c in lone], "cid string"))
    assert cells == [2] and 2 not in cell_files(spark, path)
    name = "c7"
    upkeep.update_index(spark, path, spark.createDataFrame([(name, None, "n")], "cid string, vec array<double>, note string"))
    assert sim.read_vectors(spark, path).rows.filter(F.col("cid") == name).count() == 0
    upkeep.update_index(spark, path, rows.filter(F.col("cid").isin(lone)))
    assert sim.read_vectors(spark, path).rows.filter("cell = 2").count() == len(lone)


@pytest.mark.parametrize("tree", [True, False])
def test_only_oversized_cells_are_split(spark, tmp_path, tree):
    path = f"{tmp_path}/index"
    rows = table(spark, clustered(400, 5))
    side = sim.Side(rows, "cid", "vec")
    sim.write_vectors(sim.build_tree(side, 16) if tree else sim.build_ivf(side, 16), path)
    assert upkeep.split_oversized(spark, path, 50) == []
    crowd = table(spark, clustered(2000, 6, clusters=1), 1000)
    upkeep.update_index(spark, path, crowd)
    before, n = cell_files(spark, path), len(sim.read_vectors(spark, path).centres)
    share = max(r.share for r in upkeep.cell_sizes(sim.read_vectors(spark, path)).collect())
    assert share > 4
    written = upkeep.split_oversized(spark, path, 4)
    after, index = cell_files(spark, path), sim.read_vectors(spark, path)
    assert {c for c in before if after.get(c) != before[c]} <= set(written)
    assert len(index.centres) > n and (index.centres.parent is None) != tree
    assert index.rows.count() == 2400 and index.rows.select("cid").distinct().count() == 2400
    sizes = {r.cell: r.share for r in upkeep.cell_sizes(index).collect()}
    assert max(sizes.values()) < share / 2
    everything = rows.unionByName(crowd)
    assert mean_recall(spark, index, everything, len(index.centres)) == 1.0
    upkeep.update_index(spark, path, crowd.limit(50))  # ids are found where the split has put them
    assert sim.read_vectors(spark, path).rows.count() == 2400


def test_equal_vectors_cannot_be_split(spark, tmp_path):
    path = f"{tmp_path}/index"
    rows = table(spark, np.vstack([np.eye(4, DIMS), np.ones((200, DIMS))]))
    sim.write_vectors(sim.build_ivf(sim.Side(rows, "cid", "vec"), 5), path)
    assert upkeep.split_oversized(spark, path, 1.5) == []


def test_tree_of_a_thousand_cells(spark):
    x = clustered(6000, 7, clusters=300)
    rows = table(spark, x)
    index = sim.build_tree(sim.Side(rows, "cid", "vec"), 1000)
    assert 850 <= len(index.centres) <= 1150 and len(index.centres.tops) == 31
    assert index.rows.count() == 6000
    assert mean_recall(spark, index, rows, 64) >= 0.9


def test_probing_top_down_without_pruning_is_exact():
    x = clustered(500, 8)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cells = ce.means(x, 30)
    tops = ce.means(cells, 5)
    parent = ce._far(cells, tops).argmin(axis=1)
    flat, tree = ce.Centres(cells), ce.Centres(cells, tops, parent)
    assert np.array_equal(flat.probe(x, 30), tree.probe(x, 30))
    same = (flat.probe(x, 1) == tree.probe(x, 1)).mean()
    assert same > 0.95


def test_sample_is_bounded_and_repeatable(spark):
    df = spark.range(20_000)
    drawn = ce.sample_of(df, 1000, "id")
    assert 850 < drawn.count() < 1150
    assert {r[0] for r in drawn.collect()} == {r[0] for r in ce.sample_of(df.repartition(7), 1000, "id").collect()}
    assert ce.sample_of(spark.range(50), 1000, "id").count() == 50
