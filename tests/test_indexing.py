"""Dense indices, splits, per-group cuts."""

from __future__ import annotations

import random

import pytest

from cartlore.operators import indexing, ranking
from pyspark.sql import functions as F


@pytest.mark.parametrize("partitions", ["1", "5"])
def test_ordinal_is_dense_and_sorted(spark, partitions):
    ids = [f"u{i}" for i in range(300)]
    df = spark.createDataFrame([(x,) for x in ids * 2] + [("hot",)] * 500 + [(None,)], "id string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        found = {r.id: r.idx for r in indexing.ordinal(df, "id").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == {x: i for i, x in enumerate(sorted([*ids, "hot"]))}


def test_index_of_nothing(spark):
    assert indexing.ordinal(spark.createDataFrame([], "id string"), "id").count() == 0


def test_exact_split_sizes(spark):
    df = spark.range(1003).select(F.col("id").cast("string").alias("k"))
    counts = {r.split: r["count"] for r in indexing.exact_split(df, "k", 0.9, 1).groupBy("split").count().collect()}
    assert counts == {"train": 902, "val": 101}


def test_hash_split_is_stable_and_close(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    first = indexing.hash_split(df, "k", 0.9, 1)
    again = indexing.hash_split(df.repartition(7), "k", 0.9, 1)
    assert first.exceptAll(again).count() == 0
    assert first.filter("split = 'train'").count() == pytest.approx(18_000, abs=200)


def test_shuffle_keeps_all_rows_and_repeats(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("k"))
    first = [r.k for r in indexing.shuffle_rows(df, "k", 3).collect()]
    assert first == [r.k for r in indexing.shuffle_rows(df.repartition(5), "k", 3).collect()]
    assert sorted(first) == sorted(str(i) for i in range(100)) and first != sorted(first)
    assert first != [r.k for r in indexing.shuffle_rows(df, "k", 4).collect()]


def test_unknown_ids(spark):
    vocabulary = spark.createDataFrame([("a", 0), ("b", 1)], "id string, idx long")
    df = spark.createDataFrame([("b",), ("zz",), (None,)], "id string")
    assert sorted(r.i for r in indexing.encode_ids(df, "id", vocabulary, "i").collect()) == [0, 0, 1]
    hashed = indexing.encode_ids(df.dropna(), "id", None, "i", "hash", 10).collect()
    assert all(0 <= r.i < 10 for r in hashed)


@pytest.mark.parametrize("n", [3, 1500])
def test_cut_per_group_with_a_hot_group_of_copies(spark, n):
    rng = random.Random(2)
    rows = [("hot", 5)] * 2500 + [("hot", rng.randrange(10)) for _ in range(500)]
    rows += [(rng.choice("abc"), rng.randrange(10)) for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(3)
    found = {}
    for r in ranking.top_n(df, ["k"], ["v"], n).collect():
        found.setdefault(r.k, []).append(r.v)
    for key in ("hot", "a", "b", "c"):
        assert sorted(found[key]) == sorted(v for k, v in rows if k == key)[:n]


def test_small_cut_is_done_before_the_shuffle(spark):
    df = ranking.top_n(spark.range(100).withColumn("k", F.col("id") % 3), ["k"], ["id"], 2)
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    below_exchange = plan.split("Exchange")[-1]
    assert "WindowGroupLimit" in below_exchange


def test_vocab_of_two_columns(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), (None, "a")], "x string, y string")
    assert sorted(r.value for r in indexing.vocab(df, ["x", "y"]).collect()) == ["a", "b", "c"]


@pytest.mark.parametrize("n", [1_000, 1_001])
def test_first_rows_of_groups_with_maps_and_equal_rows(spark, n):
    """The same on both sides of the map-side limit, also for columns that cannot be grouped by."""
    df = spark.range(6_000).selectExpr("'k' AS k", "id % 3 AS v", "map('a', id % 3) AS m").repartition(4)
    found = ranking.top_n(df, ["k"], ["v"], n).groupBy("v").count().collect()
    assert [tuple(r) for r in found] == [(0, n)]


def test_many_offsets_plan_quickly(spark):
    """Positions come from a joined table, however many partitions there are."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        found = indexing.global_index(spark.range(900).withColumn("key", -F.col("id")), ["key"])
        assert [r.idx for r in found.orderBy("key").collect()] == list(range(900))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
