"""Task sizes of as-of joins."""

from __future__ import annotations

from datetime import datetime

from cartlore.operators import asof
from cartlore.session import fine_tasks
from pyspark.sql import functions as F


def test_asof_tasks_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(asof, "TASK_ROWS", 20)
    at = datetime(2024, 1, 1)
    spine = spark.createDataFrame([(f"k{i}", at, i) for i in range(300)], "k string, at timestamp, row int")
    feats = spark.createDataFrame([(f"k{i}", at, i) for i in range(300)], "k string, ts timestamp, v int")
    joined = asof.asof_join(spine, [asof.AsOfView("f", feats, ("k",), "ts", {"v": "v"})], ts="at")
    assert joined.rdd.getNumPartitions() == 30
    assert joined.filter(F.col("row") == F.col("v")).count() == 300


def test_fine_tasks_are_left_again(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    before = [spark.conf.get(k, None) for k in keys]
    with fine_tasks(spark):
        assert [spark.conf.get(k, None) for k in keys] != before
    assert [spark.conf.get(k, None) for k in keys] == before
