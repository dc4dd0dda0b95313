"""Lookups of drawn pairs."""

from __future__ import annotations

import pytest

from cartlore.operators import training


@pytest.fixture
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("packed", [1 << 25, 0])
def test_negatives_find_categories_without_a_join_of_pairs(spark, monkeypatch, no_broadcast, packed):
    """Ids across several runs, packed or joined, get their own category."""
    monkeypatch.setattr(training, "PACKED_IDS", packed)
    monkeypatch.setattr(training, "PACKED_RUN", 4)
    rows = [(f"r{i:02d}", i % 11, i % 7, (i % 11) % 5, (i % 7) % 3, 1.0) for i in range(77)]
    samples = spark.createDataFrame(rows, "row_key string, user_idx long, item_idx long, user_cat_idx long, item_cat_idx long, label float")
    drawn = training.negatives(samples, 11, 7)
    assert drawn.dtypes == samples.dtypes
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert ("SortMergeJoin" in plan) == (packed == 0)
    found = drawn.collect()
    assert len(found) == 2 * 77
    assert all(r.user_cat_idx == r.user_idx % 5 and r.item_cat_idx == r.item_idx % 3 for r in found)
