"""Shuffles of candidate lists."""

from __future__ import annotations

import numpy as np
import pytest

from cartlore.operators import recommend
from cartlore.operators import similarity as sim


@pytest.fixture
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def vectors(spark, n, name, ids=None):
    rng = np.random.default_rng(5)
    rows = [(ids(i) if ids else f"{name}{i:04d}", rng.normal(size=6).tolist(), f"payload {i}") for i in range(n)]
    return spark.createDataFrame(rows, f"{name} string, vec array<double>, note string")


def test_candidate_lists_are_cut_where_user_vectors_are_joined(spark, no_broadcast):
    """Two shuffles by user, of candidates and of vectors; no third one for the lists, and no vector of unknown ids on the way."""
    users = sim.Side(vectors(spark, 5, "user_id"), "user_id", "vec")
    items = sim.Side(vectors(spark, 5, "item_id"), "item_id", "vec")
    candidates = spark.createDataFrame([(f"user_id{u:04d}", f"item_id{i:04d}") for u in range(7) for i in range(7)], "user_id string, item_id string")
    lists = recommend.recommend_candidates(candidates, users, items, 2, overfetch=1)
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(user_id") == 2
    assert lists.count() == 14
