"""Every registered query with SQL gives DuckDB's rows on the whole small tables, and its plan scales."""

from __future__ import annotations

import pytest
from comparing import assert_same

import __spark_entry__ as entry_points
from cartlore import checks

SF = "/root/testdata/sf0.001"
WITHOUT_SQL = {"cf_train", "ivf_search", "review_embeddings"}


def assert_scalable(df) -> None:
    """No product joins, no row-at-a-time Python, no window over one partition, no limit that gathers rows in one task."""
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "GlobalLimit", "CollectLimit"):
        assert operator not in plan
    lines = [line.lstrip(" :+-") for line in plan.splitlines()]
    for at, line in enumerate(lines):
        if line.startswith("Window "):
            below = next(x for x in lines[at + 1 :] if not x.startswith(("Sort", "Project", "WindowGroupLimit")))
            assert not below.startswith("Exchange SinglePartition"), line


@pytest.mark.parametrize("name", sorted(checks.SQL))
def test_same_as_sql(spark, name):
    df = entry_points.queries()[name](spark, SF)
    assert_scalable(df)
    assert_same(df, SF, entry_points.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_rows_only(spark, name):
    df = entry_points.queries()[name](spark, SF)
    assert_scalable(df)
    assert df.count() > 0


def test_only_inexact_queries_lack_sql():
    assert set(checks.QUERIES) - set(checks.SQL) == WITHOUT_SQL


def test_flagship(spark):
    assert entry_points.entry(spark).count() > 0
