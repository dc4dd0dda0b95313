"""Every query over the whole small tables: the same as SQL where there is some, else a row for each row of the input."""

from __future__ import annotations

import pytest
from comparing import assert_same

import __spark_entry__ as entry_points
from cartlore import llm

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_same_as_sql(spark, name):
    assert_same(entry_points.queries()[name](spark, SF), SF, entry_points.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(llm.QUERIES) - set(llm.SQL)))
def test_a_row_for_each_row(spark, name):
    table = "conversations" if name.startswith("op10") else "documents"
    assert entry_points.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_native_mixing_runs_no_python(spark):
    plan = entry_points.queries()["op2_pareto_mix"](spark, SF)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "InArrow"))
