"""Request metrics on small series."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from cartlore.operators import telemetry as tm
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1)


def values(spark, numbers, service="s"):
    return spark.createDataFrame([(service, float(n)) for n in numbers], "service string, v double")


def quantile(spark, numbers, bounds, q):
    return tm.histogram_quantile(tm.histogram(values(spark, numbers), "v", bounds, ["service"]), q, ["service"]).first().value


def test_buckets_are_cumulative(spark):
    hist = tm.histogram(values(spark, [1, 10, 10, 30, 99]), "v", [10, 25, 50], ["service"]).orderBy("le").collect()
    assert [r.cumulative for r in hist] == [3, 3, 4, 5]
    assert hist[0].n_values == 5 and hist[0].value_sum == 150 and hist[-1].le == float("inf")


@pytest.mark.parametrize(
    ("numbers", "q", "expected"),
    [
        ([1, 2, 3, 4], 0.5, 5.0),  # half way through 0..10
        ([1, 11, 12, 13], 0.5, 10 + 15 * (2 - 1) / 3),  # inside 10..25
        ([99, 100], 0.5, 50.0),  # open bucket: highest finite bound
        ([1, 30], 0.95, 25 + 25 * 0.9),  # an empty bucket in between
        ([1, 30], 0.5, 10.0),
    ],
)
def test_quantile_is_linear_in_its_bucket(spark, numbers, q, expected):
    assert quantile(spark, numbers, [10, 25, 50], q) == pytest.approx(expected)


def test_counter_restart(spark):
    samples = [(0, 10), (30, 15), (59, 18), (60, 20), (90, 3), (200, 4)]
    df = spark.createDataFrame([("a", T0 + timedelta(seconds=s), float(v)) for s, v in samples], "series string, ts timestamp, value double")
    found = tm.counter_increase(df, ["series"], "ts", "value", "1 minute", 60).orderBy("start").collect()
    assert [r.increase for r in found] == [8.0, 5.0, 1.0]  # 2 across the range border, then 3 after the restart
    assert found[0].per_second == pytest.approx(8 / 60)


def test_rates_slide(spark):
    df = spark.createDataFrame([("a", T0 + timedelta(seconds=s)) for s in (0, 20, 40)], "service string, ts timestamp")
    found = {r.start: r.n for r in tm.rate_window(df, "ts", "1 minute", 60, "15 seconds", ["service"]).collect()}
    assert found[T0] == 3 and found[T0 - timedelta(seconds=45)] == 1 and found[T0 + timedelta(seconds=30)] == 1
    assert len(found) == 6


def test_totals_and_zero(spark):
    df = spark.createDataFrame([("rec", 10.0, "ok"), ("rec", 30.0, "ok"), ("rag", 5.0, "error")], "service string, latency_ms double, status string")
    stats = {r.service: (r.total, r.avg_ms, r.best_ms, r.worst_ms) for r in tm.latency_stats(df).collect()}
    assert stats == {"rec": (2, 20.0, 10.0, 30.0), "rag": (1, 5.0, 5.0, 5.0), "all": (3, 15.0, 5.0, 30.0)}
    assert tm.count_or_zero(df, F.col("status") == "gone").first().n == 0
    assert tm.sum_or_zero(df.filter("status = 'gone'"), F.col("latency_ms")).first().total == 0.0
    assert tm.ratio(df, F.lit(1), F.lit(0), ["service"]).first().ratio is None


def test_latest_gauge(spark):
    df = spark.createDataFrame([("a", 1, T0), ("a", 2, T0 + timedelta(hours=1)), ("b", 3, T0)], "pod string, v int, ts timestamp")
    assert {r.pod: r.v for r in tm.latest_gauge(df, ["pod"], "v", "ts").collect()} == {"a": 2, "b": 3}
