"""Mergeable sketches within their stated errors, grids with gaps, and the join of two streams."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest

from cartlore.operators import asof, sketches
from cartlore.operators import telemetry as tm
from cartlore.streaming import joins
from cartlore.streaming import materialize as stream
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def test_merged_quantiles_are_within_the_stated_error(spark):
    rows = spark.range(0, 200_000, 1, 8).select(
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") % 7200).alias("ts"),
        F.pow(F.rand(3) * 30, 2).alias("v"), (F.col("id") % 2).alias("g"),
    )
    rows = rows.union(spark.createDataFrame([(None, 1.0, 0), (T0, None, 0)], "ts timestamp, v double, g long")).cache()
    minutes = sketches.quantile_sketches(rows, "ts", "v", "1 minute", ["g"])
    assert minutes.count() == 240
    hours = sketches.merge_quantiles(sketches.merge_quantiles(minutes, "5 minutes", ["g"]), "1 hour", ["g"])
    direct = sketches.quantile_sketches(rows, "ts", "v", "1 hour", ["g"])
    exact = {}
    for r in rows.filter("v IS NOT NULL AND ts IS NOT NULL").withColumn("start", F.date_trunc("hour", "ts")).collect():
        exact.setdefault((r.start, r.g), []).append(r.v)
    exact = {k: np.sort(v) for k, v in exact.items()}
    for found in (hours, direct):
        read = sketches.read_quantiles(found, [0.01, 0.5, 0.95, 0.99]).collect()
        assert len(read) == 4
        for r in read:
            values = exact[r.start, r.g]
            assert r.n == len(values)
            for q, v in ((0.01, r.p1), (0.5, r.p50), (0.95, r.p95), (0.99, r.p99)):
                assert abs(np.searchsorted(values, v) / len(values) - q) <= sketches.RANK_ERROR


def test_distinct_counts_unite_over_days(spark):
    rows = spark.range(0, 300_000, 1, 8).select((F.col("id") % 3).alias("k"), (F.col("id") % 30).alias("day"), (F.xxhash64("id") % 40_000).alias("u"))
    exact = {r.k: r.n for r in rows.groupBy("k").agg(F.count_distinct("u").alias("n")).collect()}
    for sets in (False, True):
        days = sketches.distinct_sketches(rows, ["k", "day"], "u", sets)
        found = sketches.estimate(sketches.unite(days, ["k"], sets), sets=sets).collect()
        assert len(found) == 3
        assert all(abs(r.n_distinct - exact[r.k]) <= sketches.DISTINCT_ERROR * exact[r.k] for r in found)


def test_few_values_intersect_exactly(spark):
    rows = spark.range(3000).select(F.explode(F.expr("filter(array(1, 2, 3), d -> id % (d + 1) = 0)")).alias("day"), "id")
    days = sketches.distinct_sketches(rows, ["day"], "id", sets=True)
    both = sketches.intersect(days, [F.lit(1).alias("one")])
    assert sketches.estimate(both, sets=True).first().n_distinct == 250  # divisible by 2, 3 and 4
    either = sketches.unite(days, [F.lit(1).alias("one")], sets=True)
    assert sketches.estimate(either, sets=True).first().n_distinct == 2000


# --- grids -----------------------------------------------------------------------------


def grid_rows(df, *columns):
    return {((r["at"] - T0).total_seconds(), *(r[c] for c in columns)) for r in df.collect()}


def test_gauges_stand_for_the_lookback_and_leave_gaps(spark):
    samples = [("a", at(-20), 9), ("a", at(5), 1), ("a", at(60), 2), ("a", at(61), 3), ("a", at(1000), 4), ("b", at(119.5), 5), ("a", None, 6)]
    df = spark.createDataFrame(samples, "pod string, ts timestamp, v int")
    found = tm.gauge_on_grid(df, ["pod"], "v", "ts", 60, str(T0), str(at(900)))
    expected = {(0, "a", 9), (60, "a", 2)} | {(t, "a", 3) for t in (120, 180, 240, 300, 360)} | {(t, "b", 5) for t in (120, 180, 240, 300, 360)}
    assert grid_rows(found, "pod", "v") == expected | {(t, "b", 5) for t in (120, 180, 240, 300, 360)}
    assert tm.gauge_on_grid(df.filter("false"), ["pod"], "v", "ts", 60, str(T0), str(at(900))).count() == 0


def test_rates_on_a_grid(spark):
    samples = [(s, float(v)) for s, v in ((10, 1), (50, 5), (120, 9), (121, 2), (130, 4), (600, 10))]
    df = spark.createDataFrame([("a", at(s), v) for s, v in samples], "s string, ts timestamp, v double")
    found = tm.rate_on_grid(df, ["s"], "ts", "v", 60, 120, str(T0), str(at(660)))
    assert grid_rows(found, "increase") == {(60, 4.0), (120, 8.0), (180, 8.0), (240, 4.0), (600, 6.0), (660, 6.0)}
    assert {round(r.rate * 120, 9) for r in found.collect()} == {4.0, 8.0, 6.0}
    with pytest.raises(ValueError):
        tm.rate_on_grid(df, ["s"], "ts", "v", 60, 90, str(T0), str(at(660)))


# --- two streams ---------------------------------------------------------------------------


def test_streams_join_like_tables_and_forget(spark, tmp_path):
    schema = "k string, side string, n int, ts timestamp"
    draw = np.random.default_rng(2)
    rows = [(str(draw.integers(0, 4)), "lr"[draw.integers(0, 2)], i, at(int(draw.integers(0, 120)) + 60 * (i // 20))) for i in range(400)]
    rows.append((None, "l", 1000, at(10)))
    for i in range(0, 401, 67):
        spark.createDataFrame(rows[i : i + 67], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def sides(df):
        left = df.filter("side = 'l'").select("k", F.col("n").alias("l"), F.col("ts").alias("lt"))
        return left, df.filter("side = 'r'").select("k", F.col("n").alias("r"), F.col("ts").alias("rt"))

    def run():
        live = [stream.read_files(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, 1) for _ in range(2)]
        left, right = sides(live[0])[0], sides(live[1])[1]
        joined = joins.interval_join_stream(left, right, ["k"], "lt", "rt", -40, 25, "10 minutes", "10 minutes")
        query = stream.append_to_table(joined, f"{tmp_path}/out", f"{tmp_path}/ckpt")
        query.awaitTermination()
        return query.lastProgress["stateOperators"][0]["numRowsTotal"]

    held = run()
    left, right = sides(spark.createDataFrame(rows, schema))
    batch = asof.interval_join(left, right, ["k"], "lt", "rt", -40, 25).select("k", "l", "lt", "r", "rt")
    found = spark.read.parquet(f"{tmp_path}/out").select("k", "l", "lt", "r", "rt")
    assert sorted(map(str, found.collect())) == sorted(map(str, batch.collect()))
    for side in "lr":
        spark.createDataFrame([("z", side, 1, at(100_000))], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert run() < held / 10
