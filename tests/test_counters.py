"""The counter stream against the batch form, batch by batch."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from cartlore.operators import telemetry as tm
from cartlore.streaming import counters
from cartlore.streaming import materialize as stream

T0 = datetime(2024, 1, 1)
SCHEMA = "series string, shard int, ts timestamp, value double"


class Feed:
    """Samples go into a folder, file by file; each run of the stream takes in what is new."""

    def __init__(self, spark, path, late, **options):
        self.spark, self.path, self.late, self.options = spark, str(path), late, options
        self.given = []

    def put(self, *samples):
        rows = [(s, 0, None if t is None else T0 + timedelta(seconds=t), v) for s, t, v in samples]
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/in")
        self.given += rows

    def run(self, files=1):
        live = stream.read_files(self.spark, f"{self.path}/in", self.spark.createDataFrame([], SCHEMA).schema, files)
        grown = counters.counter_increase_stream(live, ["series", "shard"], "ts", "value", 60, self.late, **self.options)
        query = stream.append_to_table(grown, f"{self.path}/out", f"{self.path}/ckpt")
        query.awaitTermination()
        return query

    def found(self):
        rows = self.spark.read.schema("series string, shard int, start timestamp, increase double, per_second double").parquet(f"{self.path}/out")
        return {(r.series, (r.start - T0).total_seconds()): r.increase for r in rows.collect()}


def batch(spark, rows):
    found = tm.counter_increase(spark.createDataFrame(rows, SCHEMA), ["series", "shard"], "ts", "value", "1 minute", 60)
    return {(r.series, (r.start - T0).total_seconds()): r.increase for r in found.collect()}


def test_restarts_inside_and_across_ranges(spark, tmp_path):
    feed = Feed(spark, tmp_path, "30 seconds")
    feed.put(("a", 0, 10.0), ("a", 59, 18.0), ("a", 30, 15.0), ("b", 10, 5.0), ("a", 58, 2.0))
    feed.put(("a", 60, 20.0), ("a", 90, 3.0), ("b", 100, 2.0))
    feed.put(("a", 200, 4.0), ("b", 230, 9.0), ("a", 210, 1.0))
    feed.run()
    feed.put(("a", 800, 11.0), ("c", 900, 1.0))
    feed.run()
    closed = {k: v for k, v in batch(spark, feed.given).items() if k[1] + 60 <= 870}
    assert feed.found() == closed
    assert closed[("a", 0.0)] == 5 + 2 + 16 and closed[("a", 60.0)] == 2 + 3 and closed[("a", 780.0)] == 10


def test_order_within_the_watermark_does_not_count(spark, tmp_path):
    draw = random.Random(4)
    samples = [(s, t, float(draw.choice((t % 97, t, 1)))) for s in "ab" for t in range(0, 1500, 7)]
    samples.sort(key=lambda x: x[1] + draw.uniform(0, 110))
    feed = Feed(spark, tmp_path, "2 minutes")
    for i in range(0, len(samples), 80):
        feed.put(*samples[i : i + 80])
    feed.put(("z", 5000, 1.0))
    feed.run()
    assert feed.found() == {k: v for k, v in batch(spark, feed.given).items() if k[0] != "z"}


def test_late_samples_and_samples_without_value_are_dropped(spark, tmp_path):
    feed = Feed(spark, tmp_path, "30 seconds")
    feed.put(("a", 0, 1.0), ("a", 10, 4.0), ("a", 20, None), ("a", None, 7.0))
    feed.put(("a", 100, 6.0))
    feed.run()
    good = [r for r in feed.given if r[2] is not None and r[3] is not None]
    feed.put(("a", 15, 1000.0), ("b", 15, 1000.0))  # behind the watermark
    feed.put(("a", 300, 6.5))
    feed.run()
    good += [r for r in feed.given if r[2] == T0 + timedelta(seconds=300)]
    assert feed.found() == {k: v for k, v in batch(spark, good).items() if k[1] < 240}


def test_a_silent_series_is_closed_and_its_state_does_not_grow(spark, tmp_path):
    feed = Feed(spark, tmp_path, "30 seconds")
    feed.put(("a", 0, 1.0), ("a", 10, 4.0))
    for t in range(300, 3000, 300):
        feed.put(("b", t, float(t)))
    query = feed.run()
    assert feed.found()[("a", 0.0)] == 3.0
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 2


@pytest.mark.parametrize(("forget", "growth"), [(None, 6.0), (600, 0.0)])
def test_forgetting(spark, tmp_path, forget, growth):
    feed = Feed(spark, tmp_path, "30 seconds", forget=forget)
    feed.put(("a", 0, 1.0), ("a", 10, 4.0))
    for t in range(300, 3000, 300):
        feed.put(("b", t, float(t)))
    feed.put(("a", 3000, 10.0))
    feed.put(("b", 4000, 4000.0))
    feed.run()
    assert feed.found()[("a", 3000.0)] == growth
