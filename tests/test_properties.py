"""Properties that must hold for any input."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cartlore.operators import asof, ranking
from cartlore.operators import telemetry as tm

T0 = datetime(2024, 1, 1)
FEW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
KEYS = st.sampled_from(["a", "b", None])
HOURS = st.integers(0, 30)


@FEW
@given(spine=st.lists(st.tuples(KEYS, HOURS), min_size=1, max_size=25), feats=st.lists(st.tuples(KEYS, HOURS), max_size=25))
def test_asof_keeps_the_spine_and_never_sees_the_future(spark, spine, feats):
    s = spark.createDataFrame([(k, T0 + timedelta(hours=h), i) for i, (k, h) in enumerate(spine)], "k string, at timestamp, row int")
    f = spark.createDataFrame([(k, T0 + timedelta(hours=h), h) for k, h in feats], "k string, ts timestamp, h int")
    view = asof.AsOfView("f", f, ("k",), "ts", {"h": "h"})
    for hot_rows in (10**9, 3):
        rows = sorted(asof.asof_join(s, [view], ts="at", hot_rows=hot_rows, time_buckets=3).collect(), key=lambda r: r.row)
        assert [r.row for r in rows] == list(range(len(spine)))
        for row, (key, hour) in zip(rows, spine):
            known = [h for k, h in feats if key is not None and k == key and h <= hour]
            assert row.h == (max(known) if known else None)


@FEW
@given(numbers=st.lists(st.floats(0, 60, allow_nan=False), min_size=1, max_size=60), q=st.sampled_from([0.1, 0.5, 0.95, 0.99]))
def test_quantile_lies_in_the_bucket_of_the_true_one(spark, numbers, q):
    bounds = [10.0, 25.0, 50.0]
    df = spark.createDataFrame([("s", float(x)) for x in numbers], "service string, v double")
    found = tm.histogram_quantile(tm.histogram(df, "v", bounds, ["service"]), q, ["service"]).first().value
    true = np.sort(numbers)[max(int(np.ceil(q * len(numbers))) - 1, 0)]
    edges = [0.0, *bounds]
    upper = next((b for b in bounds if true <= b), None)
    if upper is None:
        assert found == 50.0
    else:
        lower = max(e for e in edges if e < upper)
        assert lower <= found <= upper


@FEW
@given(rows=st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 5)), min_size=1, max_size=60), n=st.sampled_from([1, 4, 1001]))
def test_cut_returns_the_smallest_of_each_group(spark, rows, n):
    df = spark.createDataFrame(rows, "k string, v int")
    found = {}
    for r in ranking.top_n(df, ["k"], ["v"], n).collect():
        found.setdefault(r.k, []).append(r.v)
    assert {k: sorted(v) for k, v in found.items()} == {
        key: sorted(v for k, v in rows if k == key)[:n] for key in {k for k, _ in rows}
    }
