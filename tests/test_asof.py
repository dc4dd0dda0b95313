"""As-of and interval joins against brute force."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from cartlore.operators import asof

T0 = datetime(2024, 1, 1)
SPINE = "k string, at timestamp, row int"
FEATS = "k string, ts timestamp, v int, w string"


def make(spark, seed, n_spine=120, n_feats=150, hot_share=0.4):
    """Random rows with a hot key, equal times, NULL keys and NULL values."""
    rng = random.Random(seed)

    def key():
        return "hot" if rng.random() < hot_share else rng.choice(["a", "b", "c", None])

    def time():
        return T0 + timedelta(hours=rng.randrange(0, 60))

    spine = [(key(), time(), i) for i in range(n_spine)]
    feats = [(key(), time(), rng.choice([None, 1, 2, 3]), rng.choice(["x", "y"])) for _ in range(n_feats)]
    return spine, feats, spark.createDataFrame(spine, SPINE), spark.createDataFrame(feats, FEATS)


def brute(spine, feats, ttl=None):
    out = []
    for k, at, row in spine:
        seen = [f for f in feats if k is not None and f[0] == k and f[1] <= at]
        # of equal times the one with the largest values, NULL smallest
        best = max(seen, key=lambda f: (f[1], f[2] is not None, f[2] or 0, f[3]), default=None)
        if best and ttl is not None and best[1] < at - timedelta(seconds=ttl):
            best = None
        out.append((k, at, row, best[2] if best else None, best[3] if best else None))
    return sorted(out, key=lambda r: r[2])


def view(df, ttl=None):
    return asof.AsOfView("f", df, ("k",), "ts", {"v": "v", "w": "w2"}, ttl)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[2])


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("ttl", [None, 5 * 3600])
def test_plain_path(spark, seed, ttl):
    spine, feats, s, f = make(spark, seed)
    expected = brute(spine, feats, ttl)
    assert collected(asof.asof_join(s, [view(f, ttl)], ts="at")) == expected
    assert collected(asof.asof_join(s, [view(f, ttl)], ts="at", hot_rows=None)) == expected


@pytest.mark.parametrize("seed", [3, 4])
@pytest.mark.parametrize("ttl", [None, 5 * 3600])
@pytest.mark.parametrize("buckets", [2, 9])
def test_hot_path(spark, seed, ttl, buckets):
    spine, feats, s, f = make(spark, seed)
    assert len(asof._hot_keys(s, [[view(f)]], 60)[0]) == 1
    joined = asof.asof_join(s, [view(f, ttl)], ts="at", hot_rows=60, time_buckets=buckets)
    assert joined.columns[:3] == ["k", "at", "row"]
    assert collected(joined) == brute(spine, feats, ttl)


def test_every_spine_row_at_one_instant(spark):
    """A training spine is stamped with one time; a hot key's rows then differ in nothing but the rest."""
    _, feats, _, f = make(spark, 5)
    now = T0 + timedelta(days=9)
    spine = [("hot", now, i) for i in range(200)]
    joined = asof.asof_join(spark.createDataFrame(spine, SPINE), [view(f)], ts="at", hot_rows=50, time_buckets=4)
    assert collected(joined) == brute(spine, feats)


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_rows_without_time_match_nothing(spark, hot_rows):
    s = spark.createDataFrame([("a", None, 1), ("a", T0, 2)], SPINE)
    f = spark.createDataFrame([("a", None, 5, "x"), ("a", T0 - timedelta(1), 6, "y"), ("a", T0 - timedelta(2), 7, "z")], FEATS)
    assert [r[3] for r in collected(asof.asof_join(s, [view(f)], ts="at", hot_rows=hot_rows, time_buckets=3))] == [None, 6]


def test_two_views_of_different_keys(spark):
    spine = [("u1", "i1", T0 + timedelta(days=2)), ("u1", "i2", T0), ("u9", "i1", T0 + timedelta(days=5))]
    s = spark.createDataFrame(spine, "user_id string, item_id string, at timestamp")
    users = spark.createDataFrame([("u1", T0, 1), ("u1", T0 + timedelta(days=1), 2), ("u1", T0 + timedelta(days=3), 3)], "user_id string, ts timestamp, a int")
    items = spark.createDataFrame([("i1", T0 + timedelta(days=2), 10), ("i2", T0 + timedelta(seconds=1), 20)], "item_id string, ts timestamp, b int")
    views = [
        asof.AsOfView("u", users, ("user_id",), "ts", {"a": "a"}),
        asof.AsOfView("i", items, ("item_id",), "ts", {"b": "b"}),
    ]
    rows = {(r.user_id, r.item_id): (r.a, r.b) for r in asof.asof_join(s, views, ts="at").collect()}
    # equal time counts as known, later does not, unknown key gives NULL
    assert rows == {("u1", "i1"): (2, 10), ("u1", "i2"): (1, None), ("u9", "i1"): (None, 10)}


def test_views_of_one_entity_share_a_shuffle(spark):
    s = spark.createDataFrame([("a", T0, 1)], SPINE)
    f = spark.createDataFrame([("a", T0, 1, "x")], FEATS)
    views = [asof.AsOfView(n, f, ("k",), "ts", {"v": n}) for n in ("one", "two", "three")]
    joined = asof.asof_join(s, views, ts="at")
    plan = joined._sc._jvm.PythonSQLUtils.explainString(joined._jdf.queryExecution(), "simple")
    assert plan.count("Exchange hashpartitioning") == 1
    assert [(r.one, r.two, r.three) for r in joined.collect()] == [(1, 1, 1)]


def test_value_exactly_ttl_old_is_kept(spark):
    s = spark.createDataFrame([("a", T0 + timedelta(days=90), 1), ("a", T0 + timedelta(days=90, seconds=1), 2)], SPINE)
    f = spark.createDataFrame([("a", T0, 7, "x")], FEATS)
    rows = collected(asof.asof_join(s, [view(f, 90 * 86_400)], ts="at"))
    assert [r[3] for r in rows] == [7, None]


@pytest.mark.parametrize("seed", [6, 7])
def test_interval_join(spark, seed):
    spine, feats, s, f = make(spark, seed)
    lower, upper = -3 * 3600, 3600
    joined = asof.interval_join(s, f, ["k"], "at", "ts", lower, upper)
    expected = sorted(
        (k, at, row, ts, str(v), w)
        for k, at, row in spine
        for fk, ts, v, w in feats
        if k is not None and k == fk and timedelta(seconds=lower) <= ts - at <= timedelta(seconds=upper)
    )
    assert sorted((r.k, r["at"], r.row, r.ts, str(r.v), r.w) for r in joined.collect()) == expected
