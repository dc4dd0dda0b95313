"""Cells that a stream adds to the stored ones, without a state of its own."""

from __future__ import annotations

import pytest

from cartlore.operators import features as ops
from cartlore.plans.store import FeatureStore
from cartlore.plans.views import standard_views
from cartlore.sources import keyed
from cartlore.sources import reviews as src
from cartlore.streaming import materialize as stream
from pyspark.sql import functions as F

SCHEMA = (
    "user_id string, parent_asin string, rating double, title string, text string, helpful_vote int, "
    "timestamp long, verified_purchase boolean, category string"
)
ROWS = [
    ("u1", "a", 5.0, None, "good", 0, 1_000, True, "Books"),
    ("u1", "b", 4.0, None, "späť", 0, 90_000_000_000, True, "Toys"),
    ("u1", "a", 2.0, None, None, 0, 2_000, True, "Toys"),
    ("u2", None, 3.0, None, "x", 0, 3_000, True, None),
    (None, "a", 3.0, None, "", 0, None, True, "Books"),
    ("u2", "c", 0.0, None, "unrated", 0, 4_000, True, "Books"),
    ("u1", "a", 5.0, None, "good", 0, 1_000, True, "Books"),
    ("u3", "a", 1.0, None, "bad", 0, 5_000, True, "Books"),
    ("u2", None, 5.0, None, "again", 0, 6_000, True, None),
]


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.fixture()
def reviews(spark):
    return src.to_review_events(spark.createDataFrame(ROWS, SCHEMA))


@pytest.fixture()
def store(spark, reviews, tmp_path):
    made = FeatureStore(spark, str(tmp_path / "store"))
    views = standard_views(lambda s: reviews, lambda s: None, as_of="2021-03-05 00:00:00")
    made.apply([v for v in views if v.name == "user_features"])
    return made


def test_cells_of_single_rows_add_up(spark, reviews):
    columns = sorted(ops.user_cells(reviews).columns)
    whole = ops.user_cells(reviews).select(columns)
    added = ops.merge_user_cells(ops.user_cell_rows(reviews)).select(columns)
    assert rows_of(added) == rows_of(whole) and added.dtypes == whole.dtypes
    halves = [ops.merge_user_cells(ops.user_cell_rows(reviews.filter(f"coalesce(timestamp, 0) % 2000 {sign} 0"))) for sign in ("=", "<>")]
    assert rows_of(ops.merge_user_cells(halves[0].unionByName(halves[1])).select(columns)) == rows_of(whole)


def test_the_stream_keeps_no_state(spark, store, tmp_path):
    raw = spark.createDataFrame(ROWS, SCHEMA)
    view = store.registry.get("user_features")
    for part in ("rating % 2 = 0", "rating % 2 <> 0"):
        raw.filter(part).write.mode("append").parquet(f"{tmp_path}/in")
        live = src.to_review_events(stream.read_files(spark, f"{tmp_path}/in", raw.schema))
        query = stream.stream_materialize(store, view, live, f"{tmp_path}/ckpt")
        query.awaitTermination()
        assert query.exception() is None
        assert [len(p["stateOperators"]) for p in map(dict, query.recentProgress) if p["numInputRows"]] == [0]
    assert rows_of(store.online("user_features")) == rows_of(view.compute(src.to_review_events(raw)))


def test_a_batch_given_again_counts_once(store, reviews):
    """Batches of one stream add up, also when each comes twice; another stream's cells replace those that it has as well."""
    view = store.registry.get("user_features")
    parts = [reviews.filter(f"coalesce(timestamp, 0) % 3000 = {r * 1000}") for r in range(3)]
    for nth, part in enumerate(parts):
        for _ in range(2):
            store.add_cells(view, ops.user_cells(part), "first", nth)
    whole = rows_of(view.compute(reviews))
    assert rows_of(store.online("user_features")) == whole
    of_u1 = reviews.filter("user_id = 'u1'")
    store.add_cells(view, ops.user_cells(of_u1), "second", 0)
    assert rows_of(store.online("user_features")) == whole
    store.add_cells(view, ops.user_cells(of_u1), "second", 1)
    counts = {r.user_id: r.user_review_count for r in store.online("user_features").collect()}
    assert counts == {None: 1, "u1": 8, "u2": 2, "u3": 1}


def test_cells_given_by_their_value(store, reviews):
    """They replace what was added, whole; a stream that goes on adds to them, one that starts replaces them."""
    view = store.registry.get("user_features")
    count = lambda: {r.user_id: r.user_review_count for r in store.online("user_features").collect()}
    for nth in (0, 1):
        store.add_cells(view, ops.user_cells(reviews), "run", nth)
    assert count() == {None: 2, "u1": 8, "u2": 4, "u3": 2}
    for _ in range(2):
        store.merge_cells(view, ops.user_cells(reviews.filter("user_id = 'u1'")))
        assert count() == {None: 2, "u1": 4, "u2": 4, "u3": 2}
    for _ in range(2):
        store.add_cells(view, ops.user_cells(reviews), "run", 2)
        assert count() == {None: 3, "u1": 8, "u2": 6, "u3": 3}
    store.merge_cells(view, ops.user_cells(reviews))
    store.add_cells(view, ops.user_cells(reviews), "new", 0)
    assert rows_of(store.online("user_features")) == rows_of(view.compute(reviews))


def test_first_update_is_written_once(spark, tmp_path, monkeypatch):
    """What comes from no folder needs no copy before it is written."""
    made = []
    monkeypatch.setattr(keyed, "stored", lambda df, name, f=keyed.stored: made.append(name) or f(df, name))
    table = keyed.KeyedTable(spark, f"{tmp_path}/t", ("k",), 4)
    batch = spark.range(10).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    for copies, whole in ((["update"], 10), (["update", "merged"], 20)):
        made.clear()
        assert table.update(batch, lambda old, new: old.unionByName(new)) == [0, 1, 2, 3]
        assert made == copies and table.read(batch.schema).count() == whole
