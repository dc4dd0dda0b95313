"""Training preparation on small frames."""

from __future__ import annotations

import math

import pytest

from cartlore.operators import training
from pyspark.sql import functions as F

ROWS = [
    ("r1", "u1", "i1", 5.0, "Books"),
    ("r2", "u1", "i2", 1.0, "Books"),
    ("r3", "u1", "i3", 4.0, "Books"),
    ("r4", "u2", "i3", 3.0, None),
    ("r5", "u3", "i4", None, "Electronics"),
]
META = [("i1", "Books"), ("i2", "Computers"), ("i3", None), ("i4", "Unknown thing")]


@pytest.fixture(scope="module")
def frames(spark):
    rows = spark.createDataFrame(ROWS, "row_key string, user_id string, item_id string, rating double, user_primary_category string")
    return rows, spark.createDataFrame(META, "item_id string, item_category string")


def test_categories_are_mapped_and_filled(frames):
    prepared = {r.row_key: r for r in training.super_category_prep(*frames).collect()}
    assert {k: r.item_category for k, r in prepared.items()} == {
        "r1": "Books & Media",
        "r2": "Tech & Computing",
        "r3": "Books & Media",  # from the user's own category
        "r4": "Home & Living",  # nothing known
        "r5": "Home & Living",  # unknown name
    }
    assert prepared["r2"].user_primary_category == "Books & Media"
    assert training.fill_categories(*frames).filter("was_missing").count() == 2


def test_samples_and_negatives(frames):
    samples, vocabularies = training.training_samples(*frames, ratio=3)
    rows = samples.collect()
    assert len(rows) == 5 + 15
    observed = {r.row_key: r.label for r in rows[:0]} or {r.row_key: r.label for r in samples.filter("label = 1").collect()}
    assert set(observed) == {"r1", "r3"}
    assert vocabularies["user"].count() == 3 and vocabularies["item"].count() == 4
    assert {r.category: r.idx for r in vocabularies["category"].collect()} == {"Books & Media": 0, "Home & Living": 1, "Tech & Computing": 2}
    assert all(0 <= r.user_idx < 3 and 0 <= r.item_idx < 4 for r in rows)
    cats = {}
    for r in rows:
        cats.setdefault(r.user_idx, set()).add(r.user_cat_idx)
    assert all(len(c) == 1 for c in cats.values())  # negatives carry their user's category
    again, _ = training.training_samples(*frames, ratio=3)
    assert samples.exceptAll(again).count() == 0


def test_last_row_decides_an_items_category(spark):
    df = spark.createDataFrame([(0, 1, "a"), (0, 2, "c"), (0, 3, "b"), (1, 5, "a")], "item_idx long, item_cat_idx long, row_key string")
    found = {r.item_idx: r.item_cat_idx for r in training.entity_category(df, "item_idx", "item_cat_idx", "row_key").collect()}
    assert found == {0: 2, 1: 5}


def test_known_pairs_can_be_rejected(spark):
    drawn = spark.createDataFrame([(0, 0), (0, 1)], "user_idx long, item_idx long")
    known = spark.createDataFrame([(0, 1, 9)], "user_idx long, item_idx long, label int")
    assert [tuple(r) for r in training.reject_known(drawn, known).collect()] == [(0, 0)]


def test_staged_tables(frames, spark, tmp_path):
    samples, vocabularies = training.training_samples(*frames)
    training.stage_training(samples, vocabularies, str(tmp_path))
    counts = {r.table: r.n_rows for r in spark.read.parquet(f"{tmp_path}/counts").collect()}
    assert counts == {"samples": 15, "user_vocab": 3, "item_vocab": 4, "category_vocab": 3}
    assert spark.read.parquet(f"{tmp_path}/samples").count() == 15


def test_metrics(spark):
    df = spark.createDataFrame([(2.0, 1.0), (-800.0, 0.0), (0.0, 1.0), (1.0, 0.0)], "logit double, label double")
    assert training.accuracy(df).first()[0] == 0.5
    expected = (math.log1p(math.exp(-2)) + 0 + math.log(2) + (1 + math.log1p(math.exp(-1)))) / 4
    assert training.bce_loss(df).first()[0] == pytest.approx(expected)
    assert training.label_balance(df).first().positive_share == 0.5


def test_draws_are_close_to_uniform(spark):
    rows = spark.range(4000).select(F.col("id").cast("string").alias("row_key"))
    drawn = training.draw_pairs(rows, "row_key", 4, 5, 2, 42)
    counts = [r["count"] for r in drawn.groupBy("user_idx").count().collect()]
    assert len(counts) == 4 and all(abs(c - 2000) < 200 for c in counts)
