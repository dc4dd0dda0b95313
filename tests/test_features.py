"""Golden rows and edge rows of the feature views."""

from __future__ import annotations

import pytest
from conftest import REVIEW_ROWS, REVIEW_SCHEMA

from cartlore.functions import cleaning
from cartlore.functions import text as t
from cartlore.operators import features as ops
from cartlore.plans import views
from cartlore.sources import reviews as src
from pyspark.sql import functions as F


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_user_features_golden(golden_reviews):
    rows = by(ops.user_features(golden_reviews), "user_id")
    a, b = rows["AE22NQ"], rows["BKRMX7"]
    assert a.user_avg_rating == pytest.approx(3.67, abs=0.005)
    assert (a.user_review_count, a.user_unique_items, a.user_category_count, a.user_tenure_days) == (3, 3, 2, 59)
    assert a.user_avg_review_length == pytest.approx(20.7, abs=0.05)
    assert a.user_primary_category == b.user_primary_category == "Electronics"
    assert (b.user_avg_rating, b.user_review_count, b.user_unique_items) == (4.0, 2, 2)
    assert (b.user_avg_review_length, b.user_category_count, b.user_tenure_days) == (19.0, 1, 31)


def test_item_features_golden(spark):
    rows = [list(r) for r in REVIEW_ROWS]
    rows[3][4] = "It's okay"
    reviews = src.to_review_events(spark.createDataFrame([tuple(r) for r in rows], REVIEW_SCHEMA))
    found = by(ops.item_features(reviews), "item_id")
    first, second, single = found["B07XJ8C8F5"], found["B09K3M2P1Q"], found["B08N5WRWNW"]
    assert first.item_avg_rating == 4.0
    assert first.item_rating_stddev == pytest.approx(1.41, abs=0.005)
    assert (first.item_review_count, first.item_total_helpful_votes, first.item_avg_review_length) == (2, 3, 16.5)
    assert (second.item_avg_rating, second.item_total_helpful_votes, second.item_avg_review_length) == (4.5, 8, 21.0)
    assert second.item_rating_stddev == pytest.approx(0.71, abs=0.005)
    assert single.item_rating_stddev is None


def test_interactions_golden(golden_reviews):
    rows = ops.interactions(golden_reviews).orderBy("user_id", "event_timestamp").collect()
    assert [r.label for r in rows] == [1.0, 1.0, 0.0, 0.0, 1.0]
    assert [r.event_timestamp.strftime("%Y-%m-%d") for r in rows] == [
        "2021-01-01", "2021-02-01", "2021-03-01", "2021-01-19", "2021-02-19",
    ]


def edge_reviews(spark):
    rows = [
        ("u1", "i1", 0.0, None, "ignored", 1, 0, True, "Books"),
        ("u1", "i1", 4.0, None, None, 2, 86_400_000, True, "Electronics"),
        ("u1", "i2", None, None, "no rating", 5, 172_800_000, True, "Books"),
        ("u1", "i2", 2.0, None, "four", 0, 86_400_000 * 2 - 1, True, "Books"),
        ("u2", "i1", 1.0, None, None, None, 5, True, None),
    ]
    return src.to_review_events(spark.createDataFrame(rows, REVIEW_SCHEMA))


def test_edge_rows(spark):
    users = by(ops.user_features(edge_reviews(spark)), "user_id")
    u1, u2 = users["u1"], users["u2"]
    assert (u1.user_review_count, u1.user_avg_rating, u1.user_avg_review_length) == (2, 3.0, 4.0)
    assert u1.user_primary_category == "Books"  # tie goes to the smaller name
    assert u1.user_tenure_days == 0  # not quite a day
    assert (u2.user_avg_review_length, u2.user_category_count, u2.user_primary_category) == (None, 0, None)
    assert (u2.user_review_count, u2.user_unique_items) == (1, 1)


def test_unrated_reviews_stay_in_interactions(spark):
    labels = ops.interactions(edge_reviews(spark)).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in labels} == {1.0: 1, 0.0: 4}


def test_features_do_not_depend_on_partitioning(spark, golden_reviews):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    first = sorted(map(tuple, ops.user_features(golden_reviews).collect()))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        assert sorted(map(tuple, ops.user_features(golden_reviews).collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_metadata_keeps_one_row_per_item(spark):
    rows = [
        ("p1", "Echo", "Electronics", 49.99, "Brand", None),
        ("p1", None, "Electronics", 1.0, "Brand", None),
        ("p1", "Aaa", "Electronics", None, "Brand", None),
        ("p2", None, None, None, None, None),
    ]
    schema = "parent_asin string, title string, main_category string, price float, brand string, event_timestamp timestamp"
    found = by(ops.item_metadata(spark.createDataFrame(rows, schema)), "item_id")
    assert len(found) == 2
    assert found["p1"].item_title == "Echo"  # a price beats a smaller title


def test_cleaning_rules(spark):
    rows = [("None", "None", "12.5", "None"), ("", "x", "None", "Acme"), (None, None, None, None), ("Books", "", "abc", "")]
    df = spark.createDataFrame(rows, "main_category string, title string, price string, store string")
    cleaned = src.clean_catalog(df.withColumn("parent_asin", F.lit("p")), "Electronics").collect()
    assert [r.main_category for r in cleaned] == ["Electronics", "Electronics", None, "Books"]
    assert [r.price for r in cleaned] == [12.5, None, None, None]
    assert [r.brand for r in cleaned] == [None, "Acme", None, ""]


def test_display_fields(spark):
    schema = (
        "item_id string, item_title string, item_brand string, item_category string, item_avg_rating double, "
        "item_review_count long, item_price float, item_rating_stddev double, item_total_helpful_votes long"
    )
    df = spark.createDataFrame([("a", None, None, None, None, None, 0.0, None, 0), ("b", "T", "B", "C", 4.5, 3, 19.99, 0.1, 7)], schema)
    a, b = ops.display_fields(df).orderBy("item_id").collect()
    assert (a.title, a.brand, a.category, a.price, a.helpful_votes, a.has_metadata) == ("", "", "", None, None, False)
    assert (b.price, b.helpful_votes, b.has_metadata) == (19.99, 7, True)


def test_embedding_rows_length_rule(spark):
    """The blank of a missing title counts towards the shortest length."""
    rows = [("u", "i", 5.0, None, "x" * 18, 0, 1), ("u", "i", 5.0, None, "x" * 19, 0, 2), ("u", "i", 5.0, "t" * 600, "y", 0, 3)]
    df = spark.createDataFrame(rows, "user_id string, parent_asin string, rating double, title string, text string, helpful_vote int, timestamp long")
    found = ops.embedding_rows(df).collect()
    assert sorted(len(r.embed_text) for r in found) == [20, 511]
    vectors = views.review_embeddings(df).collect()
    for row in vectors:
        assert len(row.embedding) == 384
        assert sum(x * x for x in row.embedding) == pytest.approx(1.0, abs=1e-5)


def test_review_id_skips_missing_parts(spark):
    import hashlib

    df = spark.createDataFrame([("u", None, 5), ("u", "i", 5)], "u string, i string, ts long")
    found = [r[0] for r in df.select(t.review_id(F.col("u"), F.col("i"), F.col("ts"))).collect()]
    assert found == [hashlib.sha256(x).hexdigest() for x in (b"u_5", b"u_i_5")]


def test_epoch_ms_keeps_milliseconds(spark):
    df = spark.createDataFrame([(1609459200123,)], "ms long")
    assert df.select(cleaning.to_event_ts(F.col("ms"))).first()[0].microsecond == 123000


def test_schema_drift(spark):
    old = spark.createDataFrame([("u", "a", 5.0, "t", 1)], "user_id string, asin string, rating double, text string, timestamp long")
    fixed = src.normalize_reviews(old)
    assert {"parent_asin", "helpful_vote"} <= set(fixed.columns) and "asin" not in fixed.columns
    assert ops.item_features(fixed).first().item_total_helpful_votes == 0


def test_model_encoder_runs_per_worker(spark):
    import numpy as np

    from cartlore.functions.encoders import model_encoder

    def load():
        return lambda texts: np.array([[len(x), 1.0] for x in texts])

    df = spark.createDataFrame([("abc",), (None,)], "text string")
    rows = model_encoder(load)(df, "text", "v").collect()
    assert rows[0].v == pytest.approx([3 / 10**0.5, 1 / 10**0.5], abs=1e-6)
    assert rows[1].v == pytest.approx([0.0, 1.0])


@pytest.mark.parametrize("alias", ["r", "c", "p", "e", "f", "w"])
def test_an_alias_of_the_input_does_no_harm(golden_reviews, alias):
    plain = sorted(map(tuple, ops.user_features(golden_reviews).collect()))
    assert sorted(map(tuple, ops.user_features(golden_reviews.alias(alias)).collect())) == plain
