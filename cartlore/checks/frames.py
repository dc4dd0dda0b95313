"""Inputs several checked queries share, in both forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures
from ..operators import features as ops
from ..session import counted, stored_in_turns, turns_for
from ..sources import reviews as src

load = fixtures.load
sql = fixtures.with_fixtures

DEFAULT = "Electronics"
MISSING_PRICE = "'None'"


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    return src.to_review_events(load(spark, sf, "reviews"))


def reviews_without_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The reviews where nobody asks for their texts.

    A review gets a row for each document of its id. Where the ids are found to be unique the optimizer is told so, and
    leaves the join out, as it can add neither rows nor columns.
    """
    ids = load(spark, sf, "documents").select("doc_id")
    n_rows, n_ids = ids.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if n_rows != n_ids:
        return reviews(spark, sf).drop("text")
    documents = ids.distinct().withColumn("text", F.lit(None).cast("string"))
    return src.to_review_events(load(spark, sf, "reviews", documents=documents)).drop("text")


def review_turns(spark: SparkSession, sf: str) -> int:
    return turns_for(counted(load(spark, sf, "lineitem")))  # of file footers only


def doc_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return src.to_review_events(load(spark, sf, "doc_reviews"))


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    return src.clean_catalog(load(spark, sf, "catalog"), DEFAULT)


def metadata(spark: SparkSession, sf: str) -> DataFrame:
    return ops.item_metadata(catalog(spark, sf))


def rated_rows(spark: SparkSession, sf: str) -> DataFrame:
    """What ``rated`` takes of the reviews, stored: it is read twice, as rows and for the categories, and behind it lie the joins that make reviews."""
    wanted = reviews_without_texts(spark, sf).select("row_key", "user_id", "parent_asin", "rating", "category")
    return stored_in_turns(wanted.filter, "parent_asin", review_turns(spark, sf), "rated")


def rated(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    """Review rows with their user's main source category, the input of the training preparation."""
    rows = rated_rows(spark, sf) if rows is None else rows
    return rows.select("row_key", "user_id", F.col("parent_asin").alias("item_id"), "rating").join(
        ops.primary_category(rows), "user_id", "left"
    )


CLEAN = """
    SELECT parent_asin, title,
           CASE WHEN main_category IN ('None', '') THEN 'Electronics' ELSE main_category END AS main_category,
           TRY_CAST(price AS FLOAT) AS price, CASE WHEN store <> 'None' THEN store END AS brand
    FROM catalog"""

METADATA = f"""
    SELECT item_id, item_title, item_brand, item_category, item_price FROM (
      SELECT parent_asin AS item_id, title AS item_title, brand AS item_brand, main_category AS item_category,
             price AS item_price,
             row_number() OVER (PARTITION BY parent_asin ORDER BY title IS NULL, price IS NULL, title NULLS FIRST,
                                brand NULLS FIRST, main_category NULLS FIRST, price NULLS FIRST) AS rn
      FROM ({CLEAN}) c) WHERE rn = 1"""

PRIMARY = """
    SELECT user_id, category AS user_primary_category FROM (
      SELECT user_id, category, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, category) AS rn
      FROM reviews WHERE rating > 0 GROUP BY user_id, category) WHERE rn = 1"""

USER_FEATURES = f"""
    SELECT a.*, p.user_primary_category FROM (
      SELECT user_id, avg(rating) AS user_avg_rating, count(*) AS user_review_count,
             count(DISTINCT parent_asin) AS user_unique_items, avg(length(text)) AS user_avg_review_length,
             count(DISTINCT category) AS user_category_count,
             CAST(trunc((max(ts_ms) - min(ts_ms)) / 86400000.0) AS BIGINT) AS user_tenure_days
      FROM reviews WHERE rating > 0 GROUP BY user_id) a
    LEFT JOIN ({PRIMARY}) p USING (user_id)"""

ITEM_FEATURES = """
    SELECT parent_asin AS item_id, avg(rating) AS item_avg_rating, round(stddev_samp(rating), 6) AS item_rating_stddev,
           count(*) AS item_review_count, CAST(sum(helpful_vote) AS BIGINT) AS item_total_helpful_votes,
           avg(length(text)) AS item_avg_review_length
    FROM reviews WHERE rating > 0 GROUP BY parent_asin"""

RATED = f"""
    SELECT row_key, user_id, parent_asin AS item_id, rating, user_primary_category
    FROM reviews LEFT JOIN ({PRIMARY}) p USING (user_id)"""


def item_features(spark: SparkSession, sf: str) -> DataFrame:
    """Item features with the spread rounded, because engines add up squares in different order."""
    return ops.item_features(reviews(spark, sf)).withColumn("item_rating_stddev", F.round("item_rating_stddev", 6))


def epoch_ms(name: str, out: str | None = None):
    return F.unix_millis(F.col(name).cast("timestamp")).alias(out or f"{name}_ms")


SUPER = """CASE WHEN {c} IS NULL OR {c} = 'None' THEN NULL
    WHEN {c} IN ('Camera & Photo', 'Home Audio & Theater', 'Portable Audio & Accessories', 'GPS & Navigation', 'Car Electronics', 'Musical Instruments') THEN 'Photography & Audio'
    WHEN {c} IN ('Tools & Home Improvement', 'Industrial & Scientific', 'Sports & Outdoors', 'Automotive', 'Arts, Crafts & Sewing', 'Office Products') THEN 'DIY & Outdoors'
    WHEN {c} IN ('Computers', 'All Electronics', 'Cell Phones & Accessories', 'Electronics', 'Amazon Devices', 'Apple Products', 'Amazon Fire TV', 'AMAZON FASHION', 'Video Games', 'Software') THEN 'Tech & Computing'
    WHEN {c} IN ('Books', 'Buy a Kindle') THEN 'Books & Media' ELSE 'Home & Living' END"""

SOURCE_SUPER = """CASE {c} WHEN 'Electronics' THEN 'Tech & Computing' WHEN 'Books' THEN 'Books & Media' ELSE 'Home & Living' END"""

PREPARED = f"""
    filled AS (SELECT r.row_key, r.user_id, r.item_id, r.rating,
                      coalesce({SUPER.format(c='m.item_category')}, {SOURCE_SUPER.format(c='r.user_primary_category')}) AS item_category
               FROM ({RATED}) r LEFT JOIN ({METADATA}) m ON m.item_id = r.item_id),
    top AS (SELECT user_id, item_category AS user_primary_category FROM (
              SELECT user_id, item_category, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, item_category) AS rn
              FROM filled GROUP BY user_id, item_category) WHERE rn = 1),
    prepared AS (SELECT f.*, coalesce(t.user_primary_category, 'Home & Living') AS user_primary_category
                 FROM filled f LEFT JOIN top t USING (user_id))"""

ENCODED = """
    users AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS user_idx FROM (SELECT DISTINCT user_id FROM prepared)),
    items AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS item_idx FROM (SELECT DISTINCT item_id FROM prepared)),
    cats AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS idx FROM (
               SELECT item_category AS c FROM prepared UNION SELECT user_primary_category FROM prepared)),
    observed AS (SELECT row_key, user_idx, item_idx, uc.idx AS user_cat_idx, ic.idx AS item_cat_idx,
                        CAST(CASE WHEN rating >= 4 THEN 1 ELSE 0 END AS FLOAT) AS label
                 FROM prepared JOIN users USING (user_id) JOIN items USING (item_id)
                 JOIN cats uc ON uc.c = user_primary_category JOIN cats ic ON ic.c = item_category)"""
