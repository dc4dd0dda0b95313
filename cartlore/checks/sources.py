"""Scans, sinks and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning
from ..functions import text as t
from ..operators import features as ops
from ..operators import lookups, ranking
from ..plans import store, views
from ..sources import reviews as src
from . import frames as fr
from .base import Checks

checks = Checks()
load, sql = fr.load, fr.sql

# time bounds of the window queries, inside the range of the given event table
WINDOW = ("2024-01-08 00:00:00", "2024-01-15 00:00:00")


@checks.add(
    "scan_reviews",
    sql("reviews", "SELECT row_key, user_id, parent_asin, rating, ts_ms AS event_ms, category FROM reviews"),
)
def scan_reviews(spark, sf):
    df = fr.reviews(spark, sf)
    return df.select("row_key", "user_id", "parent_asin", "rating", fr.epoch_ms("event_timestamp", "event_ms"), "category")


@checks.add(
    "catalog_union",
    sql(
        "catalog",
        """SELECT parent_asin, title, CASE WHEN main_category IN ('None', '') THEN d ELSE main_category END AS main_category,
                  TRY_CAST(price AS FLOAT) AS price, CASE WHEN store <> 'None' THEN store END AS brand, 1577836800000 AS event_ms
           FROM catalog, (VALUES ('Electronics'), ('Books'), ('Home & Kitchen')) v(d)""",
    ),
)
def catalog_union(spark, sf):
    raw = load(spark, sf, "catalog")
    merged = src.catalog_union([(raw, "Electronics"), (raw, "Books"), (raw, "Home & Kitchen")])
    return merged.withColumn("event_ms", fr.epoch_ms("event_timestamp")).drop("event_timestamp")


@checks.add(
    "sample_cap",
    sql(
        "reviews",
        """SELECT row_key, category, ts_ms FROM (
             SELECT row_key, category, ts_ms, row_number() OVER (PARTITION BY category ORDER BY ts_ms, row_key) AS rn
             FROM reviews) WHERE rn <= 3000""",
    ),
)
def sample_cap(spark, sf):
    rows = fr.reviews(spark, sf).select("row_key", "category", F.col("timestamp").alias("ts_ms"))
    return ranking.cap_per_group(rows, "category", 3000, ["ts_ms", "row_key"])


@checks.add(
    "stringify_objects",
    sql(
        "catalog",
        """SELECT coalesce(parent_asin, 'None') AS parent_asin, coalesce(title, 'None') AS title,
                  coalesce(main_category, 'None') AS main_category, coalesce(price, 'None') AS price,
                  coalesce(store, 'None') AS store, copy_no FROM catalog""",
    ),
)
def stringify_objects(spark, sf):
    return src.stringify(load(spark, sf, "catalog"))


@checks.add(
    "stringify_nested",
    """SELECT conv_id, turn, CAST(to_json([role, text]) AS VARCHAR) AS pair, CAST(to_json({'role': role, 'turn': turn}) AS VARCHAR) AS whole FROM conversations""",
)
def stringify_nested(spark, sf):
    """Arrays and structs become JSON."""
    rows = load(spark, sf, "conversations")
    nested = rows.select("conv_id", "turn", F.array("role", "text").alias("pair"), F.struct("role", "turn").alias("whole"))
    return src.stringify(nested)


@checks.add(
    "pruned_capped_scan",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5000",
)
def pruned_capped_scan(spark, sf):
    return src.scan_pruned(load(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"], 5000, ["o_orderkey"])


@checks.add(
    "online_upsert",
    sql(
        "user_daily",
        """SELECT user_id, epoch_ms(event_timestamp) AS event_ms, day_reviews, day_avg_qty FROM (
             SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_timestamp DESC) AS rn FROM user_daily)
           WHERE rn = 1""",
    ),
)
def online_upsert(spark, sf):
    """Two batches, cut at an instant, upserted one after the other."""
    daily = load(spark, sf, "user_daily")
    cut = "1996-01-01 00:00:00"
    first = store.upsert(None, views.window_filter(daily, None, cut), ["user_id"])
    second = store.upsert(first, views.window_filter(daily, cut, None), ["user_id"])
    return second.select("user_id", fr.epoch_ms("event_timestamp", "event_ms"), "day_reviews", "day_avg_qty")


# --- projections and predicates -------------------------------------------------


@checks.add("epoch_ms_to_ts", sql("reviews", "SELECT row_key, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d %H:%M:%S') AS event_time FROM reviews"))
def epoch_ms_to_ts(spark, sf):
    ts = cleaning.to_event_ts(F.col("timestamp"))
    return fr.reviews(spark, sf).select("row_key", F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("event_time"))


@checks.add("rating_filter", sql("reviews", "SELECT row_key, rating FROM reviews WHERE rating > 0"))
def rating_filter(spark, sf):
    return ops.valid_ratings(fr.reviews(spark, sf)).select("row_key", "rating")


@checks.add("binary_label", sql("reviews", "SELECT row_key, CAST(CASE WHEN rating >= 4 THEN 1 ELSE 0 END AS DOUBLE) AS label FROM reviews"))
def binary_label(spark, sf):
    return fr.reviews(spark, sf).select("row_key", cleaning.binary_label(F.col("rating")).alias("label"))


@checks.add(
    "interactions",
    sql(
        "reviews",
        """SELECT user_id, parent_asin AS item_id, CAST(CASE WHEN rating >= 4 THEN 1 ELSE 0 END AS DOUBLE) AS label,
                  ts_ms AS event_ms FROM reviews""",
    ),
)
def interactions(spark, sf):
    df = ops.interactions(fr.reviews(spark, sf))
    return df.select("user_id", "item_id", "label", fr.epoch_ms("event_timestamp", "event_ms"))


@checks.add(
    "sentinel_clean",
    sql(
        "catalog",
        """SELECT parent_asin, copy_no, CASE WHEN main_category IN ('None', '') THEN 'Home & Kitchen' ELSE main_category END AS category,
                  CASE WHEN store <> 'None' THEN store END AS brand FROM catalog""",
    ),
)
def sentinel_clean(spark, sf):
    return load(spark, sf, "catalog").select(
        "parent_asin",
        "copy_no",
        cleaning.category_or_default(F.col("main_category"), "Home & Kitchen").alias("category"),
        cleaning.missing_to_null(F.col("store")).alias("brand"),
    )


@checks.add("price_cast", sql("catalog", "SELECT parent_asin, copy_no, TRY_CAST(price AS FLOAT) AS price FROM catalog"))
def price_cast(spark, sf):
    return load(spark, sf, "catalog").select("parent_asin", "copy_no", cleaning.safe_float(F.col("price")).alias("price"))


@checks.add(
    "helpful_cast",
    sql(
        "reviews",
        """SELECT row_key, CASE helpful_vote % 5 WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE CAST(helpful_vote AS INTEGER) END AS votes,
                  helpful_vote IS NULL OR helpful_vote % 5 IN (1, 2) AS unreadable FROM reviews""",
    ),
)
def helpful_cast(spark, sf):
    """Votes as they come: numbers, numbers as text, with a word behind them, missing."""
    nth, text = F.col("helpful_vote") % 5, F.col("helpful_vote").cast("string")
    given = F.when(nth == 1, F.concat(text, F.lit(" votes"))).when(nth == 2, "None").otherwise(text)
    votes = cleaning.safe_int(given)
    return fr.reviews(spark, sf).select("row_key", votes.alias("votes"), votes.isNull().alias("unreadable"))


@checks.add(
    "project_features",
    sql("reviews", f"SELECT user_id, user_avg_rating, user_primary_category FROM ({fr.USER_FEATURES}) u"),
)
def project_features(spark, sf):
    wanted = lookups.resolve_refs(["user_features:user_avg_rating", "user_features:user_primary_category"])
    return ops.user_features(fr.reviews(spark, sf)).select("user_id", *wanted["user_features"])


@checks.add(
    "embed_text_filter",
    sql(
        "doc_reviews",
        """SELECT doc_key, CAST(length(e) AS INTEGER) AS n_chars FROM (
             SELECT doc_key, coalesce(title, '') || ' ' || coalesce(text, '') AS e FROM doc_reviews) WHERE length(e) >= 20""",
    ),
)
def embed_text_filter(spark, sf):
    whole = t.full_embed_text(F.col("title"), F.col("text"))
    df = fr.doc_reviews(spark, sf).select("doc_key", F.length(whole).alias("n_chars"))
    return df.filter(F.col("n_chars") >= t.EMBED_MIN_CHARS)


@checks.add(
    "materialize_window",
    f"SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '{WINDOW[0]}' AND ts < TIMESTAMP '{WINDOW[1]}'",
)
def materialize_window(spark, sf):
    return views.window_filter(load(spark, sf, "events"), *WINDOW, ts="ts").select("event_id", "user_id", "event_type")


@checks.add(
    "incremental_window",
    f"""SELECT event_id, user_id FROM events
        WHERE ts > (SELECT max(ts) FROM events WHERE ts < TIMESTAMP '{WINDOW[0]}') AND ts < TIMESTAMP '{WINDOW[1]}'""",
)
def incremental_window(spark, sf):
    """Rows since the newest row of the previous run."""
    events = load(spark, sf, "events")
    done = views.window_filter(events, None, WINDOW[0], ts="ts")
    mark = done.agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]
    return views.newer_than(events, mark, WINDOW[1], ts="ts").select("event_id", "user_id")


@checks.add(
    "stamp_event_time",
    sql("reviews", f"SELECT item_id, item_review_count, 1704067200000 AS event_ms FROM ({fr.ITEM_FEATURES}) f"),
)
def stamp_event_time(spark, sf):
    df = ops.stamp(ops.item_features(fr.reviews(spark, sf)), "2024-01-01 00:00:00")
    return df.select("item_id", "item_review_count", fr.epoch_ms("event_timestamp", "event_ms"))


DISPLAY = """coalesce(item_title, '') AS title, coalesce(item_brand, '') AS brand, coalesce(item_category, '') AS category,
    item_avg_rating AS avg_rating, item_review_count AS review_count,
    CASE WHEN item_price <> 0 THEN round(CAST(item_price AS DOUBLE), 2) END AS price, item_rating_stddev AS rating_stddev,
    nullif(item_total_helpful_votes, 0) AS helpful_votes, coalesce(item_title, '') <> '' AS has_metadata"""


@checks.add(
    "falsy_to_default",
    sql("reviews catalog", f"SELECT item_id, {DISPLAY} FROM ({fr.METADATA}) m LEFT JOIN ({fr.ITEM_FEATURES}) f USING (item_id)"),
)
def falsy_to_default(spark, sf):
    features = fr.item_features(spark, sf).drop("item_avg_review_length")
    return ops.display_fields(fr.metadata(spark, sf).join(features, "item_id", "left"))


# --- set operations --------------------------------------------------------------


@checks.add("union_all", "SELECT p_partkey AS k, p_name AS name FROM part UNION ALL SELECT s_suppkey, s_name FROM supplier")
def union_all(spark, sf):
    parts = load(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"))
    suppliers = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return src.union_all(parts, suppliers)


@checks.add(
    "union_distinct",
    sql("catalog", "SELECT main_category AS category FROM catalog UNION SELECT p_type FROM part"),
)
def union_distinct(spark, sf):
    first = load(spark, sf, "catalog").select(F.col("main_category").alias("category"))
    second = load(spark, sf, "part").select(F.col("p_type").alias("category"))
    return lookups.union_distinct(first, second)


@checks.add("set_difference", "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def set_difference(spark, sf):
    customers = load(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return lookups.difference(customers, load(spark, sf, "events").select(F.col("user_id").alias("k")), ["k"])


@checks.add(
    "dual_search_dedup",
    sql(
        "doc_reviews",
        """SELECT parent_asin, search, hit_rank, doc_key FROM (
             SELECT *, row_number() OVER (PARTITION BY parent_asin, substr(text, 1, 80) ORDER BY search, hit_rank) AS rn FROM (
               SELECT parent_asin, hit_rank, doc_key, text, 1 AS search FROM doc_reviews
               UNION ALL
               SELECT parent_asin, CAST(helpful_vote AS INTEGER) * 100000 + hit_rank, doc_key, text, 2 FROM doc_reviews)
             WHERE substr(text, 1, 80) <> '') WHERE rn = 1""".replace("SELECT parent_asin, search, hit_rank", "SELECT parent_asin, search, CAST(hit_rank AS BIGINT) AS hit_rank"),
    ),
)
def dual_search_dedup(spark, sf):
    hits = fr.doc_reviews(spark, sf).select("parent_asin", F.col("hit_rank").cast("long"), "doc_key", "text", "helpful_vote")
    first = hits.drop("helpful_vote")
    second = hits.withColumn("hit_rank", F.col("helpful_vote") * 100000 + F.col("hit_rank")).drop("helpful_vote")
    merged = lookups.dedup_union(first, second, ["parent_asin"], "text", "hit_rank", t.DEDUP_KEY_CHARS)
    return merged.select("parent_asin", "search", "hit_rank", "doc_key")
