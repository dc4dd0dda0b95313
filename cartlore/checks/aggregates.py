"""Aggregations, windows, ranking, indexing and training preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import categories, cleaning
from ..operators import assembly, indexing, lookups, ranking, recommend, training
from ..operators import features as ops
from ..plans import store
from ..session import drop_stored, scratch_path, stored, stored_in_turns, sweep
from ..sources import reviews as src
from . import frames as fr
from .base import Checks

checks = Checks()
load, sql = fr.load, fr.sql


@checks.add("user_features", sql("reviews", fr.USER_FEATURES))
def user_features(spark, sf):
    return ops.user_features(fr.reviews(spark, sf))


@checks.add("item_features", sql("reviews", fr.ITEM_FEATURES))
def item_features(spark, sf):
    return fr.item_features(spark, sf)


@checks.add("user_category_counts", sql("reviews", "SELECT user_id, category, count(*) AS cat_count FROM reviews GROUP BY ALL"))
def user_category_counts(spark, sf):
    return ops.user_category_counts(fr.reviews(spark, sf))


@checks.add(
    "count_distinct",
    sql(
        "reviews",
        """SELECT user_id, count(DISTINCT parent_asin) AS n_parent_asin, count(DISTINCT category) AS n_category
           FROM reviews GROUP BY user_id""",
    ),
)
def count_distinct(spark, sf):
    return ops.distinct_counts(fr.reviews(spark, sf), "user_id", ["parent_asin", "category"])


@checks.add(
    "tenure_days",
    sql("reviews", "SELECT user_id, CAST(trunc((max(ts_ms) - min(ts_ms)) / 86400000.0) AS BIGINT) AS days FROM reviews GROUP BY user_id"),
)
def tenure_days(spark, sf):
    days = cleaning.tenure_days(F.min("timestamp"), F.max("timestamp")).alias("days")
    return fr.reviews(spark, sf).groupBy("user_id").agg(days)


@checks.add("item_metadata", sql("catalog", fr.METADATA))
def item_metadata(spark, sf):
    return fr.metadata(spark, sf)


@checks.add(
    "dedup_keys",
    sql(
        "catalog",
        "SELECT parent_asin, title, copy_no FROM (SELECT *, row_number() OVER (PARTITION BY parent_asin ORDER BY copy_no DESC) AS rn FROM catalog) WHERE rn = 1",
    ),
)
def dedup_keys(spark, sf):
    raw = load(spark, sf, "catalog").select("parent_asin", "title", "copy_no")
    return ranking.first_per_key(raw, ["parent_asin"], [F.col("copy_no").desc()])


@checks.add(
    "top_category_per_user",
    sql(
        "reviews catalog",
        f", {fr.PREPARED} SELECT user_id, user_primary_category AS top_category FROM top",
    ),
)
def top_category_per_user(spark, sf):
    return ops.top_category(training.fill_categories(fr.rated(spark, sf), fr.metadata(spark, sf)), "item_category")


@checks.add(
    "distinct_vocab",
    sql(
        "reviews catalog",
        f""", {fr.PREPARED}, names AS (SELECT item_category AS category FROM prepared UNION SELECT user_primary_category FROM prepared)
            SELECT category, row_number() OVER (ORDER BY category) - 1 AS idx FROM names""",
    ),
)
def distinct_vocab(spark, sf):
    filled = training.filled_rows(fr.rated(spark, sf), fr.metadata(spark, sf))
    return training.category_vocab(filled, training.user_top_category(filled))


@checks.add(
    "row_counts",
    sql(
        "reviews catalog",
        """SELECT 'reviews' AS table_name, count(*) AS n_rows FROM reviews UNION ALL SELECT 'catalog', count(*) FROM catalog
           UNION ALL SELECT 'users', count(DISTINCT user_id) FROM reviews""",
    ),
)
def row_counts(spark, sf):
    rows = fr.reviews(spark, sf)
    tables = {"reviews": rows, "catalog": load(spark, sf, "catalog"), "users": rows.select("user_id").distinct()}
    counted = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows")) for name, df in tables.items()]
    return src.union_all(*counted)


@checks.add(
    "label_balance",
    sql("reviews", "SELECT count(*) AS n_rows, avg(CASE WHEN rating >= 4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS positive_share FROM reviews"),
)
def label_balance(spark, sf):
    return training.label_balance(ops.interactions(fr.reviews(spark, sf)))


META_COLUMNS = ["item_title", "item_brand", "item_category", "item_price"]


@checks.add(
    "feature_coverage",
    sql(
        "catalog",
        f", m AS ({fr.METADATA}) "
        + " UNION ALL ".join(
            f"SELECT '{c}' AS feature, count(*) AS n_rows, count({c}) AS n_filled, count({c}) / count(*) AS share FROM m"
            for c in META_COLUMNS
        ),
    ),
)
def feature_coverage(spark, sf):
    return lookups.coverage(fr.metadata(spark, sf), META_COLUMNS)


@checks.add(
    "store_parity",
    sql(
        "user_daily",
        """, latest AS (SELECT user_id, event_timestamp, day_reviews FROM user_daily
                        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_timestamp DESC) = 1),
            stale AS (SELECT user_id, event_timestamp, day_reviews FROM user_daily WHERE event_timestamp < TIMESTAMP '2001-01-01'
                      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_timestamp DESC) = 1)
           SELECT user_id, epoch_ms(event_timestamp) AS event_ms, day_reviews, CAST(sum(s) AS BIGINT) AS surplus
           FROM (SELECT *, 1 AS s FROM stale UNION ALL SELECT *, -1 FROM latest) GROUP BY ALL HAVING sum(s) <> 0""",
    ),
)
def store_parity(spark, sf):
    """An online snapshot that missed the newest rows, against the offline rows."""
    daily = load(spark, sf, "user_daily").select("user_id", "event_timestamp", "day_reviews")
    offline = store.latest_rows(daily, ["user_id"])
    stale = store.latest_rows(daily.filter(F.col("event_timestamp") < F.lit("2001-01-01").cast("timestamp")), ["user_id"])
    found = lookups.store_parity(stale, offline)
    return found.select("user_id", fr.epoch_ms("event_timestamp", "event_ms"), "day_reviews", "surplus")


@checks.add(
    "sentiment_counts",

    """WITH s AS (SELECT source, CASE WHEN quality = 1 THEN 'positive' WHEN toxic = 1 THEN 'negative' WHEN d.doc_id % 2 = 0 THEN 'neutral' ELSE 'other' END AS sentiment
                FROM labels l JOIN documents d USING (doc_id)),
          c AS (SELECT source, count(*) FILTER (WHERE sentiment = 'positive') AS positive, count(*) FILTER (WHERE sentiment = 'neutral') AS neutral,
                       count(*) FILTER (WHERE sentiment = 'negative') AS negative FROM s GROUP BY source),
          t AS (SELECT *, greatest(positive + neutral + negative, 1) AS total FROM c)
       SELECT *, CAST(trunc(positive / total * 100) AS INTEGER) AS pos_pct, CAST(trunc(neutral / total * 100) AS INTEGER) AS neu_pct,
              CAST(trunc(negative / total * 100) AS INTEGER) AS neg_pct FROM t""",
)
def sentiment_counts(spark, sf):
    labels = load(spark, sf, "labels").join(load(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    sentiment = (
        F.when(F.col("quality") == 1, "positive")
        .when(F.col("toxic") == 1, "negative")
        .when(F.col("doc_id") % 2 == 0, "neutral")
        .otherwise("other")
    )
    return assembly.sentiment_summary(labels.withColumn("sentiment", sentiment), "source")


@checks.add(
    "avg_source_rating",
    sql(
        "doc_reviews",
        """SELECT user_id, coalesce(avg(nullif(rating, 0)), max(helpful_vote * 0.5)) AS avg_rating FROM doc_reviews GROUP BY user_id""".replace(
            "helpful_vote * 0.5", "CAST(helpful_vote AS DOUBLE) * CAST(0.5 AS DOUBLE)"
        ),
    ),
)
def avg_source_rating(spark, sf):
    fallback = F.col("helpful_vote").cast("double") * F.lit(0.5)
    return assembly.avg_rating_or(fr.doc_reviews(spark, sf), "user_id", fallback)


@checks.add(
    "null_fill_count",
    sql(
        "reviews catalog",
        f"""SELECT count(*) FILTER (WHERE m.item_category IS NULL OR m.item_category = 'None') AS n_filled
            FROM ({fr.RATED}) r LEFT JOIN ({fr.METADATA}) m USING (item_id)""",
    ),
)
def null_fill_count(spark, sf):
    filled = training.fill_categories(fr.rated(spark, sf), fr.metadata(spark, sf))
    return filled.agg(F.count_if("was_missing").alias("n_filled"))


LOGITS = sql("logits", "")


@checks.add(
    "accuracy",
    LOGITS + "SELECT avg(CASE WHEN CAST(logit > 0 AS DOUBLE) = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy FROM logits",
)
def accuracy(spark, sf):
    return training.accuracy(load(spark, sf, "logits"))


@checks.add(
    "bce_loss",
    LOGITS + "SELECT round(avg(greatest(logit, 0) - logit * label + ln(1 + exp(-abs(logit)))), 8) AS loss FROM logits",
)
def bce_loss(spark, sf):
    return training.bce_loss(load(spark, sf, "logits")).select(F.round("loss", 8).alias("loss"))


# --- windows and ranking ---------------------------------------------------------


@checks.add("primary_category", sql("reviews", fr.PRIMARY))
def primary_category(spark, sf):
    return ops.primary_category(fr.reviews(spark, sf))


@checks.add(
    "latest_per_key",
    """SELECT user_id, event_id, event_type, value FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn = 1""",
)
def latest_per_key(spark, sf):
    events = load(spark, sf, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return ranking.latest_per_key(events, ["user_id"], "ts", ["event_id"]).drop("ts")


@checks.add(
    "rank_results",
    """SELECT o_custkey, o_orderkey, CAST(rank AS INTEGER) AS rank FROM (
         SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 20""",
)
def rank_results(spark, sf):
    orders = load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return ranking.rank_results(orders, ["o_custkey"], [F.col("o_totalprice").desc(), "o_orderkey"], 20).drop("o_totalprice")


@checks.add(
    "first_n_per_group",
    """SELECT c_nationkey, c_custkey FROM (
         SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) AS rn FROM customer) WHERE rn <= 8""",
)
def first_n_per_group(spark, sf):
    customers = load(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_name")
    return ranking.top_n(customers, ["c_nationkey"], ["c_name"], 8).drop("c_name")


@checks.add(
    "ordinal_encode",
    sql("reviews", "SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS idx FROM (SELECT DISTINCT user_id FROM reviews)"),
)
def ordinal_encode(spark, sf):
    return indexing.ordinal(fr.reviews(spark, sf), "user_id")


@checks.add(
    "global_shuffle",
    "SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR) || '|42') AS shuffle_key FROM orders",
)
def global_shuffle(spark, sf):
    keyed = load(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("k"))
    order = F.md5(F.concat(F.col("k"), F.lit("|42"))).alias("shuffle_key")
    return indexing.shuffle_rows(keyed, "k", 42).select("o_orderkey", order)


@checks.add(
    "train_val_split",
    sql(
        "reviews",
        """SELECT row_key, CASE WHEN ('0x' || substr(md5(row_key || '|42'), 1, 15))::BIGINT % 1000000 < 900000 THEN 'train' ELSE 'val' END AS split
           FROM reviews""",
    ),
)
def train_val_split(spark, sf):
    return indexing.hash_split(fr.reviews(spark, sf).select("row_key"), "row_key", 0.9, 42)


@checks.add(
    "train_val_split_exact",
    """SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|42'), CAST(o_orderkey AS VARCHAR)) <= floor(0.9 * (SELECT count(*) FROM orders))
              THEN 'train' ELSE 'val' END AS split FROM orders""",
)
def train_val_split_exact(spark, sf):
    keyed = load(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("k"))
    return indexing.exact_split(keyed, "k", 0.9, 42).drop("k")


@checks.add(
    "limit_rows",
    """SELECT 'any' AS what, least(100, count(*)) AS n_rows, 0 AS n_foreign FROM orders
       UNION ALL SELECT 'filtered', least(40, count(*)), 0 FROM orders WHERE o_orderkey % 3 = 0
       UNION ALL SELECT 'grouped', least(7, count(DISTINCT o_custkey)), 0 FROM orders""",
)
def limit_rows(spark, sf):
    """Any hundred orders, forty of some, seven of their customers: their numbers, and how many are no such rows."""
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey")
    some, customers = orders.filter("o_orderkey % 3 = 0"), orders.groupBy("o_custkey").agg(F.count("*").alias("n"))

    def counted(what: str, rows, n: int, key: str):
        head = ranking.limit_rows(rows, n)
        known = head.join(rows.select(key, F.lit(True).alias("known")), key, "left")
        foreign = F.count_if(F.col("known").isNull()).cast("int")
        return known.agg(F.lit(what).alias("what"), F.count("*").alias("n_rows"), foreign.alias("n_foreign"))

    return src.union_all(
        counted("any", orders, 100, "o_orderkey"), counted("filtered", some, 40, "o_orderkey"), counted("grouped", customers, 7, "o_custkey")
    )


@checks.add(
    "limit_rows_repeatable",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 7 <> 3 ORDER BY o_orderkey LIMIT 4321",
)
def limit_rows_repeatable(spark, sf):
    """Orders written in order of their key to files of 1 000 rows: the first rows are the first ones by name and place."""
    path = scratch_path(spark, "ordered")
    rows = load(spark, sf, "orders").select("o_orderkey", "o_custkey")
    rows.repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey").write.option("maxRecordsPerFile", 1000).parquet(path)
    return ranking.limit_rows(spark.read.parquet(path).filter("o_orderkey % 7 <> 3"), 4321)


# --- training set ----------------------------------------------------------------


def _prepared(spark, sf):
    return training.super_category_prep(fr.rated(spark, sf), fr.metadata(spark, sf))


@checks.add("super_category_prep", sql("reviews catalog", f", {fr.PREPARED} SELECT row_key, user_id, item_id, rating, item_category, user_primary_category FROM prepared"))
def super_category_prep(spark, sf):
    return _prepared(spark, sf).select("row_key", "user_id", "item_id", "rating", "item_category", "user_primary_category")


@checks.add(
    "super_category_fill",
    sql(
        "reviews catalog",
        f"""SELECT user_id, {fr.SOURCE_SUPER.format(c='user_primary_category')} AS from_source FROM ({fr.PRIMARY}) p""",
    ),
)
def super_category_fill(spark, sf):
    top = ops.primary_category(fr.reviews(spark, sf))
    filled = categories.super_category_fill(F.lit(None).cast("string"), F.col("user_primary_category"))
    return top.select("user_id", filled.alias("from_source"))


@checks.add(
    "entity_category_map",
    sql(
        "reviews catalog",
        f", {fr.PREPARED}, {fr.ENCODED} SELECT user_idx, arg_max(user_cat_idx, row_key) AS user_cat_idx FROM observed GROUP BY user_idx",
    ),
)
def entity_category_map(spark, sf):
    rows, turns = fr.rated_rows(spark, sf), fr.review_turns(spark, sf)
    filled, top = training.stored_filled(fr.rated(spark, sf, rows), fr.metadata(spark, sf), turns)
    drop_stored(rows)
    users, items = indexing.ordinal(filled, "user_id"), indexing.ordinal(filled, "item_id")
    cats = training.category_vocab(filled, top)
    coded = training.stored_samples(filled, top, users, items, cats, turns)
    return stored_in_turns(
        lambda keep: training.entity_category(coded.filter(keep), "user_idx", "user_cat_idx", "row_key"), "user_idx", turns, "categories"
    )


PICK = "('0x' || substr(md5(concat_ws('|', row_key, CAST(draw AS VARCHAR), '{w}', '42')), 1, 15))::BIGINT % (SELECT count(*) FROM {t})"


@checks.add(
    "negative_sampling",
    sql(
        "reviews catalog",
        f""", {fr.PREPARED}, {fr.ENCODED}
            SELECT row_key, draw, {PICK.format(w='u', t='users')} AS user_idx, {PICK.format(w='i', t='items')} AS item_idx
            FROM prepared, (VALUES (1), (2)) d(draw)""",
    ),
)
def negative_sampling(spark, sf):
    rows = fr.reviews(spark, sf)
    n_users = rows.select("user_id").distinct().count()
    n_items = rows.select("parent_asin").distinct().count()
    return training.draw_pairs(rows, "row_key", n_users, n_items, 2, 42)


@checks.add(
    "training_samples",
    sql(
        "reviews catalog",
        f""", {fr.PREPARED}, {fr.ENCODED},
            drawn AS (SELECT row_key, {PICK.format(w='u', t='users')} AS user_idx, {PICK.format(w='i', t='items')} AS item_idx
                      FROM prepared, (VALUES (1), (2)) d(draw)),
            uc AS (SELECT user_idx, arg_max(user_cat_idx, row_key) AS user_cat_idx FROM observed GROUP BY user_idx),
            ic AS (SELECT item_idx, arg_max(item_cat_idx, row_key) AS item_cat_idx FROM observed GROUP BY item_idx)
            SELECT * FROM observed UNION ALL
            SELECT row_key, user_idx, item_idx, user_cat_idx, item_cat_idx, CAST(0 AS FLOAT) FROM drawn JOIN uc USING (user_idx) JOIN ic USING (item_idx)""",
    ),
)
def training_samples(spark, sf):
    rows = fr.rated_rows(spark, sf)
    samples, _ = training.training_samples(
        fr.rated(spark, sf, rows), fr.metadata(spark, sf), turns=fr.review_turns(spark, sf), release=lambda: drop_stored(rows)
    )
    return samples


@checks.add("cf_train")
def cf_train(spark, sf):
    pairs = ops.interactions(fr.reviews_without_texts(spark, sf)).drop("event_timestamp")
    users, items = recommend.fit_factors(pairs, turns=fr.review_turns(spark, sf))
    named = [users.withColumnRenamed("user_id", "id"), items.withColumnRenamed("item_id", "id")]
    return src.union_all(*named)


@checks.add("cf_train_solved", sql("reviews", "SELECT DISTINCT user_id, true AS solved FROM reviews"))
def cf_train_solved(spark, sf):
    """Every user's factors solve the normal equations of the last step, given the item factors: what makes them a fit."""
    import numpy as np
    import pyarrow as pa

    reg = 0.1  # the trainer's default, times the number of items with weight
    turns = fr.review_turns(spark, sf)
    given = ops.interactions(fr.reviews_without_texts(spark, sf))
    pairs = stored_in_turns(
        lambda keep: given.filter(keep).groupBy("user_id", "item_id").agg(F.sum("label").alias("weight")), "item_id", turns, "pairs"
    )
    factors = recommend.fit_factors(pairs.withColumnRenamed("weight", "label"), rank=16, turns=turns)
    users, items = (stored(side, "factors") for side in factors)
    del factors
    sweep(spark)  # the trainer's last step
    product = [F.sum(F.get("vector", i).cast("double") * F.get("vector", j)).alias(f"_{i}_{j}") for i in range(16) for j in range(16)]
    gram = np.array(items.agg(*product).first()).reshape(16, 16)  # 256 numbers

    def residual(rows: pa.Table) -> pa.Table:
        def matrix(name: str) -> np.ndarray:
            column = rows[name].combine_chunks()
            return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)

        x, y, weight = matrix("x")[0], matrix("y"), rows["weight"].to_numpy()
        wanted = ((1 + weight) * (weight > 0)) @ y
        left = gram @ x + (weight * (y @ x)) @ y + reg * (weight > 0).sum() * x
        solved = np.abs(left - wanted).max() <= 1e-3 * (1 + np.abs(wanted).max())
        return pa.table({"user_id": rows["user_id"].slice(0, 1), "solved": pa.array([bool(solved)])})

    def solved(keep):
        # users last: their rows then lie together, and their vectors do not travel to the items
        joined = pairs.filter(keep).join(items.withColumnRenamed("vector", "y"), "item_id").join(users.withColumnRenamed("vector", "x"), "user_id")
        return joined.groupBy("user_id").applyInArrow(residual, "user_id string, solved boolean")

    return stored_in_turns(solved, "user_id", turns, "solved")
