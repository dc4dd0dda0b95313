"""Joins: features, point in time, lookups, related items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import categories
from ..operators import asof, indexing, lookups, recommend
from ..operators import features as ops
from ..operators import similarity as sim
from ..session import stored
from . import frames as fr
from .base import Checks
from .sources import DISPLAY

checks = Checks()
load, sql = fr.load, fr.sql

DAY = 86_400


@checks.add(
    "left_join_features",
    sql(
        "reviews",
        f"""SELECT user_id, n, user_primary_category FROM (SELECT user_id, count(*) AS n FROM reviews GROUP BY 1)
            LEFT JOIN ({fr.PRIMARY}) p USING (user_id)""",
    ),
)
def left_join_features(spark, sf):
    rows = fr.reviews(spark, sf)
    return rows.groupBy("user_id").agg(F.count("*").alias("n")).join(ops.primary_category(rows), "user_id", "left")


def daily_views(spark, sf, ttl=None):
    user = {"day_reviews": "day_reviews", "day_avg_qty": "day_avg_qty"}
    item = {"day_sales": "day_sales", "day_qty": "day_qty"}
    return [
        asof.AsOfView("user_daily", load(spark, sf, "user_daily"), ("user_id",), "event_timestamp", user, ttl),
        asof.AsOfView("item_daily", load(spark, sf, "item_daily"), ("item_id",), "event_timestamp", item, ttl),
    ]


PIT = """
    SELECT s.user_id, s.item_id, s.order_id, epoch_ms(s.event_timestamp) AS event_ms, CAST({u1} AS DOUBLE) AS day_reviews,
           {u2} AS day_avg_qty, CAST({i1} AS DOUBLE) AS day_sales, CAST({i2} AS DOUBLE) AS day_qty
    FROM spine s
    ASOF LEFT JOIN user_daily u ON s.user_id = u.user_id AND s.event_timestamp >= u.event_timestamp
    ASOF LEFT JOIN item_daily i ON s.item_id = i.item_id AND s.event_timestamp >= i.event_timestamp"""


def _pit(spark, sf, ttl=None):
    joined = asof.asof_join(load(spark, sf, "spine"), daily_views(spark, sf, ttl))
    counts = {c: F.col(c).cast("double") for c in ("day_reviews", "day_sales", "day_qty")}
    return joined.withColumns(counts).withColumn("event_ms", fr.epoch_ms("event_timestamp")).drop("event_timestamp")


@checks.add(
    "pit_join",
    sql("spine user_daily item_daily", PIT.format(u1="u.day_reviews", u2="u.day_avg_qty", i1="i.day_sales", i2="i.day_qty")),
)
def pit_join(spark, sf):
    return _pit(spark, sf)


def _fresh(alias: str, column: str) -> str:
    return f"CASE WHEN {alias}.event_timestamp >= s.event_timestamp - INTERVAL 90 DAY THEN {alias}.{column} END"


@checks.add(
    "pit_join_ttl",
    sql(
        "spine user_daily item_daily",
        PIT.format(
            u1=_fresh("u", "day_reviews"),
            u2=_fresh("u", "day_avg_qty"),
            i1=_fresh("i", "day_sales"),
            i2=_fresh("i", "day_qty"),
        ),
    ),
)
def pit_join_ttl(spark, sf):
    return _pit(spark, sf, ttl=90 * DAY)


@checks.add(
    "asof_fill",
    """SELECT event_id, user_id, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (
              PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_view
       FROM events""",
)
def asof_fill(spark, sf):
    """Newest viewed value up to each event, as an as-of join of the table with its own views."""
    events = load(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    seen = events.filter(F.col("event_type") == "view").select("user_id", "ts", "value")
    view = asof.AsOfView("views", seen, ("user_id",), "ts", {"value": "last_view"})
    return asof.asof_join(events.select("event_id", "user_id", "ts"), [view], ts="ts").drop("ts")


@checks.add(
    "interval_join",
    """SELECT p.event_id AS purchase_id, v.event_id AS view_id, epoch_us(p.ts) - epoch_us(v.ts) AS lag_us
       FROM events p JOIN events v ON p.user_id = v.user_id AND v.ts BETWEEN p.ts - INTERVAL 1 DAY AND p.ts
       WHERE p.event_type = 'purchase' AND v.event_type = 'view'""",
)
def interval_join(spark, sf):
    events = load(spark, sf, "events")
    purchases = events.filter(F.col("event_type") == "purchase").select(
        "user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("at")
    )
    seen = events.filter(F.col("event_type") == "view").select(
        "user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("seen_at")
    )
    joined = asof.interval_join(purchases, seen, ["user_id"], "at", "seen_at", -DAY, 0)
    lag = F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("seen_at").cast("timestamp"))
    return joined.select("purchase_id", "view_id", lag.alias("lag_us"))


@checks.add(
    "training_join",
    sql(
        "reviews",
        f"""SELECT user_id, item_id, label, user_avg_rating, user_primary_category, item_avg_rating, item_review_count
            FROM (SELECT user_id, parent_asin AS item_id, CAST(CASE WHEN rating >= 4 THEN 1 ELSE 0 END AS DOUBLE) AS label FROM reviews) i
            JOIN ({fr.USER_FEATURES}) u USING (user_id) JOIN ({fr.ITEM_FEATURES}) f USING (item_id)""",
    ),
)
def training_join(spark, sf):
    rows = fr.reviews(spark, sf)
    users = ops.user_features(rows).select("user_id", "user_avg_rating", "user_primary_category")
    items = ops.item_features(rows).select("item_id", "item_avg_rating", "item_review_count")
    pairs = ops.interactions(rows).drop("event_timestamp")
    return ops.training_join(pairs, users, items).select(
        "user_id", "item_id", "label", "user_avg_rating", "user_primary_category", "item_avg_rating", "item_review_count"
    )


@checks.add(
    "dim_left_join",
    sql("reviews catalog", f"SELECT row_key, item_id, item_category FROM (SELECT row_key, parent_asin AS item_id FROM reviews) r LEFT JOIN ({fr.METADATA}) m USING (item_id)"),
)
def dim_left_join(spark, sf):
    rows = fr.reviews(spark, sf).select("row_key", F.col("parent_asin").alias("item_id"))
    return lookups.attach_item_category(rows, fr.metadata(spark, sf)).select("row_key", "item_id", "item_category")


@checks.add(
    "map_lookup_join",
    sql(
        "reviews",
        f"""SELECT concat('U', CAST(c_custkey AS VARCHAR)) AS user_id, coalesce(p.user_primary_category, 'Home & Living') AS user_primary_category
            FROM customer LEFT JOIN ({fr.PRIMARY}) p ON p.user_id = concat('U', CAST(c_custkey AS VARCHAR))""",
    ),
)
def map_lookup_join(spark, sf):
    users = load(spark, sf, "customer").select(F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("user_id"))
    top = ops.primary_category(fr.reviews(spark, sf))
    return lookups.map_lookup(users, top, "user_id", "user_primary_category", categories.DEFAULT_SUPER_CATEGORY)


@checks.add(
    "online_lookup",
    sql(
        "reviews catalog",
        f"""SELECT event_id, e.user_id, e.item_id, user_avg_rating, user_tenure_days, item_title, item_price
            FROM (SELECT event_id, concat('U', CAST(user_id AS VARCHAR)) AS user_id, concat('P', CAST(event_id AS VARCHAR)) AS item_id FROM events) e
            LEFT JOIN ({fr.USER_FEATURES}) u ON u.user_id = e.user_id LEFT JOIN ({fr.METADATA}) m ON m.item_id = e.item_id""",
    ),
)
def online_lookup(spark, sf):
    """Every event asks for its user and for an item id that is often unknown."""
    return look_up(spark, sf, (ops.user_features(fr.reviews(spark, sf)), fr.metadata(spark, sf)))


def lookup_snapshots(spark, sf):
    """User and item rows as a store keeps them: computed and written beforehand."""
    return stored(ops.user_features(fr.reviews(spark, sf)), "users"), stored(fr.metadata(spark, sf), "items")


def look_up(spark, sf, snapshots):
    asked = load(spark, sf, "events").select(
        "event_id",
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("user_id"),
        F.concat(F.lit("P"), F.col("event_id").cast("string")).alias("item_id"),
    )
    users, items = snapshots
    found = lookups.online_lookup(
        asked, [(users, ["user_id"], ["user_avg_rating", "user_tenure_days"]), (items, ["item_id"], ["item_title", "item_price"])]
    )
    return found.select("event_id", "user_id", "item_id", "user_avg_rating", "user_tenure_days", "item_title", "item_price")


RECS = "SELECT concat('U', CAST(c_custkey AS VARCHAR)) AS user_id, concat('P', CAST(c_custkey AS VARCHAR)) AS item_id FROM customer"


def _requests(spark, sf):
    key = F.col("c_custkey").cast("string")
    return load(spark, sf, "customer").select(
        F.concat(F.lit("U"), key).alias("user_id"), F.concat(F.lit("P"), key).alias("item_id")
    )


@checks.add(
    "enrich_items",
    sql(
        "reviews catalog",
        f"SELECT user_id, item_id, {DISPLAY} FROM ({RECS}) r LEFT JOIN ({fr.METADATA}) m USING (item_id) LEFT JOIN ({fr.ITEM_FEATURES}) f USING (item_id)",
    ),
)
def enrich_items(spark, sf):
    return lookups.enrich(_requests(spark, sf), fr.metadata(spark, sf), fr.item_features(spark, sf))


@checks.add(
    "user_profile",
    sql(
        "reviews",
        f"""SELECT user_id, user_avg_rating AS avg_rating, user_review_count AS review_count,
                   user_primary_category AS primary_category, user_tenure_days AS tenure_days
            FROM ({RECS}) r LEFT JOIN ({fr.USER_FEATURES}) u USING (user_id)""",
    ),
)
def user_profile(spark, sf):
    users = _requests(spark, sf).select("user_id")
    return lookups.user_profile(users, ops.user_features(fr.reviews(spark, sf)))


@checks.add(
    "id_lookup_default",
    sql(
        "item_vectors",
        """, v AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM (SELECT DISTINCT item_id FROM item_vectors))
           SELECT p_partkey, coalesce(idx, 0) AS item_idx,
                  ('0x' || substr(md5(concat('P', CAST(p_partkey AS VARCHAR))), 1, 15))::BIGINT % 1000 AS hash_idx
           FROM part LEFT JOIN v ON v.item_id = concat('P', CAST(p_partkey AS VARCHAR))""",
    ),
)
def id_lookup_default(spark, sf):
    parts = load(spark, sf, "part").select("p_partkey", F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("item_id"))
    vocabulary = indexing.ordinal(load(spark, sf, "item_vectors"), "item_id")
    coded = indexing.encode_ids(parts, "item_id", vocabulary, "item_idx")
    return indexing.encode_ids(coded, "item_id", None, "hash_idx", "hash", 1000).drop("item_id")


DOT = "list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
LEN = "sqrt(list_inner_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[])))"


def cosine_sql(a: str, b: str) -> str:
    return f"round({DOT.format(a=a, b=b)} / ({LEN.format(a=a)} * {LEN.format(a=b)}), 9)"


PERSONAS = """SELECT label, list(s ORDER BY pos) AS v FROM (
    SELECT label, pos, sum(CAST(embedding[pos] AS DOUBLE)) AS s FROM embeddings, (SELECT unnest(range(1, 65)) AS pos) GROUP BY label, pos) GROUP BY label"""


@checks.add(
    "persona_affinity",
    f"""WITH p AS ({PERSONAS}), c AS (
          SELECT concat('P', CAST(vec_id AS VARCHAR)) AS item_id, concat('persona ', CAST(p.label AS VARCHAR)) AS persona,
                 {cosine_sql('embedding', 'p.v')} AS c FROM embeddings, p),
        s AS (SELECT item_id, persona, round(1 / (1 + exp(-c)), 4) AS score FROM c)
        SELECT item_id, persona, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, persona) AS INTEGER) AS rank FROM s""",
)
def persona_affinity(spark, sf):
    """One persona per label: the sum of its vectors."""
    rows = load(spark, sf, "embeddings")
    cells = rows.select("label", F.posexplode("embedding").alias("pos", "x"))
    sums = cells.groupBy("label", "pos").agg(F.sum(F.col("x").cast("double")).alias("s"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda c: c["s"])  # one entry per dimension
    personas = sums.groupBy("label").agg(ordered.alias("vector")).select(
        F.concat(F.lit("persona "), F.col("label").cast("string")).alias("persona"), "vector"
    )
    items = load(spark, sf, "item_vectors")
    return recommend.persona_affinity(sim.Side(personas, "persona", "vector"), sim.Side(items, "item_id", "embedding"))


REC_LIST = f"""
    SELECT item_id, title, category, score, CAST(row_number() OVER (ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM (
      SELECT item_id, coalesce(item_title, '') AS title, coalesce(item_category, '') AS category,
             coalesce(item_avg_rating, 0) / 5 AS score
      FROM ({fr.METADATA}) m LEFT JOIN ({fr.ITEM_FEATURES}) f USING (item_id))"""


@checks.add(
    "related_products",
    sql(
        "reviews catalog",
        f""", recs AS MATERIALIZED ({REC_LIST}), head AS (SELECT * FROM recs WHERE title <> ''),
            same AS (
              SELECT i.item_id, r.item_id AS related_id, r.score, r.rank, true AS same_category FROM recs i JOIN head r
                ON i.item_id <> r.item_id AND (contains(lower(i.category), lower(r.category)) OR contains(lower(r.category), lower(i.category)))),
            other AS (
              SELECT i.item_id, r.item_id, r.score, r.rank, false FROM recs i JOIN head r ON i.item_id <> r.item_id
              WHERE i.item_id NOT IN (SELECT item_id FROM same))
            SELECT item_id, related_id, score, same_category, CAST(rn AS INTEGER) AS rank FROM (
              SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank, related_id) AS rn FROM (
                SELECT * FROM same UNION ALL SELECT * FROM other)) WHERE rn <= 5""",
    ),
)
def related_products(spark, sf):
    """All items against the whole catalogue, ranked by average rating."""
    joined = fr.metadata(spark, sf).join(ops.item_features(fr.reviews(spark, sf)), "item_id", "left")
    listed = joined.select(
        "item_id",
        F.coalesce("item_title", F.lit("")).alias("title"),
        F.coalesce("item_category", F.lit("")).alias("category"),
        (F.coalesce("item_avg_rating", F.lit(0.0)) / 5).alias("score"),
    )
    ranked = listed.withColumn("rank", F.struct(-F.col("score"), F.col("item_id")))
    return recommend.related_items(listed.select("item_id", "category"), ranked, 5)


@checks.add(
    "self_exclusion_anti",
    sql(
        "reviews",
        """SELECT e.category FROM (SELECT DISTINCT p_type AS category FROM part UNION SELECT DISTINCT category FROM reviews) e
           WHERE e.category NOT IN (SELECT category FROM reviews)""",
    ),
)
def self_exclusion_anti(spark, sf):
    """Expected categories without any review."""
    seen = fr.reviews(spark, sf).select("category").distinct()
    kinds = load(spark, sf, "part").select(F.col("p_type").alias("category"))
    return lookups.difference(lookups.union_distinct(kinds, seen), seen, ["category"])


@checks.add("coverage_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT user_id FROM events)")
def coverage_semi(spark, sf):
    buyers = load(spark, sf, "events").select(F.col("user_id").alias("c_custkey"))
    return lookups.covered_keys(load(spark, sf, "customer").select("c_custkey"), buyers, ["c_custkey"])
