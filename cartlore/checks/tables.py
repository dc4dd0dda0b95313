"""Sinks, ingest, staging, the store and streams: whole tables written and read back."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import categories
from ..functions.encoders import model_encoder
from ..operators import features as ops
from ..operators import recommend, training
from ..operators import similarity as sim
from ..plans.registry import Cells, FeatureView
from ..plans.store import FeatureStore
from ..plans.views import standard_views
from ..session import drop_stored, scratch_path
from ..sources import files
from ..sources import reviews as src
from ..streaming import counters, joins
from ..streaming import materialize as stream
from . import frames as fr
from .base import Checks
from .retrieval import SCORED

checks = Checks()
load, sql = fr.load, fr.sql


@checks.add(
    "schema_drift",
    sql(
        "reviews",
        """SELECT row_key, parent_asin, CAST(CASE WHEN rating < 2 THEN 0 WHEN rating >= 4 THEN helpful_vote ELSE nullif(helpful_vote, 3) END AS BIGINT) AS helpful_vote,
                  rating FROM reviews""",
    ),
)
def schema_drift(spark, sf):
    """Files of four layouts in two folders, one scan: a former name, a column that did not exist yet, missing votes that stay missing, other types."""
    root = f"{scratch_path(spark, 'drift')}/reviews"
    rows = load(spark, sf, "reviews").select("row_key", "user_id", "parent_asin", "rating", "helpful_vote", "timestamp")
    votes = F.nullif(F.col("helpful_vote"), F.lit(3))
    former = rows.withColumnRenamed("parent_asin", "asin")
    for folder, part in {
        "Books": former.filter("rating < 2").drop("helpful_vote"),
        "Electronics": former.filter("rating >= 2 AND rating < 4").withColumn("helpful_vote", votes.cast("long")),
    }.items():
        part.write.parquet(f"{root}/{folder}")
    rows.filter("rating >= 4 AND rating < 5").write.mode("append").parquet(f"{root}/Electronics")
    shuffled = rows.filter("rating >= 5 OR rating IS NULL").select(*reversed(rows.columns))
    shuffled.write.mode("append").parquet(f"{root}/Books")
    found = src.scan_reviews(spark, f"{root}/*/")
    return found.select("row_key", "parent_asin", F.col("helpful_vote").cast("long"), "rating")


@checks.add("path_category", sql("reviews", "SELECT row_key, category, ts_ms AS event_ms FROM reviews"))
def path_category(spark, sf):
    """Reviews written into category folders; the category is read back from the path."""
    root = scratch_path(spark, "raw")
    rows = load(spark, sf, "reviews").select("row_key", "user_id", "parent_asin", "rating", "timestamp", "category")
    for name in categories.SOURCE_TO_SUPER_CATEGORY:
        rows.filter(F.col("category") == name).drop("category").write.parquet(f"{root}/reviews/{name}")
    found = src.scan_reviews(spark, f"{root}/reviews/*/", rows.drop("category").schema)
    return found.select("row_key", "category", fr.epoch_ms("event_timestamp", "event_ms"))


@checks.add("ingest_jsonl", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def ingest_jsonl(spark, sf):
    documents = load(spark, sf, "documents")
    lines, root = scratch_path(spark, "lines"), scratch_path(spark, "raw")
    documents.write.json(lines)
    return spark.read.parquet(src.ingest_jsonl(spark, lines, root, "Books", documents.schema))


@checks.add("ingest_catalog", sql("catalog", "SELECT parent_asin, title, main_category, price, store FROM catalog"))
def ingest_catalog(spark, sf):
    """No Parquet shards, so the JSON-lines file is taken."""
    root = scratch_path(spark, "catalog")
    load(spark, sf, "catalog").drop("copy_no").write.json(f"{root}/meta_categories/meta_Books.jsonl")
    return src.ingest_catalog(spark, root, "Books").select(*schemas.CATALOG.names)


@checks.add(
    "instruction_scan",
    sql("instruction", "SELECT instruction, input, output FROM instruction"),
)
def instruction_scan(spark, sf):
    root = scratch_path(spark, "instructions")
    load(spark, sf, "instruction").select(*schemas.INSTRUCTIONS.names).write.json(f"{root}/train")
    return src.scan_split(spark, root, "train")


@checks.add("chunked_parquet_sink", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def chunked_parquet_sink(spark, sf):
    path = scratch_path(spark, "chunked")
    src.write_chunked(load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), path, 4_000)
    return spark.read.parquet(path)


@checks.add("training_parquet_sink", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def training_parquet_sink(spark, sf):
    path = scratch_path(spark, "training")
    src.write_training(load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), path)
    return spark.read.parquet(path)


@checks.add("file_inventory", "SELECT 'events' AS table_name, 16 AS n_files, count(*) AS n_rows FROM events")
def file_inventory(spark, sf):
    """Sixteen training files: counted from the listing, their rows from the data."""
    path = scratch_path(spark, "inventory")
    src.write_training(load(spark, sf, "events"), f"{path}/events", 16)
    summary = files.inventory_summary(files.file_inventory(spark, path))
    name = F.regexp_extract("prefix", "([^/]+)$", 1)
    folder = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1)
    rows = spark.read.parquet(f"{path}/events").groupBy(folder.alias("table_name")).agg(F.count("*").alias("n_rows"))
    counts = summary.select(name.alias("table_name"), F.col("n_files").cast("int").alias("n_files"))
    return counts.join(rows, "table_name")


@checks.add(
    "staging_table",
    sql(
        "reviews catalog",
        f""", {fr.PREPARED}, {fr.ENCODED}
            SELECT 'samples' AS "table", 3 * count(*) AS n_rows FROM observed UNION ALL SELECT 'user_vocab', count(*) FROM users
            UNION ALL SELECT 'item_vocab', count(*) FROM items UNION ALL SELECT 'category_vocab', count(*) FROM cats""",
    ).replace("3 * count(*)", "CAST(3 * count(*) AS BIGINT)"),
)
def staging_table(spark, sf):
    path = scratch_path(spark, "staged")
    rows = fr.rated_rows(spark, sf)
    samples, vocabularies = training.training_samples(
        fr.rated(spark, sf, rows), fr.metadata(spark, sf), turns=fr.review_turns(spark, sf), release=lambda: drop_stored(rows)
    )
    training.stage_training(samples, vocabularies, path)
    return spark.read.parquet(f"{path}/counts")


# vectors by element, in thousandths
ELEMENTS = "array_to_string(list_transform({v}, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT)), ',')"


def elements(vec: str):
    return F.array_join(F.transform(vec, lambda x: F.round(x.cast("double") * 1000).cast("long").cast("string")), ",")


@checks.add("vector_sink", sql("item_vectors", f"SELECT item_id, category, {ELEMENTS.format(v='embedding')} AS elements, true AS in_a_cell FROM item_vectors"))
def vector_sink(spark, sf):
    """Rows and vectors of a stored index, read back."""
    path = scratch_path(spark, "vectors")
    sim.write_vectors(sim.build_ivf(sim.Side(load(spark, sf, "item_vectors"), "item_id", "embedding"), 8), path)
    index = sim.read_vectors(spark, path)
    return index.rows.select("item_id", "category", elements("embedding").alias("elements"), F.col("cell").between(0, 7).alias("in_a_cell"))


def _tower_weights(width: int, hidden: int):
    """A simple rule, so that SQL can repeat the two layers: unit j averages two neighbours, minus a shift."""
    import numpy as np

    first = np.zeros((hidden, width))
    for j in range(hidden):
        first[j, j % width] = 0.5
        first[j, (j + 1) % width] = 0.5
    second = np.eye(hidden)
    return recommend.TowerWeights(first, np.full(hidden, -0.01), second, np.zeros(hidden))


@checks.add(
    "tower_forward",
    f"""WITH x AS (SELECT vec_id, list_concat(CAST(embedding AS DOUBLE[]), [label / 10.0::DOUBLE, 1.0::DOUBLE, vec_id % 7 / 7.0::DOUBLE, 0.5::DOUBLE]) AS x FROM embeddings),
            h AS (SELECT vec_id, list_transform(range(1, 69), lambda j: greatest(0.5::DOUBLE * x[j] + 0.5::DOUBLE * x[j % 68 + 1] - 0.01::DOUBLE, 0)) AS y FROM x),
            n AS (SELECT vec_id, list_transform(y, lambda v: v / greatest(sqrt(list_inner_product(y, y)), CAST(1e-12 AS DOUBLE))) AS y FROM h)
       SELECT vec_id, {ELEMENTS.format(v='y')} AS elements FROM n""",
)
def tower_forward(spark, sf):
    """All 64 dimensions and a category embedding of four."""
    category = F.array(F.col("label") / 10.0, F.lit(1.0), F.col("vec_id") % 7 / 7.0, F.lit(0.5))
    rows = load(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), category.alias("c"))
    out = recommend.tower(rows, _tower_weights(68, 68), "e", "c")
    return out.select("vec_id", elements("vector").alias("elements"))


# --- the store ---------------------------------------------------------------------

DAILY = schemas.struct(day_reviews=T.LongType(), day_avg_qty=T.DoubleType())
TTL = timedelta(days=3650)


def _daily_store(spark, sf) -> FeatureStore:
    store = FeatureStore(spark, scratch_path(spark, "store"))
    store.apply([FeatureView("user_daily", ("user_id",), TTL, DAILY, lambda s: load(s, sf, "user_daily"), lambda df: df, row_wise=True)])
    return store


BATCHES = ["1996-01-01 00:00:00", "2100-01-01 00:00:00"]


@checks.add("offline_sink", sql("user_daily", "SELECT user_id, epoch_ms(event_timestamp) AS event_ms, day_reviews, day_avg_qty FROM user_daily"))
def offline_sink(spark, sf):
    """Two incremental batches, read back together."""
    store = _daily_store(spark, sf)
    for end in BATCHES:
        store.materialize_incremental(end)
    rows = spark.read.parquet(store.offline_path("user_daily"))
    return rows.select("user_id", fr.epoch_ms("event_timestamp", "event_ms"), "day_reviews", "day_avg_qty")


HISTORICAL = """SELECT s.order_id, s.item_id, CAST(u.day_reviews AS DOUBLE) AS day_reviews, u.day_avg_qty FROM spine s
    ASOF LEFT JOIN user_daily u ON s.user_id = u.user_id AND s.event_timestamp >= u.event_timestamp"""


@checks.add("get_historical_features", sql("spine user_daily", HISTORICAL))
def get_historical_features(spark, sf):
    store = _daily_store(spark, sf)
    store.materialize(None, BATCHES[-1])
    refs = ["user_daily:day_reviews", "user_daily:day_avg_qty"]
    found = store.get_historical_features(load(spark, sf, "spine"), refs, with_ttl=False)
    return found.select("order_id", "item_id", F.col("day_reviews").cast("double"), "day_avg_qty")


@checks.add(
    "get_online_features",
    sql(
        "user_daily",
        """, latest AS (SELECT * FROM user_daily QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_timestamp DESC) = 1)
           SELECT event_id, e.user_id, CAST(day_reviews AS DOUBLE) AS day_reviews FROM (SELECT event_id, concat('U', CAST(event_id AS VARCHAR)) AS user_id FROM events) e
           LEFT JOIN latest USING (user_id)""",
    ),
)
def get_online_features(spark, sf):
    """Most of the asked keys are unknown."""
    store = _daily_store(spark, sf)
    store.materialize(None, BATCHES[-1])
    asked = load(spark, sf, "events").select("event_id", F.concat(F.lit("U"), F.col("event_id").cast("string")).alias("user_id"))
    found = store.get_online_features(asked, ["user_daily:day_reviews"])
    return found.select("event_id", "user_id", F.col("day_reviews").cast("double"))


@checks.add(
    "materialize",
    sql(
        "user_daily",
        """SELECT user_id, epoch_ms(event_timestamp) AS event_ms, day_reviews FROM user_daily
           WHERE event_timestamp >= TIMESTAMP '1995-06-01' AND event_timestamp < TIMESTAMP '1997-06-01'""",
    ),
)
def materialize(spark, sf):
    """One time window, run twice: the second run replaces the first."""
    store = _daily_store(spark, sf)
    for _ in range(2):
        store.materialize("1995-06-01 00:00:00", "1997-06-01 00:00:00", ["user_daily"])
    rows = spark.read.parquet(store.offline_path("user_daily"))
    return rows.select("user_id", fr.epoch_ms("event_timestamp", "event_ms"), "day_reviews")


@checks.add(
    "materialize_overlapping",
    sql("user_daily", "SELECT user_id, epoch_ms(event_timestamp) AS event_ms, day_reviews FROM user_daily WHERE event_timestamp < TIMESTAMP '1998-01-01'"),
)
def materialize_overlapping(spark, sf):
    """Overlapping windows, then an incremental run that goes on from their end: every row once."""
    store = _daily_store(spark, sf)
    store.materialize(None, "1996-01-01 00:00:00")
    store.materialize("1995-01-01 00:00:00", "1997-01-01 00:00:00")
    store.materialize_incremental("1998-01-01 00:00:00")
    return store.offline("user_daily").select("user_id", fr.epoch_ms("event_timestamp", "event_ms"), "day_reviews")


@checks.add(
    "materialize_late_rows",
    sql("user_daily", "SELECT user_id, epoch_ms(event_timestamp) AS event_ms, day_reviews FROM user_daily"),
)
def materialize_late_rows(spark, sf):
    """Some rows are there only after the run of their time; a run with that lateness brings them in."""
    store = FeatureStore(spark, scratch_path(spark, "late-store"))
    late = F.col("event_timestamp").between("1995-11-01", "1995-12-31") & (F.crc32(F.col("user_id").cast("binary")) % 2 == 0)
    arrived = {"all": False}

    def source(s):
        rows = load(s, sf, "user_daily")
        return rows if arrived["all"] else rows.filter(~late)

    store.apply([FeatureView("user_daily", ("user_id",), TTL, DAILY, source, lambda df: df, row_wise=True)])
    store.materialize_incremental(BATCHES[0])
    arrived["all"] = True
    store.materialize_incremental(BATCHES[1], lateness=timedelta(days=90))
    return store.offline("user_daily").select("user_id", fr.epoch_ms("event_timestamp", "event_ms"), "day_reviews")


@checks.add(
    "retrieve",
    sql("user_vectors item_vectors", SCORED + " SELECT user_id, item_id, round(cosine, 6) AS score, rank, category FROM ranked WHERE rank <= 5"),
)
def retrieve(spark, sf):
    """Vectors materialised into the store and searched there."""
    store = FeatureStore(spark, scratch_path(spark, "vector-store"))

    def rows(session):
        return load(session, sf, "item_vectors").withColumn("event_timestamp", F.lit("2024-01-01").cast("timestamp"))

    schema = schemas.struct(embedding=schemas.VECTOR, category=T.StringType())
    store.apply([FeatureView("item_vectors", ("item_id",), TTL, schema, rows, lambda df: df, offline=False, row_wise=True)])
    store.materialize(None, None)
    asked = sim.Side(load(spark, sf, "user_vectors"), "user_id", "embedding")
    hits = store.retrieve(asked, "item_vectors", "embedding", 5, ["category"])
    return hits.select("user_id", "item_id", F.round("score", 6).alias("score"), "rank", "category")


@checks.add(
    "retrieve_indexed",
    sql("user_vectors item_vectors", SCORED + " SELECT user_id, item_id, round(cosine, 6) AS score, round(1 - cosine, 6) AS distance, rank, category FROM ranked WHERE rank <= 5"),
)
def retrieve_indexed(spark, sf):
    """An index stored over a snapshot, read back and probed on all its cells: the exact result, with payload."""
    store = FeatureStore(spark, scratch_path(spark, "indexed-store"))

    def rows(session):
        return load(session, sf, "item_vectors").withColumn("event_timestamp", F.lit("2024-01-01").cast("timestamp"))

    schema = schemas.struct(embedding=schemas.VECTOR, category=T.StringType())
    store.apply([FeatureView("item_vectors", ("item_id",), TTL, schema, rows, lambda df: df, offline=False, row_wise=True)])
    store.materialize(None, None)
    store.index_vectors("item_vectors", "embedding", 8)
    asked = sim.Side(load(spark, sf, "user_vectors"), "user_id", "embedding")
    hits = store.retrieve(asked, "item_vectors", "embedding", 5, ["category"], nprobe=8)
    return hits.withColumns({"score": F.round("score", 6), "distance": F.round("distance", 6)})


@checks.add(
    "vectorised_encoder",
    """WITH c AS (SELECT doc_id, [CAST(length(text) AS DOUBLE), CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE)] AS v FROM documents)
       SELECT doc_id, round(v[2] / greatest(sqrt(v[1] * v[1] + v[2] * v[2]), CAST(1e-12 AS DOUBLE)), 3) AS share FROM c""",
)
def vectorised_encoder(spark, sf):
    """A model that sees batches of whole texts: their length and their number of e's."""

    def model():
        import numpy as np

        return lambda texts: np.array([[len(x), x.count("e")] for x in texts])

    vectors = model_encoder(model)(load(spark, sf, "documents").select("doc_id", "text"), "text", "v")
    return vectors.select("doc_id", F.round(F.element_at("v", 2).cast("double"), 3).alias("share"))


# --- streams ---------------------------------------------------------------------------


def _event_stream(spark, sf):
    events = load(spark, sf, "events")
    reader = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet")
    rows = reader.parquet(sf)
    return rows.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", F.round(F.col("value") * 10, 3).alias("latency_ms")
    )


@checks.add(
    "stream_rate_window",
    """SELECT start_ms, event_type, count(*) AS n, count(*) / 60 AS rate FROM (
         SELECT event_type, (CAST(floor(epoch_us(ts) / 15000000.0) AS BIGINT) - k) * 15000 AS start_ms FROM events, (SELECT unnest(range(0, 4)) AS k))
       WHERE start_ms + 60000 <= (SELECT epoch_ms(max(ts)) - 120000 FROM events)
       GROUP BY start_ms, event_type""",
)
def stream_rate_window(spark, sf):
    """The event table as a stream: ranges are written once, when the watermark of two minutes has passed them, and leave the state."""
    path = scratch_path(spark, "rates")
    rates = stream.rate_stream(_event_stream(spark, sf), "2 minutes", "1 minute", 60, "15 seconds", ["event_type"])
    stream.append_to_table(rates, path, scratch_path(spark, "rates-state")).awaitTermination()
    found = spark.read.schema(rates.schema).parquet(path)
    return found.select(fr.epoch_ms("start", "start_ms"), "event_type", "n", "rate")


@checks.add(
    "stream_materialize",
    """SELECT user_id, count(*) AS n_events, round(avg(value), 6) AS avg_value, epoch_us(max(ts)) AS last_us FROM events GROUP BY user_id""",
)
def stream_materialize(spark, sf):
    store = FeatureStore(spark, scratch_path(spark, "live"))

    def per_user(df):
        return df.groupBy("user_id").agg(
            F.count("*").alias("n_events"),
            F.round(F.avg("value"), 6).alias("avg_value"),
            F.max(F.col("ts").cast("timestamp")).alias("event_timestamp"),
        )

    view = FeatureView(
        "user_events",
        ("user_id",),
        TTL,
        schemas.struct(n_events=T.LongType(), avg_value=T.DoubleType()),
        lambda s: load(s, sf, "events"),
        per_user,
        offline=False,
        key_types={"user_id": T.LongType()},
        cells=Cells(("user_id",), per_user, lambda cells: cells),
    )
    store.apply([view])
    events = load(spark, sf, "events")
    arriving = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    state = scratch_path(spark, "live-state")
    stream.stream_materialize(store, view, arriving, state).awaitTermination()
    found = store.online("user_events")
    return found.select("user_id", "n_events", "avg_value", F.unix_micros("event_timestamp").alias("last_us"))


@checks.add(
    "stream_merge",
    """SELECT user_id, count(*) AS n_events, round(sum(value) / count(*), 6) AS avg_value, epoch_us(max(ts)) AS last_us FROM events GROUP BY user_id""",
)
def stream_merge(spark, sf):
    """The events in two files, taken in one after the other: the second batch adds to the cells of its keys."""
    store = FeatureStore(spark, scratch_path(spark, "merging"))
    cells = Cells(
        ("user_id",),
        lambda df: df.groupBy("user_id").agg(
            F.count("*").alias("n"), F.sum("value").alias("total"), F.max(F.col("ts").cast("timestamp")).alias("last")
        ),
        lambda state: state.select(
            "user_id", F.col("n").alias("n_events"), F.round(F.col("total") / F.col("n"), 6).alias("avg_value"), F.col("last").alias("event_timestamp")
        ),
    )
    view = FeatureView(
        "user_events", ("user_id",), TTL, schemas.struct(n_events=T.LongType(), avg_value=T.DoubleType()), lambda s: load(s, sf, "events"),
        lambda df: cells.finish(cells.make(df)), offline=False, key_types={"user_id": T.LongType()}, cells=cells,
    )
    store.apply([view])
    events = load(spark, sf, "events")
    arriving, state = scratch_path(spark, "arriving"), scratch_path(spark, "merging-state")
    for part in (F.col("event_id") % 3 == 0, F.col("event_id") % 3 != 0):
        events.filter(part).write.mode("append").parquet(arriving)
        rows = stream.read_files(spark, arriving, events.schema)
        stream.stream_materialize(store, view, rows, state).awaitTermination()
    found = store.online("user_events")
    return found.select("user_id", "n_events", "avg_value", F.unix_micros("event_timestamp").alias("last_us"))


@checks.add("stream_user_features", sql("reviews", fr.USER_FEATURES))
def stream_user_features(spark, sf):
    """Reviews arrive in two files; distinct items, categories and the main category come from cells, no review is read twice."""
    store, arriving, state = (scratch_path(spark, name) for name in ("cells-store", "cells-arriving", "cells-state"))
    store = FeatureStore(spark, store)
    rows = fr.reviews(spark, sf).drop("row_key", "event_timestamp")
    schema = rows.schema
    views = standard_views(lambda s: src.to_review_events(s.createDataFrame([], schema)), lambda s: fr.catalog(s, sf), as_of="2030-01-01 00:00:00")
    store.apply([v for v in views if v.name == "user_features"])
    for part in (F.col("rating") % 2 == 0, F.col("rating") % 2 != 0):
        # whole texts: at this level Zstandard takes no longer than Snappy and a quarter less room
        packed = rows.filter(part).write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1")
        packed.mode("append").parquet(arriving)
        live = src.to_review_events(stream.read_files(spark, arriving, schema))
        stream.stream_materialize(store, store.registry.get("user_features"), live, state).awaitTermination()
    found = store.online("user_features").drop("event_timestamp")
    kinds = dict(ops.user_features(fr.reviews(spark, sf)).dtypes)
    return found.select(*(F.col(c).cast(kind) for c, kind in kinds.items()))


@checks.add(
    "counter_increase_stream",
    sql(
        "counter_samples",
        """SELECT * FROM (
             SELECT series, start_ms, sum(step) AS increase, sum(step) / 60 AS per_second FROM (
               SELECT series, CAST(floor(epoch_us(ts) / 60000000.0) AS BIGINT) * 60000 AS start_ms,
                      CASE WHEN prev IS NULL THEN 0.0::DOUBLE WHEN value < prev THEN value ELSE value - prev END AS step
               FROM (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY ts, value) AS prev FROM counter_samples)) GROUP BY ALL)
           WHERE start_ms + 60000 <= (SELECT epoch_ms(max(ts)) - 120000 FROM counter_samples)""",
    ),
)
def counter_increase_stream(spark, sf):
    """The samples arrive in four files by time, each a batch; restarts fall inside ranges, on their borders and between batches."""
    samples = load(spark, sf, "counter_samples")
    arriving, out = scratch_path(spark, "samples"), scratch_path(spark, "increases")
    low, high = samples.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    quarter = F.floor((F.unix_micros("ts") - low) * 4 / (high - low + 1))
    for nth in range(4):
        samples.filter(quarter == nth).coalesce(1).write.mode("append").parquet(arriving)
    live = stream.read_files(spark, arriving, samples.schema, files_per_trigger=1)
    grown = counters.counter_increase_stream(live, ["series"], "ts", "value", 60, "2 minutes")
    stream.append_to_table(grown, out, scratch_path(spark, "increases-state")).awaitTermination()
    found = spark.read.schema(grown.schema).parquet(out)
    return found.select("series", fr.epoch_ms("start", "start_ms"), "increase", "per_second")


@checks.add(
    "interval_join_stream",
    """SELECT p.event_id AS purchase_id, v.event_id AS view_id, epoch_us(p.ts) - epoch_us(v.ts) AS lag_us
       FROM events p JOIN events v ON p.user_id = v.user_id AND v.ts BETWEEN p.ts - INTERVAL 1 DAY AND p.ts
       WHERE p.event_type = 'purchase' AND v.event_type = 'view'""",
)
def interval_join_stream(spark, sf):
    """Purchases and views as two streams over files that arrive in order of time."""
    events = load(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    arriving, out = scratch_path(spark, "two-streams"), scratch_path(spark, "pairs")
    for nth in range(3):
        events.filter(F.floor((F.dayofmonth("ts") - 1) / 11) == nth).coalesce(1).write.mode("append").parquet(arriving)

    def side(kind: str, name: str, ts: str):
        live = stream.read_files(spark, arriving, events.schema, files_per_trigger=1)
        return live.filter(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(name), F.col("ts").alias(ts))

    pairs = joins.interval_join_stream(
        side("purchase", "purchase_id", "at"), side("view", "view_id", "seen_at"), ["user_id"], "at", "seen_at", -86_400, 0, "1 hour", "1 hour"
    )
    lag = F.unix_micros("at") - F.unix_micros("seen_at")
    found = pairs.select("purchase_id", "view_id", lag.alias("lag_us"))
    stream.append_to_table(found, out, scratch_path(spark, "pairs-state")).awaitTermination()
    return spark.read.schema(found.schema).parquet(out)
