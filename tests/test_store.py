"""Feature store: registration, materialisation, the three reads, and the streaming form."""

from __future__ import annotations

from datetime import timedelta

import pytest
from conftest import REVIEW_ROWS, REVIEW_SCHEMA

from cartlore import schemas
from cartlore.functions.encoders import hashing_encoder
from cartlore.operators import similarity as sim
from cartlore.operators import telemetry as tm
from cartlore.plans.registry import Cells, FeatureView, feature_view
from cartlore.plans.store import FeatureStore, upsert
from cartlore.plans.views import standard_views
from cartlore.sources import files
from cartlore.sources import reviews as src
from cartlore.streaming import materialize as stream
from pyspark.sql import functions as F
from pyspark.sql import types as T

REFS = [
    "user_features:user_avg_rating",
    "user_features:user_review_count",
    "item_features:item_avg_rating",
    "item_metadata:item_title",
]


def catalog(spark):
    rows = [("B07XJ8C8F5", "Echo", "None", "49.99", "Acme"), ("B07XJ8C8F5", "Echo", "None", "49.99", "Acme"), ("B09K3M2P1Q", "Book", "Books", "None", "None")]
    return src.clean_catalog(spark.createDataFrame(rows, schemas.CATALOG), "Electronics")


@pytest.fixture()
def store(spark, golden_reviews, tmp_path):
    made = FeatureStore(spark, str(tmp_path))
    made.apply(standard_views(lambda s: golden_reviews, catalog, hashing_encoder(16), as_of="2021-03-05 00:00:00"))
    return made


def test_registration(store, spark, golden_reviews):
    listed = {r.name: r for r in store.list_views().collect()}
    assert {n: (r.n_features, r.online, r.offline) for n, r in listed.items()} == {
        "user_features": (7, True, True),
        "item_features": (5, True, True),
        "item_metadata": (4, True, True),
        "interactions": (1, False, True),
        "review_embeddings": (6, True, False),
    }
    assert listed["review_embeddings"].ttl_seconds == 90 * 86_400

    @feature_view("counts", ["user_id"], timedelta(days=1), schemas.struct(n=schemas.L), lambda s: golden_reviews)
    def counts(df):
        return df.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_timestamp").alias("event_timestamp"))

    @feature_view("broken", ["user_id"], timedelta(days=1), schemas.struct(n=schemas.L), lambda s: golden_reviews)
    def broken(df):
        return df.groupBy("user_id").count()

    with pytest.raises(ValueError, match="lacks columns"):
        store.apply([broken])
    store.apply([counts], delete=["interactions"])
    assert "counts" in store.registry.names() and "interactions" not in store.registry.names()
    with pytest.raises(KeyError):
        store.get_online_features(golden_reviews, ["counts:nothing"])


def test_materialize_and_read(store, spark, golden_reviews):
    store.materialize(None, "2022-01-01 00:00:00")
    assert store.online("interactions") is None
    assert store.online("item_metadata").count() == 2
    asked = spark.createDataFrame([(1, "AE22NQ", "B07XJ8C8F5"), (2, "nobody", "B09K3M2P1Q")], "row int, user_id string, item_id string")
    rows = {r.row: r for r in store.get_online_features(asked, REFS).collect()}
    assert rows[1].user_review_count == 3 and rows[1].item_title == "Echo" and rows[1].item_avg_rating == 4.0
    assert rows[2].user_avg_rating is None and rows[2].item_title == "Book"

    spine = golden_reviews.select("user_id", F.col("parent_asin").alias("item_id"), "rating", F.lit("2021-03-05 00:00:00").cast("timestamp").alias("event_timestamp"))
    known = store.get_historical_features(spine, REFS)
    assert known.count() == 5 and known.filter("user_review_count IS NOT NULL").count() == 5
    early = spine.withColumn("event_timestamp", F.lit("2021-03-04 23:59:59").cast("timestamp"))
    assert store.get_historical_features(early, REFS).filter("user_review_count IS NOT NULL").count() == 0

    # the same window again replaces its rows
    store.materialize(None, "2022-01-01 00:00:00", ["user_features"])
    assert store.get_historical_features(spine, REFS).count() == 5
    assert spark.read.parquet(store.offline_path("user_features")).count() == 2


def test_time_window_is_half_open(store, spark):
    store.materialize("2021-01-19 00:00:00", "2021-02-19 00:00:00", ["interactions"])
    rows = spark.read.parquet(store.offline_path("interactions"))
    assert sorted(str(r.event_timestamp.date()) for r in rows.collect()) == ["2021-01-19", "2021-02-01"]


def test_incremental_recomputes_touched_keys_from_all_history(store, spark):
    store.materialize_incremental("2021-02-15 00:00:00", ["user_features", "interactions"])
    first = {r.user_id: r.user_review_count for r in store.online("user_features").collect()}
    assert first == {"AE22NQ": 2, "BKRMX7": 1}
    store.materialize_incremental("2021-02-25 00:00:00", ["user_features", "interactions"])
    second = {r.user_id: (r.user_review_count, r.user_avg_rating) for r in store.online("user_features").collect()}
    assert second == {"AE22NQ": (2, 4.5), "BKRMX7": (2, 4.0)}
    assert spark.read.parquet(store.offline_path("interactions")).count() == 4
    assert store.last_end("user_features").startswith("2021-02-25")


def folders(store, view):
    """Names of the files of each bucket."""
    found = files.glob(store.spark, f"{store.root}/online/{view}/bucket=*/*.parquet")
    return {b: {f for f in found if f"/bucket={b}/" in f} for b in {f.split("/bucket=")[1].split("/")[0] for f in found}}


def test_a_batch_rewrites_its_buckets_only(store, spark):
    view = store.registry.get("item_features")
    store.materialize(None, "2022-01-01 00:00:00", ["item_features"])
    before, rows = folders(store, "item_features"), store.online("item_features")
    n = rows.count()
    one = rows.filter("item_id = 'B07XJ8C8F5'").withColumn("event_timestamp", F.lit("2031-01-01").cast("timestamp"))
    store.upsert_online(view, one)
    after = folders(store, "item_features")
    assert sum(after[b] != before[b] for b in before) == 1 and set(after) == set(before)
    found = {r.item_id: r.event_timestamp.year for r in store.online("item_features").collect()}
    assert found.pop("B07XJ8C8F5") == 2031 and len(found) == n - 1 and 2031 not in found.values()
    store.upsert_online(view, one.limit(0))
    assert folders(store, "item_features") == after


def test_cells_given_twice_count_once(store, spark, golden_reviews):
    cells = Cells(
        ("user_id", "category"),
        lambda df: df.groupBy("user_id", "category").agg(F.count("*").alias("n"), F.max("event_timestamp").alias("last")),
        lambda c: c.groupBy("user_id").agg(F.sum("n").alias("n_reviews"), F.max("last").alias("event_timestamp")),
    )
    view = FeatureView(
        "review_counts", ("user_id",), timedelta(days=9), schemas.struct(n_reviews=T.LongType()), lambda s: golden_reviews,
        lambda df: cells.finish(cells.make(df)), offline=False, cells=cells,
    )
    store.apply([view])
    nameless = golden_reviews.withColumn("category", F.nullif("category", F.lit("Home_and_Kitchen")))
    for part, expected in (
        (nameless.filter("user_id = 'AE22NQ'"), {"AE22NQ": 3}),
        (nameless.filter("category IS NULL"), {"AE22NQ": 3}),
        (nameless, {"AE22NQ": 3, "BKRMX7": 2}),
    ):
        for _ in range(2):
            store.merge_cells(view, cells.make(part))
        assert {r.user_id: r.n_reviews for r in store.online("review_counts").collect()} == expected
    with pytest.raises(ValueError):
        store.merge_cells(store.registry.get("interactions"), golden_reviews)


def test_online_reads_heed_the_time_to_live(store, spark, golden_reviews):
    view = FeatureView(
        "short", ("user_id",), timedelta(days=9), schemas.struct(n=T.LongType()), lambda s: golden_reviews,
        lambda df: df.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_timestamp").alias("event_timestamp")), offline=False,
    )
    store.apply([view])
    store.materialize(None, None, ["short"])
    newest = {r[0]: r[1] for r in store.online("short").select("user_id", "event_timestamp").collect()}
    asked = golden_reviews.select("user_id").distinct()
    at = str(newest["AE22NQ"] + timedelta(days=9))

    def found(as_of):
        return {r.user_id: r.n for r in store.get_online_features(asked, ["short:n"], as_of).collect()}

    assert found(None) == {"AE22NQ": 3, "BKRMX7": 2}
    assert found(at) == {"AE22NQ": 3, "BKRMX7": None}
    assert found(str(newest["AE22NQ"] + timedelta(days=9, seconds=1))) == {"AE22NQ": None, "BKRMX7": None}


def test_upsert_prefers_newer_then_batch(spark):
    schema = "k string, v int, event_timestamp timestamp"

    def frame(rows):
        return spark.createDataFrame(rows, "k string, v int, t string").select("k", "v", F.col("t").cast("timestamp").alias("event_timestamp"))

    current = frame([("a", 1, "2024-01-02"), ("b", 1, "2024-01-02"), ("c", 1, "2024-01-02")])
    batch = frame([("a", 2, "2024-01-01"), ("b", 2, "2024-01-02"), ("d", 2, "2024-01-01"), ("d", 3, "2024-01-03")])
    assert {r.k: r.v for r in upsert(current, batch, ["k"]).collect()} == {"a": 1, "b": 2, "c": 1, "d": 3}
    assert upsert(spark.createDataFrame([], schema), batch, ["k"]).count() == 3


def test_retrieve_with_payload(store, spark):
    store.materialize(None, "2022-01-01 00:00:00", ["review_embeddings"])
    stored = store.online("review_embeddings")
    queries = stored.select(F.col("review_id").alias("qid"), "embedding")
    hits = store.retrieve(sim.Side(queries, "qid", "embedding"), "review_embeddings", "embedding", 2, ["item_id", "embed_text"])
    first = hits.filter("rank = 1").collect()
    assert len(first) == stored.count() == 4  # with its leading blank, one text is still too short
    assert all(r.qid == r.review_id and r.distance == pytest.approx(0, abs=1e-6) and r.embed_text for r in first)
    with pytest.raises(ValueError):
        store.retrieve(sim.Side(queries, "qid", "embedding"), "review_embeddings", "embedding", 2, metric="l2")


# --- streaming --------------------------------------------------------------------


@pytest.mark.parametrize("name", ["user_features", "item_features", "review_embeddings"])
def test_stream_materialize_equals_batch(store, spark, tmp_path, name):
    """Two batches give the rows of one; the files of the first are gone when the second comes."""
    raw = spark.createDataFrame(REVIEW_ROWS, REVIEW_SCHEMA).coalesce(1)
    view = store.registry.get(name)
    for nth, part in enumerate(("timestamp < 1612137600000", "timestamp >= 1612137600000", "false")):
        path = f"{tmp_path}/arriving/{nth}"
        raw.filter(part).write.parquet(path)
        arriving = stream.read_files(spark, f"{tmp_path}/arriving/*", raw.schema)
        stream.stream_materialize(store, view, src.to_review_events(arriving), f"{tmp_path}/ckpt").awaitTermination()
        if nth == 0 and name == "user_features":
            assert {r.user_id: r.user_review_count for r in store.online(name).collect()} == {"AE22NQ": 1, "BKRMX7": 1}
        files.delete_tree(spark, path)
    batch = view.compute(src.to_review_events(raw))
    assert sorted(map(str, store.online(name).collect())) == sorted(map(str, batch.collect()))


def test_views_without_cells_are_refused(store, spark, golden_reviews):
    with pytest.raises(ValueError):
        stream.stream_materialize(store, store.registry.get("item_metadata"), golden_reviews, "nowhere")


REQUESTS = """SELECT CAST(ts AS TIMESTAMP) AS ts, CASE event_type WHEN 'click' THEN 'rec' ELSE 'other' END AS service,
              round(value * 10, 3) AS latency_ms FROM {events}"""


@pytest.mark.parametrize("form", ["rate", "counts", "histogram"])
def test_windowed_stream_equals_batch(spark, tmp_path, form):
    """Every closed range of the stream has the rows of the batch form; a final late event closes them all."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    requests = spark.sql(REQUESTS, events=events)
    requests.orderBy("ts").coalesce(1).write.parquet(f"{tmp_path}/in")
    arriving = stream.read_files(spark, f"{tmp_path}/in", requests.schema)
    bounds = tm.LATENCY_MS
    if form == "rate":
        live = stream.rate_stream(arriving, "10 minutes", "1 minute", 60, "15 seconds", ["service"])
        batch = tm.rate_window(requests, "ts", "1 minute", 60, "15 seconds", ["service"])
    elif form == "counts":
        live = stream.counts_stream(arriving, "10 minutes", "1 minute", ["service"])
        batch = tm.counts_per_window(requests, "ts", "1 minute", ["service"])
    else:
        live = stream.histogram_stream(arriving, "10 minutes", "5 minutes", "latency_ms", bounds, ["service"])
        batch = tm.histogram_window(requests, "ts", "5 minutes", None, "latency_ms", bounds, ["service"])
    for _ in range(2):
        stream.append_to_table(live, f"{tmp_path}/out", f"{tmp_path}/ckpt").awaitTermination()
        late = [(None, "late", None)]
        end = spark.createDataFrame(late, requests.schema).withColumn("ts", F.lit("2030-01-01").cast("timestamp"))
        end.write.mode("append").parquet(f"{tmp_path}/in")
    written = spark.read.parquet(f"{tmp_path}/out").select(batch.columns).filter("service != 'late'")
    assert sorted(map(tuple, written.collect())) == sorted(map(tuple, batch.collect()))
