"""Structured Streaming forms of materialisation and of the request metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import telemetry
from ..plans.registry import FeatureView
from ..plans.store import FeatureStore


def read_files(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Stream over Parquet files as they appear in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def stream_materialize(store: FeatureStore, view: FeatureView, stream: DataFrame, checkpoint: str) -> StreamingQuery:
    """Keep a view's online rows up to date with newly arrived source rows, without reading earlier ones.

    A row-wise view computes the rows that have arrived. A view whose cells can be added up makes cells of the rows that have arrived and adds
    them to the stored ones under the checkpoint's name and the batch's number; no state is kept. Any other view with cells aggregates
    them as a stream, in update mode: its state holds the cells, and a batch brings the changed ones with their values so far. Both ways the
    rows of changed cells' keys are made from the stored cells, and a batch that runs again after a lost driver changes nothing.
    """
    if not view.row_wise and view.cells is None:
        raise ValueError(f"view {view.name!r} aggregates its keys' history and has no cells")
    adds = not view.row_wise and view.cells.merge is not None
    if view.row_wise:
        rows = stream
    else:
        rows = view.cells.rows(stream) if adds else view.cells.make(stream)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        if view.row_wise:
            store.upsert_online(view, view.transform(batch))
        elif adds:
            store.add_cells(view, view.cells.merge(batch), checkpoint, batch_id)
        else:
            store.merge_cells(view, batch)

    return (
        rows.writeStream.foreachBatch(write_batch)
        .outputMode("append" if view.row_wise or adds else "update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def rate_stream(
    requests: DataFrame, late: str, length: str, seconds: int, step: str | None, by: list[str], ts: str = "ts"
) -> DataFrame:
    """Per-second rates over event-time ranges; ranges close once the watermark has passed them."""
    return telemetry.rate_window(requests.withWatermark(ts, late), ts, length, seconds, step, by)


def counts_stream(requests: DataFrame, late: str, length: str, by: list[str], ts: str = "ts") -> DataFrame:
    return telemetry.counts_per_window(requests.withWatermark(ts, late), ts, length, by)


def histogram_stream(
    requests: DataFrame, late: str, length: str, value: str, bounds: list[float], by: list[str], ts: str = "ts"
) -> DataFrame:
    """Bucket counts per range. Quantiles are read from the written buckets, which stay mergeable."""
    marked = requests.withWatermark(ts, late)
    return telemetry.histogram_window(marked, ts, length, None, value, bounds, by)


def append_to_table(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Closed ranges as Parquet files, each written once."""
    return (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def replace_table(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All ranges so far, written anew after each batch. For dashboards over a bounded time span;
    the state keeps one row per range and series."""

    def write_batch(batch: DataFrame, _batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return (
        df.writeStream.foreachBatch(write_batch)
        .outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
