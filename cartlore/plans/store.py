"""Materialisation of feature views and the three ways to read them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import asof, similarity
from ..operators.lookups import online_lookup, resolve_refs
from ..operators.ranking import first_per_key, latest_per_key
from ..sources import files
from ..sources.reviews import union_all
from ..session import drop_stored, fine_tasks, stored
from ..sources.keyed import KeyedTable, Merge
from .registry import FeatureView, Registry
from .views import window_filter

RUNS = T.StructType(
    [
        T.StructField("view", T.StringType()), T.StructField("batch", T.StringType()), T.StructField("start_at", T.TimestampType()),
        T.StructField("end_at", T.TimestampType()), T.StructField("run_at", T.TimestampType()),
    ]
)
# which stream has added a stored cell, and up to which of its batches; no stream if it was given by its value
ADDED_BY = T.StructType([T.StructField("_run", T.StringType()), T.StructField("_batch", T.LongType())])
EPOCH = "1970-01-01 00:00:00"


def latest_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, the newest; equal times are decided by the feature values."""
    ties: list[Column | str] = [F.col(c).desc() for c in df.columns if c not in (*keys, "event_timestamp")]
    return latest_per_key(df, keys, "event_timestamp", ties)


def upsert(current: DataFrame | None, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Snapshot after a batch: the newest row of each key; at equal time the batch wins.

    The batch is cut to one row per key first, so a key that fills the batch
    arrives at the merge as a single row.
    """
    newest = latest_rows(batch, keys)
    if current is None:
        return newest
    both = current.withColumn("_new", F.lit(0)).unionByName(newest.withColumn("_new", F.lit(1)))
    return latest_per_key(both, keys, "event_timestamp", [F.col("_new").desc()]).drop("_new")


def _same(keys: tuple[str, ...]) -> Column:
    """Equal keys of the frames named c and k; nulls are equal."""
    return reduce(lambda a, b: a & b, (F.col(f"c.{k}").eqNullSafe(F.col(f"k.{k}")) for k in keys))


@dataclass
class FeatureStore:
    """Feature views on a folder that all executors reach.

    ``offline/<view>`` holds computed rows with their event time, ``online/<view>`` the latest row of each key, and ``cells/<view>`` the cells
    of views that streams keep up to date. The latter two lie in ``buckets`` folders by a hash of the key (``KeyedTable``).
    """

    spark: SparkSession
    root: str
    registry: Registry = field(default_factory=Registry)
    buckets: int = 64

    # --- definition -------------------------------------------------------------

    def apply(self, views: list[FeatureView], delete: list[str] = ()) -> None:
        self.registry.apply(self.spark, views, delete)

    def list_views(self) -> DataFrame:
        return self.registry.list_views(self.spark)

    # --- paths ---------------------------------------------------------------------

    def offline_path(self, view: str) -> str:
        return f"{self.root}/offline/{view}"

    def _online(self, view: str) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.root}/online/{view}", self.registry.get(view).keys, self.buckets)

    def _cells(self, view: FeatureView) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.root}/cells/{view.name}", view.keys, self.buckets)

    # --- writing -------------------------------------------------------------------

    def write_offline(self, view: FeatureView, df: DataFrame, batch: str) -> DataFrame:
        """One folder per batch, replaced when the batch runs again, so a repeated run adds no rows twice."""
        path = f"{self.offline_path(view.name)}/batch={batch}"
        with fine_tasks(self.spark):  # a view's aggregation may keep a row per source row
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(view.output_schema()).parquet(path)

    def online(self, view: str) -> DataFrame | None:
        """The latest row of each key; None if none was written."""
        table = self._online(view)
        return table.read(self.registry.get(view).output_schema()) if table.exists() else None

    def upsert_online(self, view: FeatureView, batch: DataFrame) -> None:
        """Of each key the newest row, of this batch and those before."""
        keys = list(view.keys)
        self._online(view.name).update(latest_rows(view.conform(batch), keys), lambda old, new: upsert(old, new, keys))

    def merge_cells(self, view: FeatureView, changed: DataFrame) -> None:
        """Take in cells as they are now, and show what comes out of them for their keys; source rows are not read.

        A cell replaces the one with the same key, so the same cells given again change nothing.
        """
        cells = view.cells
        if cells is None:
            raise ValueError(f"view {view.name!r} has no cells")
        if cells.key == view.keys and cells.merge is None:
            self.upsert_online(view, cells.finish(changed))
            return

        def replace(old: DataFrame, new: DataFrame) -> DataFrame:
            both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
            if cells.merge is None:
                return first_per_key(both, list(cells.key), [F.col("_new").desc()]).drop("_new")
            # a cell that a stream adds to may lie in two rows
            newest = F.max("_new").over(Window.partitionBy(*cells.key))
            return both.withColumn("_newest", newest).filter("_new = _newest").drop("_new", "_newest")

        if cells.merge is not None:
            changed = changed.withColumns({f.name: F.lit(None).cast(f.dataType) for f in ADDED_BY})
        self._take_in(view, changed, replace)

    def add_cells(self, view: FeatureView, fresh: DataFrame, run: str, batch: int) -> None:
        """Take in the cells of source rows that came as batch number ``batch`` (from 0) of the stream ``run``.

        What the stream has added to a cell before lies in one row, what its last batch has added in another, so a batch that is given again
        replaces its rows and changes nothing. Cells of other streams are replaced when this one has the same cell, and so are cells given
        by their value (``merge_cells``) when a stream starts; a stream that has started adds to the latter.
        """
        cells = view.cells
        if cells is None or cells.merge is None:
            raise ValueError(f"view {view.name!r} has no cells that can be added up")

        first = not self._cells(view).exists()

        def labelled(df: DataFrame, nth: int) -> DataFrame:
            return df.withColumns({"_run": F.lit(run), "_batch": F.lit(nth).cast("long")})

        def add(old: DataFrame, new: DataFrame) -> DataFrame:
            if first:
                return new
            mine = F.col("_run").eqNullSafe(F.lit(run))
            if batch > 0:
                mine |= F.col("_run").isNull()
            settled = old.filter(mine & (F.coalesce("_batch", F.lit(-1)) < batch))
            both = labelled(cells.merge(settled), batch - 1).unionByName(new)
            others = old.filter(~mine)
            if others.isEmpty():
                return both
            return both.unionByName(others.alias("c").join(both.alias("k"), _same(cells.key), "left_anti"))

        self._take_in(view, labelled(fresh, batch), add)

    def _take_in(self, view: FeatureView, changed: DataFrame, merge: Merge) -> None:
        """Bring changed cells into the stored ones, and what comes out of these for their keys into the online rows."""
        cells, table = view.cells, self._cells(view)
        changed = stored(changed, "cells")
        touched = table.update(changed, merge, is_table=True)
        keys = changed.select(*view.keys).distinct()
        own = table.read(changed.schema, touched).alias("c").join(keys.alias("k"), _same(view.keys), "left_semi")
        self.upsert_online(view, cells.finish(own if cells.merge is None else cells.merge(own)))
        drop_stored(changed)

    def _sink(self, view: FeatureView, features: DataFrame, batch: str) -> None:
        """To each wanted sink. The written offline batch feeds the online snapshot,
        so a view that goes to both is computed once."""
        if view.offline:
            features = self.write_offline(view, features, batch)
        if view.online:
            self.upsert_online(view, features)

    def materialize(self, start: str | None, end: str | None, views: list[str] | None = None) -> None:
        """Compute views over source rows with ``start <= event_timestamp < end`` and write them.

        A window that overlaps earlier ones replaces their rows of its time (see ``offline``); the next incremental run goes on from
        the latest end of all runs.
        """
        for name in views or self.registry.names():
            view = self.registry.get(name)
            source = window_filter(view.source(self.spark), start, end)
            self._sink(view, view.compute(source), batch_name(start, end))
            self._record(name, start, end)

    # --- incremental ----------------------------------------------------------------

    def _runs_path(self) -> str:
        return f"{self.root}/marks"

    def _record(self, view: str, start: str | None, end: str | None) -> None:
        row = self.spark.createDataFrame([(view, batch_name(start, end), start, end)], "view string, batch string, start_at string, end_at string")
        times = {c: F.col(c).cast("timestamp") for c in ("start_at", "end_at")}
        row.withColumns(times).withColumn("run_at", F.current_timestamp()).write.mode("append").parquet(self._runs_path())

    def _runs(self, view: str) -> DataFrame:
        if not files.exists(self.spark, self._runs_path()):
            return self.spark.createDataFrame([], RUNS)
        return self.spark.read.schema(RUNS).parquet(self._runs_path()).filter(F.col("view") == view)

    def last_end(self, view: str) -> str:
        newest = self._runs(view).agg(F.date_format(F.max("end_at"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]
        return newest or EPOCH

    def materialize_incremental(self, end: str, views: list[str] | None = None, lateness: timedelta = timedelta(0)) -> None:
        """Write what came in since the last run, per view.

        Rows that arrive with a time before the last run's end are found up to ``lateness`` back: that stretch is read again and
        replaces what was written for it. Rows later than that need ``materialize`` for their time.
        """
        for name in views or self.registry.names():
            view = self.registry.get(name)
            last = self.last_end(name)
            start = last
            if lateness and last != EPOCH:
                start = str(datetime.fromisoformat(last) - lateness)
            source = window_filter(view.source(self.spark), None, end)
            fresh = window_filter(source, start, end)
            self._sink(view, view.touched_by(source, fresh), batch_name(start, end))
            self._record(name, start, end)

    # --- reading -------------------------------------------------------------------------

    def offline(self, name: str) -> DataFrame:
        """A view's offline rows, each once, whatever windows were run.

        What a later run wrote replaces earlier rows: of a row-wise view all rows of its time window, of an aggregate
        the rows with the same keys and time. Only runs that a later one overlaps are filtered.
        """
        view = self.registry.get(name)
        latest = self._runs(name).groupBy("batch", "start_at", "end_at").agg(F.max("run_at").alias("run_at"))
        runs = latest.orderBy("run_at").collect()  # a row per batch
        schema, base = view.output_schema(), self.offline_path(name)

        def read(batches: list[str]) -> DataFrame:
            return self.spark.read.schema(schema).parquet(*[f"{base}/batch={b}" for b in batches]).select(schema.names)

        def overlap(a, b) -> bool:
            return (a.start_at is None or b.end_at is None or a.start_at < b.end_at) and (
                b.start_at is None or a.end_at is None or b.start_at < a.end_at
            )

        replaced = {i: [b for b in runs[i + 1 :] if overlap(a, b)] for i, a in enumerate(runs)}
        free = [runs[i].batch for i, later in replaced.items() if not later]
        parts = [read(free)] if free else []
        order = [F.lit(0)] if free else []
        for i, later in replaced.items():
            if later:
                rows = read([runs[i].batch])
                if view.row_wise:
                    for b in later:
                        inside = F.lit(True)
                        if b.start_at is not None:
                            inside &= F.col("event_timestamp") >= F.lit(b.start_at)
                        if b.end_at is not None:
                            inside &= F.col("event_timestamp") < F.lit(b.end_at)
                        rows = rows.filter(~inside)
                parts.append(rows)
                order.append(F.lit(len(runs) - i))
        if not parts:
            return self.spark.createDataFrame([], schema)
        if view.row_wise or len(parts) == 1:
            return union_all(*parts)
        aged = union_all(*(p.withColumn("_age", o) for p, o in zip(parts, order)))
        return first_per_key(aged, [*view.keys, "event_timestamp"], ["_age"]).drop("_age")

    def get_historical_features(
        self, spine: DataFrame, refs: list[str], with_ttl: bool = True, **options
    ) -> DataFrame:
        """Spine rows with the features known at their time."""
        grouped = resolve_refs(refs)
        self.registry.check_refs(grouped)
        views = []
        for name, columns in grouped.items():
            view = self.registry.get(name)
            ttl = int(view.ttl.total_seconds()) if with_ttl else None
            wanted = {c: c for c in columns}
            views.append(asof.AsOfView(name, self.offline(name), view.keys, "event_timestamp", wanted, ttl, is_table=True))
        return asof.asof_join(spine, views, **options)

    def get_online_features(self, entities: DataFrame, refs: list[str], as_of: str | None = None) -> DataFrame:
        """Request rows with the latest features; unknown keys give NULLs.

        At an instant ``as_of`` so do keys whose features are older than their view's time-to-live then (exactly as old is kept, as in
        historical reads). Without one nothing expires: what "now" is belongs to the request, not to the table.
        """
        grouped = resolve_refs(refs)
        self.registry.check_refs(grouped)
        tables = []
        for name, columns in grouped.items():
            view = self.registry.get(name)
            rows = self._corpus(name)
            if as_of is not None:
                oldest = F.lit(as_of).cast("timestamp") - F.make_dt_interval(secs=F.lit(view.ttl.total_seconds()))
                rows = rows.filter(F.col("event_timestamp") >= oldest)
            tables.append((rows, list(view.keys), columns))
        return online_lookup(entities, tables)

    def _corpus(self, view: str) -> DataFrame:
        table = self.online(view)
        return self.spark.createDataFrame([], self.registry.get(view).output_schema()) if table is None else table

    def _index_path(self, view: str) -> str:
        return f"{self.root}/index/{view}"

    def index_vectors(self, view: str, vec: str, nlist: int, **options) -> None:
        """Build and store a cell index over a view's snapshot, for ``retrieve`` with ``nprobe``."""
        side = similarity.Side(self._corpus(view), self.registry.get(view).keys[0], vec)
        similarity.write_vectors(similarity.build_ivf(side, nlist, **options), self._index_path(view))

    def retrieve(
        self, queries: similarity.Side, view: str, vec: str, k: int, payload: list[str] = (), metric: str = "cosine",
        nprobe: int | None = None,
    ) -> DataFrame:
        """The k nearest stored rows for each query vector, with payload columns.

        With ``nprobe`` the stored index is searched, else the whole snapshot. A view without snapshot has no rows.
        """
        if metric.lower() != "cosine":
            raise ValueError("only the cosine metric is stored")
        if nprobe is not None:
            index = similarity.read_vectors(self.spark, self._index_path(view))
            return similarity.search_ivf(queries, index, nprobe, k, list(payload))
        corpus = similarity.Side(self._corpus(view), self.registry.get(view).keys[0], vec)
        return similarity.vector_topk(queries, corpus, k, list(payload))


def batch_name(start: str | None, end: str | None) -> str:
    """Folder name of a time window."""
    return re.sub(r"[^0-9A-Za-z]+", "-", f"{start or 'begin'}_{end or 'open'}")
