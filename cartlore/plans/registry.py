"""Feature views: definition, registration and checks."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import timedelta
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Transform = Callable[[DataFrame], DataFrame]
Source = Callable[[SparkSession], DataFrame]


@dataclass(frozen=True)
class Cells:
    """An aggregate in two steps, so that it can be kept up to date without its history.

    ``make`` aggregates source rows to cells by a plain ``groupBy`` on ``key``, the view's keys and maybe further columns; it runs on a stream as well.
    ``finish`` makes a view's row of all cells of its keys. Counts, sums, extremes and spreads need one cell per key; distinct
    counts and most frequent values take a cell per value.

    Where cells can be added up, ``rows`` makes the cells of each source row by itself, row-wise, and ``merge`` adds up those of the same key:
    ``merge(rows(df))`` is ``make(df)``. A stream then keeps no state beside the stored cells.
    """

    key: tuple[str, ...]
    make: Transform
    finish: Transform
    rows: Transform | None = None
    merge: Transform | None = None


@dataclass(frozen=True)
class FeatureView:
    """A named table of features: where its input comes from and how it is computed.

    ``schema`` lists the feature columns; keys and ``event_timestamp`` come on top.
    A ``row_wise`` view makes one row per source row; any other view aggregates
    its keys' whole history. ``source_keys`` names keys that the source calls
    differently. ``cells`` is the same aggregate for streams.
    """

    name: str
    keys: tuple[str, ...]
    ttl: timedelta
    schema: T.StructType
    source: Source
    transform: Transform
    online: bool = True
    offline: bool = True
    key_types: dict[str, T.DataType] = field(default_factory=dict)
    row_wise: bool = False
    source_keys: dict[str, str] = field(default_factory=dict)
    cells: Cells | None = None

    @property
    def features(self) -> list[str]:
        return self.schema.names

    def output_schema(self) -> T.StructType:
        keys = [T.StructField(k, self.key_types.get(k, T.StringType())) for k in self.keys]
        return T.StructType([*keys, *self.schema.fields, T.StructField("event_timestamp", T.TimestampType())])

    def conform(self, df: DataFrame) -> DataFrame:
        """Declared columns in declared order and type; missing ones are an error."""
        wanted = self.output_schema()
        missing = [f.name for f in wanted if f.name not in df.columns]
        if missing:
            raise ValueError(f"view {self.name!r} lacks columns {missing}")
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted])

    def compute(self, source: DataFrame) -> DataFrame:
        return self.conform(self.transform(source))

    def touched_by(self, source: DataFrame, fresh: DataFrame) -> DataFrame:
        """The view's rows that fresh source rows change.

        Means, spreads and distinct counts cannot be merged from earlier output,
        so an aggregate is computed again from all rows of the keys concerned.
        """
        if self.row_wise:
            return self.compute(fresh)
        columns = [self.source_keys.get(k, k) for k in self.keys]
        return self.compute(source.join(fresh.select(*columns).distinct(), columns, "left_semi"))


def feature_view(
    name: str,
    keys: list[str],
    ttl: timedelta,
    schema: T.StructType,
    source: Source,
    online: bool = True,
    offline: bool = True,
    **options,
) -> Callable[[Transform], FeatureView]:
    """Turn a DataFrame function into a view definition."""

    def wrap(transform: Transform) -> FeatureView:
        return FeatureView(name, tuple(keys), ttl, schema, source, transform, online, offline, **options)

    return wrap


class Registry:
    """Views known to a session. Registration checks the plan, it runs nothing on data."""

    def __init__(self) -> None:
        self._views: dict[str, FeatureView] = {}

    def apply(self, spark: SparkSession, views: list[FeatureView], delete: list[str] = ()) -> None:
        """Check and add or replace views; drop the named ones."""
        for view in views:
            planned = view.compute(view.source(spark)).schema
            if planned.names != view.output_schema().names:
                raise ValueError(f"view {view.name!r} plans {planned.names}")
        self._views.update({v.name: v for v in views})
        for name in delete:
            self._views.pop(name, None)

    def get(self, name: str) -> FeatureView:
        if name not in self._views:
            raise KeyError(f"no view named {name!r}")
        return self._views[name]

    def names(self) -> list[str]:
        return sorted(self._views)

    def check_refs(self, grouped: dict[str, list[str]]) -> None:
        for name, features in grouped.items():
            unknown = set(features) - set(self.get(name).features)
            if unknown:
                raise KeyError(f"view {name!r} has no features {sorted(unknown)}")

    def list_views(self, spark: SparkSession) -> DataFrame:
        rows = [
            (v.name, list(v.keys), len(v.features), int(v.ttl.total_seconds()), v.online, v.offline)
            for v in (self._views[n] for n in self.names())
        ]
        schema = "name string, keys array<string>, n_features int, ttl_seconds long, online boolean, offline boolean"
        return spark.createDataFrame(rows, schema)
