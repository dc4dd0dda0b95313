"""The five standard feature views over review and catalogue sources."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.encoders import Encoder, hashing_encoder
from ..operators import features as ops
from .registry import Cells, FeatureView, Source

LONG_TTL = timedelta(days=3650)
EMBEDDING_TTL = timedelta(days=90)


def with_embedding(rows: DataFrame, encoder: Encoder) -> DataFrame:
    return encoder(rows, "embed_text", "embedding")


def review_embeddings(reviews: DataFrame, encoder: Encoder | None = None) -> DataFrame:
    """Review rows with the unit vector of their text."""
    return with_embedding(ops.embedding_rows(reviews), encoder or hashing_encoder())


def standard_views(
    reviews: Source, catalog: Source, encoder: Encoder | None = None, as_of: str | None = None
) -> list[FeatureView]:
    """Definitions over two sources; ``as_of`` fixes the event time of aggregates."""

    def stamped(fn):
        return lambda df: ops.stamp(fn(df), as_of)

    return [
        FeatureView(
            "user_features",
            ("user_id",),
            LONG_TTL,
            schemas.USER_FEATURES,
            reviews,
            stamped(ops.user_features),
            cells=Cells(ops.USER_CELL, ops.user_cells, stamped(ops.users_of_cells), ops.user_cell_rows, ops.merge_user_cells),
        ),
        FeatureView(
            "item_features",
            ("item_id",),
            LONG_TTL,
            schemas.ITEM_FEATURES,
            reviews,
            stamped(ops.item_features),
            source_keys={"item_id": "parent_asin"},
            cells=Cells(("item_id",), ops.item_features, stamped(lambda df: df)),
        ),
        FeatureView(
            "item_metadata",
            ("item_id",),
            LONG_TTL,
            schemas.ITEM_METADATA,
            catalog,
            stamped(ops.item_metadata),
            source_keys={"item_id": "parent_asin"},
        ),
        FeatureView(
            "interactions",
            ("user_id", "item_id"),
            LONG_TTL,
            schemas.INTERACTIONS,
            reviews,
            ops.interactions,
            online=False,
            row_wise=True,
        ),
        FeatureView(
            "review_embeddings",
            ("review_id",),
            EMBEDDING_TTL,
            schemas.REVIEW_EMBEDDINGS,
            reviews,
            stamped(lambda df: review_embeddings(df, encoder)),
            offline=False,
            row_wise=True,
        ),
    ]


def window_filter(df: DataFrame, start: str | None, end: str | None, ts: str = "event_timestamp") -> DataFrame:
    """Rows with ``start <= ts < end``; the comparison is on the raw column, so it reaches the scan."""
    if start is not None:
        df = df.filter(F.col(ts) >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.filter(F.col(ts) < F.lit(end).cast("timestamp"))
    return df


def newer_than(df: DataFrame, mark: str | None, end: str | None, ts: str = "event_timestamp") -> DataFrame:
    """Rows after a high-water mark and before ``end``."""
    df = window_filter(df, None, end, ts)
    return df if mark is None else df.filter(F.col(ts) > F.lit(mark).cast("timestamp"))
