"""Equality joins: lookups, enrichment, coverage and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .features import display_fields

# --- fixed values -----------------------------------------------------------
ITEM_DISPLAY_REFS = [
    "item_metadata:item_title",
    "item_metadata:item_brand",
    "item_metadata:item_category",
    "item_features:item_avg_rating",
    "item_features:item_review_count",
    "item_features:item_rating_stddev",
    "item_features:item_total_helpful_votes",
    "item_metadata:item_price",
]
USER_PROFILE_REFS = [
    "user_features:user_avg_rating",
    "user_features:user_review_count",
    "user_features:user_primary_category",
    "user_features:user_tenure_days",
]
# -----------------------------------------------------------------------------


def resolve_refs(refs: list[str]) -> dict[str, list[str]]:
    """``view:feature`` names grouped by view, in the order given."""
    grouped: dict[str, list[str]] = {}
    for ref in refs:
        view, sep, feature = ref.partition(":")
        if not (sep and view and feature):
            raise ValueError(f"expected 'view:feature', got {ref!r}")
        grouped.setdefault(view, []).append(feature)
    return grouped


FEW_REQUESTS = 100_000


def online_lookup(
    entities: DataFrame, snapshots: list[tuple[DataFrame, list[str], list[str]]], few: int = FEW_REQUESTS
) -> DataFrame:
    """Latest features for each requested entity row; unknown keys give NULLs.

    ``snapshots`` lists (latest-per-key table, its keys, wanted features). Every
    table holds one row per key, so the number of request rows is unchanged.
    Up to ``few`` requests their keys are sent to the tables first, so that a
    large table is only filtered where it lies and never shuffled. The requests are computed once and stored, so that choice, filter and
    result see the same rows even if their plan would not repeat them.
    """
    entities = stored(entities, "requests")
    narrow = entities.count() <= few
    found = entities
    for table, keys, features in snapshots:
        rows = table.select(*keys, *features)
        if narrow:
            rows = rows.join(F.broadcast(entities.select(*keys).distinct()), keys, "left_semi")
        found = found.join(rows, keys, "left")
    return found


def enrich(results: DataFrame, metadata: DataFrame, features: DataFrame) -> DataFrame:
    """Display fields of recommended items."""
    wanted = {view: names for view, names in resolve_refs(ITEM_DISPLAY_REFS).items()}
    found = online_lookup(
        results,
        [
            (metadata, ["item_id"], wanted["item_metadata"]),
            (features, ["item_id"], wanted["item_features"]),
        ],
    )
    return display_fields(found)


def user_profile(users: DataFrame, user_features: DataFrame) -> DataFrame:
    wanted = resolve_refs(USER_PROFILE_REFS)["user_features"]
    found = online_lookup(users, [(user_features, ["user_id"], wanted)])
    return found.withColumnsRenamed({name: name.removeprefix("user_") for name in wanted})


def map_lookup(df: DataFrame, mapping: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """Value of a key in a mapping table, or the default."""
    joined = df.join(mapping.select(key, F.col(value).alias("_mapped")), key, "left")
    return joined.withColumn(value, F.coalesce("_mapped", F.lit(default))).drop("_mapped")


def attach_item_category(df: DataFrame, metadata: DataFrame) -> DataFrame:
    """Category of each row's item from a table with one row per item."""
    return df.join(metadata.select("item_id", "item_category"), "item_id", "left")


def covered_keys(keys: DataFrame, view: DataFrame, on: list[str]) -> DataFrame:
    """Keys that have a row in a view. The view's keys are made distinct first, map-side, so that a
    key filling much of the view arrives at the join once."""
    return keys.join(view.select(*on).distinct(), on, "left_semi")


def difference(expected: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """Rows of the first table whose key is not in the second."""
    return expected.join(found.select(*on).distinct(), on, "left_anti")


def union_distinct(*frames: DataFrame) -> DataFrame:
    merged = frames[0]
    for other in frames[1:]:
        merged = merged.unionByName(other)
    return merged.distinct()


def dedup_union(first: DataFrame, second: DataFrame, keys: list[str], text: str, rank: str, chars: int) -> DataFrame:
    """Results of two searches in order; of equal text beginnings the first one stays.

    Rows with an empty beginning are dropped, as the search never returns them.
    """
    from .ranking import first_per_key

    both = first.withColumn("search", F.lit(1)).unionByName(second.withColumn("search", F.lit(2)))
    begin = F.substring(F.coalesce(F.col(text), F.lit("")), 1, chars)
    keyed = both.withColumn("_begin", begin).filter(F.col("_begin") != "")
    return first_per_key(keyed, [*keys, "_begin"], ["search", rank]).drop("_begin")


def store_parity(online: DataFrame, offline: DataFrame) -> DataFrame:
    """Rows that occur more often in one table than in the other; no rows means both agree.

    One signed count per distinct row, combined map-side, replaces a pair of
    set differences.
    """
    columns = online.columns
    signed = online.withColumn("_sign", F.lit(1)).unionByName(offline.select(*columns).withColumn("_sign", F.lit(-1)))
    counts = signed.groupBy(*columns).agg(F.sum("_sign").alias("surplus"))
    return counts.filter(F.col("surplus") != 0)


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: rows, filled rows and their share, in one pass."""
    filled = [F.count(c).alias(c) for c in columns]
    totals = df.agg(F.count("*").alias("n_rows"), *filled)
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("n_filled")) for c in columns]))
    share: Column = F.try_divide(F.col("f.n_filled"), F.col("n_rows"))
    return totals.select("n_rows", long.alias("f")).select("f.feature", "n_rows", "f.n_filled", share.alias("share"))
