"""Column expressions that clean raw review and catalogue values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "None"  # how a missing text value is spelled in ingested files
MS_PER_DAY = 86_400_000


def to_event_ts(epoch_ms: Column) -> Column:
    """Epoch milliseconds to timestamp, keeping the milliseconds."""
    return F.timestamp_millis(epoch_ms.cast("long"))


def positive_rating(rating: Column) -> Column:
    """True for usable ratings; NULL and zero ratings do not pass a filter."""
    return rating > 0


def binary_label(rating: Column) -> Column:
    """1.0 from four stars upwards, otherwise 0.0, also for a missing rating."""
    return F.when(rating >= 4, F.lit(1.0)).otherwise(F.lit(0.0))


def category_or_default(category: Column, default: str) -> Column:
    """Replace the missing marker and the empty text; a NULL stays NULL."""
    return F.when(category.isin(MISSING, ""), F.lit(default)).otherwise(category)


def missing_to_null(value: Column) -> Column:
    return F.nullif(value.cast("string"), F.lit(MISSING))


def safe_float(value: Column) -> Column:
    """Text to FLOAT; anything unreadable becomes NULL instead of failing the job."""
    return value.try_cast("float")


def safe_int(value: Column) -> Column:
    return value.try_cast("int")


def tenure_days(first_ms: Column, last_ms: Column) -> Column:
    """Whole days between two epoch-ms instants, cut towards zero."""
    return ((last_ms - first_ms) / F.lit(MS_PER_DAY)).cast("int").cast("long")


def text_or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def zero_to_null(value: Column) -> Column:
    return F.when(value != 0, value)


def shown_price(price: Column) -> Column:
    """Price on two digits; zero and missing prices are not shown."""
    return F.round(zero_to_null(price.cast("double")), 2)


def stringify(name: str, simple_types: dict[str, str]) -> Column:
    """Text form of one column: JSON for nested values, the marker for NULL."""
    kind = simple_types[name]
    nested = kind.startswith(("array", "struct", "map"))
    text = F.to_json(F.col(name)) if nested else F.col(name).cast("string")
    return F.coalesce(text, F.lit(MISSING)).alias(name)
