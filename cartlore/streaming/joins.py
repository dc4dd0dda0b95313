"""Joins of two streams by key and time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interval_join_stream(
    left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, lower_seconds: int, upper_seconds: int,
    left_late: str, right_late: str,
) -> DataFrame:
    """All pairs with equal keys and ``left + lower <= right <= left + upper``, the rows of ``asof.interval_join``, each written once.

    A pair is written as soon as both rows are there. The condition on the two times bounds the state: once the other side's watermark has passed
    the last time that a row could meet, the row goes. Rows behind their own side's watermark are dropped. As in the batch form the
    join also runs on ranges of time, so the state of one key is spread over tasks. Both times are timestamps with time zone.
    """
    width = max(upper_seconds - lower_seconds, 1) * 1_000_000

    def range_of(micros: Column) -> Column:
        return F.floor(micros / F.lit(width)).cast("long")

    def shifted(seconds: int) -> Column:
        return F.unix_micros(left_ts) + seconds * 1_000_000

    visits = left.withWatermark(left_ts, left_late).withColumn(
        "_slot", F.explode(F.sequence(range_of(shifted(lower_seconds)), range_of(shifted(upper_seconds))))
    )
    placed = right.withWatermark(right_ts, right_late).withColumn("_place", range_of(F.unix_micros(right_ts)))
    placed = placed.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"_right_{k}") for k in keys), F.col("_slot") == F.col("_place"))

    def later(seconds: int) -> Column:
        return F.col(left_ts) + F.make_dt_interval(secs=F.lit(seconds))

    near = (F.col(right_ts) >= later(lower_seconds)) & (F.col(right_ts) <= later(upper_seconds))
    return visits.join(placed, same & near).drop("_slot", "_place", *(f"_right_{k}" for k in keys))
