"""Request metrics: counters, bucket histograms, quantiles and range functions.

Everything here is a plain aggregation, so the windowed forms run on a batch
table and on a stream alike (see ``streaming``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: upper bucket bounds of the three services (seconds, items, tokens) ---
RECOMMEND_SECONDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5]
CANDIDATES_SCORED = [10, 25, 50, 100, 200, 500]
QUANTILES = [0.5, 0.95, 0.99]
# -----------------------------------------------------------------------------
LATENCY_MS = [s * 1000 for s in RECOMMEND_SECONDS]


def request_counter(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n_requests"))


def latency_stats(df: DataFrame, by: str = "service", value: str = "latency_ms") -> DataFrame:
    """Requests and mean, best and worst latency per service, and a row ``all`` over everything."""
    stats = df.rollup(by).agg(
        F.count("*").alias("total"),
        F.avg(value).alias("avg_ms"),
        F.min(value).alias("best_ms"),
        F.max(value).alias("worst_ms"),
        F.grouping(by).alias("_all"),
    )
    return stats.withColumn(by, F.when(F.col("_all") == 1, "all").otherwise(F.col(by))).drop("_all")


def _bucket_counts(value: Column, bounds: list[float]) -> list[Column]:
    """One counter per bound; each counts the values up to it, as cumulative buckets do."""
    return [F.count_if(value <= b).alias(f"_le_{i}") for i, b in enumerate(bounds)]


def _unpivot(bounds: list[float]) -> Column:
    cells = [
        F.struct(F.lit(float(b)).alias("le"), F.col(f"_le_{i}").alias("cumulative")) for i, b in enumerate(bounds)
    ]
    last = F.struct(F.lit(float("inf")).alias("le"), F.col("n_values").alias("cumulative"))
    return F.explode(F.array(*cells, last))


def histogram(df: DataFrame, value: str, bounds: list[float], by: list[str | Column]) -> DataFrame:
    """Cumulative buckets (``le`` up to infinity) with the sum and count of the values, per group.

    One map-side combined aggregation; the bounds become columns first and rows
    afterwards, on the aggregated result.
    """
    col = F.col(value)
    wide = df.groupBy(*by).agg(
        F.count(col).alias("n_values"), F.sum(col).alias("value_sum"), *_bucket_counts(col, bounds)
    )
    names = [c for c in wide.columns if not c.startswith("_le_")]
    long = wide.select(*names, _unpivot(bounds).alias("_cell"))
    return long.select(*names, "_cell.le", "_cell.cumulative")


def _bucket_arrays(hist: DataFrame, by: list[str]) -> DataFrame:
    """One short sorted array of buckets per group."""
    cells = F.array_sort(F.collect_list(F.struct("le", "cumulative")))
    return hist.groupBy(*by).agg(cells.alias("_b"), F.max("cumulative").alias("_n"))


def _quantile(q: float) -> Column:
    """Quantile from the bucket array, linear inside the bucket that holds it.

    The lowest bucket starts at 0; a quantile in the open last bucket gives the
    highest finite bound.
    """
    target = F.lit(float(q)) * F.col("_n")
    at = F.size(F.filter("_b", lambda c: c["cumulative"] < target))  # 0-based bucket holding the target
    here = F.get("_b", at)
    lower = F.when(at > 0, F.get("_b", at - 1)["le"]).otherwise(F.lit(0.0))
    below = F.when(at > 0, F.get("_b", at - 1)["cumulative"].cast("double")).otherwise(F.lit(0.0))
    inside = F.nullif(here["cumulative"] - below, F.lit(0.0))
    part = F.coalesce((target - below) / inside, F.lit(0.0))
    linear = lower + (here["le"] - lower) * part
    return F.when(F.col("_n") > 0, F.when(here["le"] == float("inf"), lower).otherwise(linear))


def histogram_quantile(hist: DataFrame, q: float, by: list[str]) -> DataFrame:
    return _bucket_arrays(hist, by).select(*by, F.lit(float(q)).alias("q"), _quantile(q).alias("value"))


def quantiles(hist: DataFrame, qs: list[float], by: list[str]) -> DataFrame:
    """Several quantiles of the same buckets, as columns p50, p95, ..."""
    return _bucket_arrays(hist, by).select(*by, *[_quantile(q).alias(f"p{round(q * 100)}") for q in qs])


def ratio(df: DataFrame, numerator: Column, denominator: Column, by: list[str], name: str = "ratio") -> DataFrame:
    """Sum over sum, NULL where the denominator adds up to zero."""
    grouped = df.groupBy(*by) if by else df.groupBy()
    return grouped.agg(F.try_divide(F.sum(numerator).cast("double"), F.sum(denominator)).alias(name))


def latest_gauge(df: DataFrame, by: list[str], value: str, ts: str, tie: str | None = None) -> DataFrame:
    """Newest value per series; ``max_by`` combines map-side, no series is sorted."""
    newest = F.struct(ts, tie) if tie else F.col(ts)
    return df.groupBy(*by).agg(F.max_by(value, newest).alias(value))


def sum_by(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.sum(value).alias(value))


def count_or_zero(df: DataFrame, condition: Column) -> DataFrame:
    """Number of matching rows, 0 instead of nothing when there are none."""
    return df.agg(F.count_if(condition).alias("n"))


def sum_or_zero(df: DataFrame, value: Column, name: str = "total") -> DataFrame:
    return df.agg(F.coalesce(F.sum(value), F.lit(0).cast("double")).alias(name))


# --- range functions ----------------------------------------------------------------


def _ranges(ts: str, length: str, step: str | None) -> Column:
    return F.window(F.col(ts), length, step) if step else F.window(F.col(ts), length)


def rate_window(df: DataFrame, ts: str, length: str, seconds: int, step: str | None, by: list[str]) -> DataFrame:
    """Events per second over ranges of ``length``, one range every ``step``."""
    counted = df.groupBy(_ranges(ts, length, step).alias("w"), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), *by, "n", (F.col("n") / F.lit(seconds)).alias("rate"))


def counts_per_window(df: DataFrame, ts: str, length: str, by: list[str]) -> DataFrame:
    counted = df.groupBy(_ranges(ts, length, None).alias("w"), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), *by, "n")


def histogram_window(
    df: DataFrame, ts: str, length: str, step: str | None, value: str, bounds: list[float], by: list[str]
) -> DataFrame:
    """Cumulative buckets per range; the size of the state does not grow with the requests."""
    hist = histogram(df, value, bounds, [_ranges(ts, length, step).alias("w"), *by])
    return hist.withColumn("start", F.col("w.start")).drop("w")


def latency_quantiles(
    df: DataFrame, ts: str, length: str, value: str, bounds: list[float], by: list[str], qs: list[float] = QUANTILES
) -> DataFrame:
    """Quantiles per range from bucket counts."""
    hist = histogram_window(df, ts, length, None, value, bounds, by)
    return quantiles(hist, qs, ["start", *by])


def counter_increase(df: DataFrame, series: list[str], ts: str, value: str, length: str, seconds: int) -> DataFrame:
    """Growth of a cumulative counter per range, and per second.

    A value below its predecessor means the counter restarted, so the new value
    is the growth. Steps are taken inside each (series, range) first; the step
    into a range needs only the last value of the series' previous range, one
    row per range, so a long series is never sorted in one piece.
    """
    placed = df.select(*series, F.col(ts).alias("_t"), F.col(value).alias("_v"), F.window(ts, length).start.alias("start"))
    group = [*series, "start"]

    def growth(new: Column, old: Column) -> Column:
        return F.when(old.isNull(), F.lit(0.0)).when(new < old, new).otherwise(new - old)

    previous = F.lag("_v").over(Window.partitionBy(*group).orderBy("_t", "_v"))
    steps = placed.withColumn("_step", growth(F.col("_v"), previous))
    at = F.struct("_t", "_v")
    per_range = steps.groupBy(*group).agg(
        F.sum("_step").alias("_inside"), F.min_by("_v", at).alias("_first"), F.max_by("_v", at).alias("_last")
    )
    before = F.lag("_last").over(Window.partitionBy(*series).orderBy("start"))
    total = F.col("_inside") + growth(F.col("_first"), before)
    return per_range.select(*group, total.alias("increase"), (total / F.lit(seconds)).alias("per_second"))


def counter_rate_by(
    df: DataFrame, series: list[str], by: list[str], ts: str, value: str, length: str, seconds: int
) -> DataFrame:
    """Per-second growth of counters per range, summed over the series of each group (``by`` is part of ``series``)."""
    grown = counter_increase(df, series, ts, value, length, seconds)
    return grown.groupBy(*by, "start").agg(F.sum("per_second").alias("rate"))


def counter_bucket_quantiles(
    df: DataFrame, series: list[str], by: list[str], le: str, ts: str, value: str, length: str, qs: list[float] = QUANTILES
) -> DataFrame:
    """Quantiles per range from scraped bucket counters.

    Each (series, bucket) counter's growth, restarts included, is summed over the series of a group (``by`` is part
    of ``series``); the sums are the cumulative buckets of the range.
    """
    grown = counter_increase(df.withColumnRenamed(le, "le"), [*series, "le"], ts, value, length, 1)
    hist = grown.groupBy("start", *by, "le").agg(F.sum("increase").alias("cumulative"))
    return quantiles(hist, qs, ["start", *by])


# --- evaluation grids ------------------------------------------------------------------

LOOKBACK = 300  # seconds for which a sample stands if no newer one comes


def _points(first: Column, until: Column, step: int, start: str, end: str) -> Column:
    """Grid points (seconds) from ``first`` on and before ``until``, inside the evaluated range; both ends of it count."""
    low = F.greatest(first, F.unix_timestamp(F.lit(start).cast("timestamp")))
    high = F.least(until, F.unix_timestamp(F.lit(end).cast("timestamp")) + step)
    # the range starts at a grid point, so all points are whole steps from it
    return F.filter(F.sequence(low, F.greatest(low, high - 1), F.lit(step).cast("long")), lambda p: p < high)


def _slot(ts: str, step: int, start: str) -> Column:
    """The first grid point at or after a sample, in seconds."""
    origin = F.unix_timestamp(F.lit(start).cast("timestamp"))
    micros = F.unix_micros(ts) - origin * 1_000_000
    return (origin + F.ceil(micros / (step * 1_000_000.0)) * step).cast("long")


def gauge_on_grid(
    df: DataFrame, by: list[str], value: str, ts: str, step: int, start: str, end: str, tie: str | None = None,
    lookback: int = LOOKBACK,
) -> DataFrame:
    """(by, at, value) of each series at ``start``, ``start`` + ``step`` and so on to ``end``: its newest sample younger than ``lookback`` seconds.

    Where a series has none it has no row: gaps stay gaps. Samples are cut to the newest one per step before they are
    handed to the grid points behind them, so rows are made per step with samples, not per sample and point, and no
    series is sorted or gathered in one task.
    """
    age = F.struct(ts, tie) if tie else F.struct(ts)
    near = df.filter(F.col(ts).isNotNull() & (F.col(ts) <= F.lit(end).cast("timestamp")))
    newest = near.groupBy(*by, _slot(ts, step, start).alias("_slot")).agg(F.max_by(value, age).alias("_v"), F.max(age).alias("_age"))
    until = F.ceil(F.unix_micros(f"_age.{ts}") / 1_000_000.0 + lookback).cast("long")
    spread = newest.select(*by, "_v", "_age", F.explode(_points(F.col("_slot"), until, step, start, end)).alias("_at"))
    return spread.groupBy(*by, F.timestamp_seconds("_at").alias("at")).agg(F.max_by("_v", "_age").alias(value))


def rate_on_grid(
    df: DataFrame, series: list[str], ts: str, value: str, step: int, length: int, start: str, end: str
) -> DataFrame:
    """(series, at, increase, rate): per-second growth of a counter over the ``length`` seconds up to each grid point, that point included.

    ``length`` is a whole number of steps. Growth is taken per step, restarts and steps across borders as in ``counter_increase``, and added up
    for the points it belongs to. A point without a sample in its range has no row.
    """
    if length % step:
        raise ValueError(f"{length} seconds are no whole number of steps of {step}")
    origin = F.unix_timestamp(F.lit(start).cast("timestamp"))
    # ranges are closed on the right, windows on the left
    moved = df.withColumn(ts, F.timestamp_micros(F.unix_micros(ts) - origin * 1_000_000 - 1))
    grown = counter_increase(moved.filter(F.col(ts).isNotNull()), series, ts, value, f"{step} seconds", step)
    first = F.unix_timestamp("start") + origin + step
    spread = grown.select(*series, "increase", F.explode(_points(first, first + length, step, start, end)).alias("_at"))
    total = F.sum("increase")
    return spread.groupBy(*series, F.timestamp_seconds("_at").alias("at")).agg(
        total.alias("increase"), (total / F.lit(length)).alias("rate")
    )
