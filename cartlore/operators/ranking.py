"""First rows per group, also for groups that hold a large share of all rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .indexing import global_index

# Spark cuts each map task to the first k rows per group before the shuffle up
# to this k (spark.sql.optimizer.windowGroupLimitThreshold).
MAP_SIDE_LIMIT = 1_000
SALTS = (4_096, 64)


def top_n(
    df: DataFrame, keys: list[str], order: list[Column | str], n: int, rank_col: str | None = None
) -> DataFrame:
    """The first ``n`` rows of each group in the given total order.

    Small ``n``: ``row_number() <= n`` is cut map-side, so a hot group reaches
    the reducer as at most ``n`` rows per map task. Large ``n``: the group is split by salt and cut in two rounds first, so
    no task sees all of it. The salt hashes the row and its task,
    which a repeated task gives again; equal rows of different tasks are split too.
    """
    name = rank_col or "_rank"
    if n > MAP_SIDE_LIMIT:
        hashable = [c for c, kind in df.dtypes if "map<" not in kind]
        for salts in SALTS:
            salt = F.pmod(F.xxhash64(*hashable, F.spark_partition_id()), F.lit(salts))
            window = Window.partitionBy(*keys, "_salt").orderBy(*order)
            ranked = df.withColumn("_salt", salt).withColumn(name, F.row_number().over(window))
            df = ranked.filter(F.col(name) <= n).drop(name, "_salt")
    window = Window.partitionBy(*keys).orderBy(*order)
    cut = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= n)
    return cut if rank_col else cut.drop(name)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    return top_n(df, keys, order, 1)


def latest_per_key(df: DataFrame, keys: list[str], ts: str, tie: list[Column | str] = ()) -> DataFrame:
    """Newest row of each key; ``tie`` decides between rows of equal time."""
    return first_per_key(df, keys, [F.col(ts).desc(), *tie])


def cap_per_group(df: DataFrame, key: str, n: int, order: list[Column | str]) -> DataFrame:
    """Sample mode of the ingest: the first ``n`` rows of every group."""
    return top_n(df, [key], order, n)


def rank_results(df: DataFrame, keys: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The ``n`` best results per request with their 1-based ``rank``."""
    return top_n(df, keys, order, n, "rank")


ROWS_PER_RUN = 1 << 16


def limit_rows(df: DataFrame, n: int) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer), the same ones each time: the first ones by file name and place in the file.

    No task receives more than it reads itself. For a scan, with or without filters and projections, rows are counted per file, per run of 65 536
    rows of the file in which the quota ends, and per row of one such run; files behind the cut are pruned, and
    each task keeps the rows before it. Any other input is written first, cut to ``n`` rows in each task.
    """
    if n <= 0:
        return df.filter(F.lit(False))
    try:
        placed = df.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"))
    except AnalysisException:
        return _stored_limit(df, n)
    before = 0

    def cut(counts: DataFrame) -> tuple | None:
        """The value at which the quota ends and its rows; ``before`` grows by the rows of those in front of it."""
        nonlocal before
        for value, rows in sorted(counts.collect()):
            if before + rows >= n:
                return value, rows
            before += rows
        return None

    file = cut(placed.groupBy("f").count())  # a row per file
    if file is None:
        return df
    inside = placed.filter(F.col("f") == file[0])
    run = cut(inside.groupBy(F.floor(F.col("i") / ROWS_PER_RUN)).count())  # a row per run of one file
    last = cut(inside.filter(F.floor(F.col("i") / ROWS_PER_RUN) == run[0]).groupBy("i").count())  # at most 65 536 rows
    if before + last[1] != n:
        return _stored_limit(df, n)  # a row of the file became several, of which some are wanted
    name, place = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    return df.filter((name <= file[0]) & ((name < file[0]) | (place <= last[0])))


def _stored_limit(df: DataFrame, n: int) -> DataFrame:
    nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # in its task
    return limit_rows(stored(df.filter(nth < n), "limited"), n)


def first_rows(df: DataFrame, n: int, order: list[Column | str]) -> DataFrame:
    """The first ``n`` rows of a total order, sorted by ranges; unlike a sorted limit, no task takes in the first rows of all others."""
    name = "_position"
    while name in df.columns:
        name += "_"
    return global_index(df, order, name).filter(F.col(name) < n).drop(name)
