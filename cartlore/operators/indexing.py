"""Dense ids, hash buckets, shuffles and splits."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import brief_shuffles, ensure_checkpoint_dir, shuffle_partitions, stored

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def md5_int(text: Column) -> Column:
    """The first 60 bits of an MD5 as a number; repeatable on any engine, and even over any number of ids."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def md5_bucket(text: Column, n: Column | int) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    return F.pmod(md5_int(text), n.cast("long"))


def global_index(df: DataFrame, order: list[Column | str], index_col: str = "idx", packed: bool = False) -> DataFrame:
    """Dense 0-based position of every row in a total order, without a single-task window.

    Rows are range partitioned and sorted, each keeps its partition and its
    place in it, and the partition sizes (one number per partition) turn into
    offsets. The sorted rows are checkpointed once, so that the sizes and the
    result are taken from the same layout even if executors are lost between;
    ``packed`` ones are stored as Parquet, which must be able to hold their columns.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    parts = shuffle_partitions(spark)
    placed = (
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    partition = F.shiftright(F.col("_place"), _ROW_BITS)
    row = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    with brief_shuffles(spark):
        placed = stored(placed, "placed") if packed else placed.checkpoint()
        sizes = sorted(placed.groupBy(partition.alias("p")).agg(F.count("*").alias("n")).collect())
    starts = accumulate((n for _, n in sizes), initial=0)
    offsets = spark.createDataFrame([(p, start) for (p, _), start in zip(sizes, starts)], "_part long, _start long")
    found = placed.withColumn("_part", partition).join(F.broadcast(offsets), "_part")  # a row per partition
    return found.withColumn(index_col, F.col("_start") + row).drop("_place", "_part", "_start")


def ordinal(df: DataFrame, col: str, index_col: str = "idx") -> DataFrame:
    """Vocabulary of a column: its distinct values in sorted order with a dense 0-based index."""
    return global_index(df.select(col).filter(F.col(col).isNotNull()).distinct(), [col], index_col, packed=True)


def vocab(df: DataFrame, columns: list[str], name: str = "value") -> DataFrame:
    """Distinct values of several columns together."""
    values = F.explode(F.array(*[F.col(c) for c in columns])).alias(name)
    return df.select(*columns).distinct().select(values).filter(F.col(name).isNotNull()).distinct()


def encode_ids(
    df: DataFrame,
    col: str,
    vocabulary: DataFrame | None,
    index_col: str,
    unknown: str = "zero",
    n: int | None = None,
) -> DataFrame:
    """Index of each id. Unknown ids get index 0, or a repeatable hash bucket when there is no vocabulary."""
    if vocabulary is None or unknown == "hash":
        return df.withColumn(index_col, md5_bucket(F.col(col), n))
    lookup = vocabulary.select(F.col(col), F.col("idx").alias(index_col))
    joined = df.join(lookup, col, "left")
    return joined.withColumn(index_col, F.coalesce(F.col(index_col), F.lit(0).cast("long")))


def shuffle_rows(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Repeatable random order: sorted by a keyed hash (range partitioned, not one task)."""
    return df.orderBy(F.md5(F.concat(F.col(key), F.lit(f"|{seed}"))), key)


def hash_split(df: DataFrame, key: str, share: float, seed: int, name: str = "split") -> DataFrame:
    """Mark rows train or val by a keyed hash; needs no shuffle and never changes for a row."""
    scale = 1_000_000
    bucket = md5_bucket(F.concat(F.col(key), F.lit(f"|{seed}")), scale)
    return df.withColumn(name, F.when(bucket < int(share * scale), "train").otherwise("val"))


def exact_split(df: DataFrame, key: str, share: float, seed: int, name: str = "split") -> DataFrame:
    """Mark exactly ``int(share * n)`` rows of a repeatable random order as train, the rest as val."""
    shuffled = df.withColumn("_order", F.md5(F.concat(F.col(key), F.lit(f"|{seed}"))))
    placed = global_index(shuffled, ["_order", key], "_position")
    cut = int(share * placed.count())
    return placed.withColumn(name, F.when(F.col("_position") < cut, "train").otherwise("val")).drop(
        "_order", "_position"
    )
