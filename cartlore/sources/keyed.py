"""Parquet tables in folders by a hash of the key, updated folder by folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import drop_stored, stored
from . import files

Merge = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class KeyedTable:
    """Rows of a key lie in one folder ``bucket=<n>``. The number of buckets is part of the table and stays as it is.

    An update reads and replaces the folders of its keys by dynamic partition overwrite; all others are not touched. Merges that give the
    same rows when they run twice make updates safe to repeat, which is what to do after a driver died while it replaced
    folders. One update at a time: of two at once the later one may undo the other's folders.
    """

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    buckets: int = 64

    @property
    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def exists(self) -> bool:
        return files.exists(self.spark, self.path)

    def read(self, schema: T.StructType, touched: list[int] | None = None) -> DataFrame:
        """The rows, or those of some buckets only; none if nothing was written."""
        if not self.exists():
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(self.path)
        if touched is not None:
            rows = rows.filter(F.col("bucket").isin(touched))
        return rows.select(schema.names)

    def update(self, batch: DataFrame, merge: Merge, is_table: bool = False) -> list[int]:
        """Write ``merge(current rows, batch)`` for the buckets of the batch's keys; returns these (at most all bucket numbers).

        The batch is stored first, unless it ``is_table``: stored already. The merged rows are stored before the folders that they come
        from are replaced; those of a first update come from no folder.
        """
        fresh = (batch if is_table else stored(batch, "update")).withColumn("bucket", self.bucket)
        touched = sorted(r.bucket for r in fresh.select("bucket").distinct().collect())
        if touched:
            first = not self.exists()
            merged = merge(self.read(batch.schema, touched), fresh.drop("bucket")).withColumn("bucket", self.bucket)
            if not first:
                merged = stored(merged, "merged")
            # one file for a small bucket, several for a large one
            writer = merged.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("bucket").parquet(self.path)
            if not first:
                drop_stored(merged)
        if not is_table:
            drop_stored(fresh)
        return touched
