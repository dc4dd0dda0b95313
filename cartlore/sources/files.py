"""Hadoop-filesystem listing, so that any storage Spark can read works alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import top_n


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def children(spark: SparkSession, path: str) -> list[str]:
    """Sorted entries of one folder; empty when it does not exist."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(str(s.getPath().toString()) for s in fs.listStatus(p))


def glob(spark: SparkSession, pattern: str) -> list[str]:
    fs, p = _fs(spark, pattern)
    found = fs.globStatus(p)
    return sorted(str(s.getPath().toString()) for s in (found or []))


def delete_tree(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def base_name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def file_inventory(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """One row per file below ``path`` with its prefix (folder) and size.

    ``binaryFile`` lists files without opening them as long as ``content`` is
    not selected, so the job's cost does not depend on the data volume.
    """
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(path)
        .select("path", F.col("length").alias("size_bytes"))
    )
    return listing.withColumn("prefix", F.regexp_extract("path", r"^(.*)/[^/]+$", 1)).withColumn(
        "file_name", F.regexp_extract("path", r"([^/]+)$", 1)
    )


def inventory_summary(inventory: DataFrame, first: int = 15) -> DataFrame:
    """Per prefix: number of files, total size and the first few names."""
    totals = inventory.groupBy("prefix").agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("total_bytes"))
    names = top_n(inventory.select("prefix", "file_name"), ["prefix"], ["file_name"], first)
    listed = names.groupBy("prefix").agg(F.array_sort(F.collect_list("file_name")).alias("first_files"))
    return totals.join(listed, "prefix")
