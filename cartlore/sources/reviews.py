"""Review, catalogue and instruction inputs."""

from __future__ import annotations

from functools import reduce
from typing import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import categories, cleaning
from ..operators.ranking import first_rows, limit_rows
from . import files, layouts

# --- fixed values -----------------------------------------------------------
CATALOG_TIMESTAMP = "2020-01-01 00:00:00"
FORMER_NAMES = {"asin": "parent_asin"}
ADDED_COLUMNS = {"helpful_vote": 0}
# -----------------------------------------------------------------------------


def normalize_reviews(df: DataFrame) -> DataFrame:
    """Accept older layouts: former column names, columns that did not exist yet."""
    present = set(df.columns)
    renamed = {old: new for old, new in FORMER_NAMES.items() if old in present and new not in present}
    added = {name: F.lit(value) for name, value in ADDED_COLUMNS.items() if name not in present}
    return df.withColumnsRenamed(renamed).withColumns(added) if renamed or added else df


def with_event_time(df: DataFrame) -> DataFrame:
    return df.withColumn("event_timestamp", cleaning.to_event_ts(F.col("timestamp")))


def with_path_category(df: DataFrame) -> DataFrame:
    """Category folder of the file each row came from.

    The hidden file metadata column is resolved at the scan, so it stays right
    behind any later shuffle.
    """
    return df.withColumn("category", categories.path_category(F.col("_metadata.file_path")))


def scan_reviews(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Reviews of all category folders below a glob, with category and event time.

    With folders named ``category=<name>`` below ``path`` the category is a
    partition column, so a filter on it skips whole folders; plain folder names
    are read off the file path.

    Files may have unlike layouts, also within a folder. They are grouped by the
    columns in their footers; each group is one scan, brought to the present
    names and columns before the groups are put together. A column that a file
    does not have gets its default, a missing value in a file that has it stays missing.
    """
    groups = layouts.by_layout(spark, path)
    if len(groups) < 2:
        return _present(_scan(spark, [path], schema))
    base = layouts.base_path(path)
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), [_present(_scan(spark, paths, schema, base)) for paths in groups]
    )


def _scan(spark: SparkSession, paths: list[str], schema: T.StructType | None, base: str | None = None) -> DataFrame:
    """Files of one layout. Of a given schema the columns they have, under the names they have them."""
    reader = spark.read.option("basePath", base) if base else spark.read
    if schema is None:
        return reader.parquet(*paths)
    own = set(reader.parquet(*paths).columns)
    former = {new: old for old, new in FORMER_NAMES.items() if old in own and new not in own}
    fields = [T.StructField(former.get(f.name, f.name), f.dataType, f.nullable) for f in schema]
    absent = ADDED_COLUMNS.keys() - own
    return reader.schema(T.StructType([f for f in fields if f.name not in absent])).parquet(*paths)


def _present(df: DataFrame) -> DataFrame:
    if "category" not in df.columns:
        df = with_path_category(df)
    return with_event_time(normalize_reviews(df))


def to_review_events(df: DataFrame) -> DataFrame:
    """Already loaded reviews in the shape :func:`scan_reviews` returns."""
    return with_event_time(normalize_reviews(df))


def clean_catalog(df: DataFrame, default_category: str) -> DataFrame:
    """One catalogue source on common columns with its own default category."""
    return df.select(
        "parent_asin",
        "title",
        cleaning.category_or_default(F.col("main_category"), default_category).alias("main_category"),
        cleaning.safe_float(F.col("price")).alias("price"),
        cleaning.missing_to_null(F.col("store")).alias("brand"),
        F.lit(CATALOG_TIMESTAMP).cast("timestamp").alias("event_timestamp"),
    )


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def catalog_union(sources: list[tuple[DataFrame, str]]) -> DataFrame:
    return union_all(*[clean_catalog(df, default) for df, default in sources])


def scan_catalog(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """All catalogue folders, ``{path: default category}``, as one table."""
    return catalog_union([(spark.read.parquet(path), default) for path, default in folders.items()])


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped, a malformed line fails the job."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def ingest_jsonl(
    spark: SparkSession,
    src: str,
    dst_root: str,
    category: str,
    schema: T.StructType = schemas.REVIEWS,
    rows_per_file: int = 500_000,
) -> str:
    """One category's JSON lines into its own Parquet folder; returns that folder."""
    target = f"{dst_root}/{category}"
    write_chunked(read_jsonl(spark, src, schema), target, rows_per_file)
    return target


def ingest_catalog(spark: SparkSession, root: str, category: str) -> DataFrame | None:
    """Catalogue of one category: Parquet shards if there are any, else the JSON-lines file, else nothing."""
    shards = files.glob(spark, f"{root}/raw_meta_{category}/*.parquet")
    if shards:
        return spark.read.parquet(*shards)
    fallback = f"{root}/meta_categories/meta_{category}.jsonl"
    if files.exists(spark, fallback):
        return read_jsonl(spark, fallback, schemas.CATALOG_JSON)
    return None


def scan_split(spark: SparkSession, root: str, split: str, max_files: int = 0) -> DataFrame | None:
    """Instruction records of one split; ``None`` when the folder is missing."""
    folder = f"{root.rstrip('/')}/{split}"
    if not files.exists(spark, folder):
        return None
    parts = [
        p
        for p in files.children(spark, folder)
        if p.endswith((".jsonl", ".txt", ".parquet")) or "part-" in files.base_name(p)
    ]
    if max_files > 0:
        parts = parts[:max_files]
    columnar = [p for p in parts if p.endswith(".parquet")]
    lines = [p for p in parts if not p.endswith(".parquet")]
    frames = []
    if lines:
        frames.append(spark.read.schema(schemas.INSTRUCTIONS).json(lines))
    if columnar:
        frames.append(spark.read.parquet(*columnar).select(*schemas.INSTRUCTIONS.names))
    return union_all(*frames) if frames else spark.createDataFrame([], schemas.INSTRUCTIONS)


def scan_pruned(df: DataFrame, columns: list[str], limit: int = 0, order: list[Column | str] | None = None) -> DataFrame:
    """Chosen columns, optionally only the first rows: by ``order``, or as they lie in their files.

    Neither sends the kept rows through one task (see ``limit_rows``, ``first_rows``).
    """
    df = df.select(*columns)
    if limit <= 0:
        return df
    return first_rows(df, limit, order) if order else limit_rows(df, limit)


def stringify(df: DataFrame) -> DataFrame:
    """Every text or nested column as text, NULL as the missing marker. Nested values become JSON, which any reader can parse again."""
    kinds = dict(df.dtypes)
    textual = ("string", "array", "struct", "map", "binary")
    return df.select(
        *[cleaning.stringify(c, kinds) if kinds[c].startswith(textual) else F.col(c) for c in df.columns]
    )


# --- sinks ---------------------------------------------------------------------


def write_chunked(df: DataFrame, path: str, rows_per_file: int = 500_000, mode: str = "overwrite") -> None:
    """Snappy Parquet parts of at most ``rows_per_file`` rows."""
    (
        df.write.mode(mode)
        .option("maxRecordsPerFile", rows_per_file)
        .option("compression", "snappy")
        .parquet(path)
    )


def write_training(df: DataFrame, path: str, partitions: int = 32) -> int:
    """Training rows in ``partitions`` evenly filled files; returns their number.

    The rows are counted by the writing tasks, not by a second run of the plan.
    """
    counted = Observation("training rows")
    spread = df.repartition(partitions).observe(counted, F.count(F.lit(1)).alias("n_rows"))
    spread.write.mode("overwrite").parquet(path)
    return counted.get["n_rows"]


def write_in_chunks(df: DataFrame, send: Callable[[list], None], partitions: int, chunk_rows: int = 5_000) -> None:
    """Hand rows to an external store in bounded chunks, one writer per partition.

    ``send`` must be idempotent per row: a lost executor's partition is sent again.
    """
    from itertools import islice

    def write_partition(rows):
        rows = iter(rows)
        while chunk := list(islice(rows, chunk_rows)):
            send(chunk)

    df.repartition(partitions).foreachPartition(write_partition)
