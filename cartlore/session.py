"""Session settings shared by jobs, tests and the bench."""

from __future__ import annotations

import gc
import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MB = 1024 * 1024


def build_session(app: str = "cartlore", master: str | None = None, **conf: object) -> SparkSession:
    """Session with UTC time, adaptive execution and skew handling switched on.

    ``master`` stays unset on a cluster, where spark-submit names it together
    with memory and executor settings.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings: dict[str, object] = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # split a hot key also where the next operator then needs a shuffle of its own
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        # checkpoints go when nothing refers to them any more
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.autoBroadcastJoinThreshold": str(32 * MB),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def local_session(cpus: int | None = None, app: str = "cartlore-local", **conf: object) -> SparkSession:
    """Single-JVM session for tests and the bench."""
    cpus = cpus or min(8, os.cpu_count() or 1)
    settings: dict[str, object] = {
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": "12g",
        "spark.driver.host": "127.0.0.1",
        "spark.driver.bindAddress": "127.0.0.1",
        # Python workers find the package also when only sys.path of this process names it
        "spark.executorEnv.PYTHONPATH": os.pathsep.join([str(Path(__file__).resolve().parents[1]), os.environ.get("PYTHONPATH", "")]),
        **conf,
    }
    spark = build_session(app, f"local[{cpus}]", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for ``DataFrame.checkpoint``.

    A cluster names a shared folder in ``spark.checkpoint.dir``; it is used as
    is. Only a local session without one gets a temporary folder, because a
    machine-local folder would be lost with its executor.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="cartlore-ckpt-")
    context.setCheckpointDir(named)
    return named


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_SESSION = uuid.uuid4().hex  # of this driver process


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name beside the checkpoints, on the storage all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/tables/{_SESSION}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove this process's scratch tables, once no result that reads them is needed any more."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark)}/tables/{_SESSION}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


SCAN_MB = 8
FINER = 8


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


@contextmanager
def fine_tasks(spark: SparkSession) -> Iterator[None]:
    """What runs inside is cut into more and smaller tasks, for aggregations that hold most of their task's rows.

    Scans take ``SCAN_MB`` of a file at a time, shuffles ``FINER`` times as many partitions, of which adaptive execution merges small ones.
    """
    wanted = {
        "spark.sql.files.maxPartitionBytes": str(SCAN_MB * MB),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(FINER * shuffle_partitions(spark)),
    }
    with _settings(spark, wanted):
        yield


SLICE_ROWS = 1 << 25  # rows of a turn, see stored_in_turns


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go as soon as it ends, instead of when the driver happens to collect its garbage."""
    with _settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        yield


SWEEP_S = 10


def sweep(spark: SparkSession) -> None:
    """Shuffles and kept blocks go that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffles that nothing refers to any more go every ``SWEEP_S`` seconds and at the end: for trainers that make many of them in one call.

    Spark drops them when the driver collects its garbage, which a driver with little to do hardly does.
    """
    done = threading.Event()

    def sweeps() -> None:
        while not done.wait(SWEEP_S):
            sweep(spark)

    sweeper = threading.Thread(target=sweeps, daemon=True)
    sweeper.start()
    try:
        yield
    finally:
        done.set()
        sweeper.join()
        sweep(spark)


def counted(df: DataFrame) -> int:
    with brief_shuffles(df.sparkSession):
        return df.count()


def _write(df: DataFrame, path: str) -> None:
    with brief_shuffles(df.sparkSession):
        df.write.mode("append").option("compression", "zstd").parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared scratch folder as Parquet and read again: computed once, lineage cut, columns pruned on reading."""
    path = scratch_path(df.sparkSession, name)
    _write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def turns_for(n_rows: int) -> int:
    return max(1, -(-n_rows // SLICE_ROWS))


def turn_conditions(key: Column | str, turns: int) -> list[Column]:
    """A condition on ``key`` for each turn; every key, the missing one too, meets one of them."""
    if turns == 1:
        return [F.lit(True)]
    return [F.pmod(F.xxhash64(key), F.lit(turns)) == turn for turn in range(turns)]


def stored_in_turns(make: Callable[[Column], DataFrame], key: Column | str, turns: int, name: str) -> DataFrame:
    """What ``make`` returns for all keys, stored as ``stored`` does, a part of the keys in each turn.

    ``make`` gets a condition on ``key`` and returns the rows that belong to the keys for which it holds (``df.filter``, where the optimizer
    takes the condition to the scans). Shuffles and sorts of a turn are as large as its part and go before the next turn begins, so
    the disk that joins and groups need does not grow with the rows; the price is that their inputs are read once a turn.
    """
    path = None
    for keep in turn_conditions(key, turns):
        df = make(keep)
        path = path or scratch_path(df.sparkSession, name)
        _write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Remove the folder of a table that ``stored`` has made; nothing may read it any more."""
    files, context = df.inputFiles(), df.sparkSession.sparkContext
    if files:
        jvm = context._jvm
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
