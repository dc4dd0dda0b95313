"""Parquet files of several layouts below one path: grouped by their footers, read layout by layout."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

from . import files

READERS = 16  # footers read at a time


def _data_files(spark: SparkSession, path: str) -> Iterator[str]:
    """Parquet files at or below a path or glob, without hidden ones."""
    for found in files.glob(spark, path):
        fs, start = files._fs(spark, found)
        listed = fs.listFiles(start, True)
        while listed.hasNext():
            name = str(listed.next().getPath().toString())
            below = name.removeprefix(found.rstrip("/")).strip("/").split("/")
            if not any(part.startswith(("_", ".")) for part in below):
                yield name


def _layout(spark: SparkSession, name: str) -> str:
    """The column names and types in a file's footer."""
    jvm = spark._jvm
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(
        jvm.org.apache.hadoop.fs.Path(name), spark._jsc.hadoopConfiguration()
    )
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    try:
        return str(reader.getFileMetaData().getSchema().toString())
    finally:
        reader.close()


def _folders(groups: dict[str, list[str]]) -> list[list[str]]:
    """Per layout the paths to read: a folder where it has files of this layout only, else the files."""
    kinds: dict[str, set[str]] = defaultdict(set)
    for layout, names in groups.items():
        for name in names:
            kinds[name.rsplit("/", 1)[0]].add(layout)
    parents = {f.rsplit("/", i)[0] for f in kinds for i in range(1, f.count("/"))}
    whole = {f for f, own in kinds.items() if len(own) == 1 and f not in parents}
    return [sorted({f if (f := n.rsplit("/", 1)[0]) in whole else n for n in names}) for names in groups.values()]


def by_layout(spark: SparkSession, path: str) -> list[list[str]]:
    """The paths of each layout that files below ``path`` have, most files first.

    Every footer is read once, some at a time, through the file system that Spark uses; no data is. The driver holds a name per file, as
    it does for any scan.
    """
    names = list(_data_files(spark, path))
    with ThreadPoolExecutor(READERS) as readers:
        found = list(readers.map(lambda name: _layout(spark, name), names))
    groups: dict[str, list[str]] = defaultdict(list)
    for layout, name in zip(found, names):
        groups[layout].append(name)
    return _folders(dict(sorted(groups.items(), key=lambda g: (-len(g[1]), g[1][0]))))


def base_path(path: str) -> str:
    """The part of a path before its first wildcard, where partition folders are counted from."""
    kept = []
    for part in path.split("/"):
        if any(c in part for c in "*?[{"):
            break
        kept.append(part)
    return "/".join(kept) or "/"
