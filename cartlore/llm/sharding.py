"""Shards of near equal bytes: a minimax partition of ordered atomic groups into contiguous runs.

The rows of equal texts are one atomic group, found by a hash that places them in one of ``groups`` slices of the hash
space. Only the slices' sizes, a fixed number of them, come to the driver, which searches the smallest capacity by which a
greedy walk needs no more than the wanted shards, and cuts there.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.indexing import global_index
from .common import unused, whole

GROUPS = 1 << 16
ROW_BYTES = 16  # of a row besides its text


def crc(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes, null as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def greedy_cuts(ends: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """First group of each shard when every shard takes all it can hold; None if ``shards`` are not enough.

    ``ends[i]`` is the summed size of groups 0 to i.
    """
    cuts, start = [], 0
    while start < len(ends):
        cuts.append(start)
        if len(cuts) > shards:
            return None
        before = int(ends[start - 1]) if start else 0
        start = int(np.searchsorted(ends, before + capacity, "right"))
    return cuts


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """The least largest shard that contiguous runs of ``sizes`` allow."""
    ends = np.cumsum(sizes, dtype=np.int64)
    if not len(ends) or not ends[-1]:
        return 0
    low, high = max(int(sizes.max()), -(-int(ends[-1]) // shards)), int(ends[-1])
    while low < high:
        middle = (low + high) // 2
        if greedy_cuts(ends, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def minimax_cuts(sizes: np.ndarray, shards: int) -> list[int]:
    """First group of every shard, ``shards`` of them, none above the smallest feasible capacity.

    Greedy from the left gives the latest possible cuts, greedy from the right the earliest; each cut goes between
    the two, as near as it can to its equal share, so that the last shards are not left short.
    """
    capacity = smallest_capacity(sizes, shards)
    ends = np.cumsum(sizes, dtype=np.int64)
    if not capacity:
        return [0] * shards
    n, total = len(sizes), int(ends[-1])
    backward = greedy_cuts(np.cumsum(sizes[::-1], dtype=np.int64), capacity, shards)
    earliest = [0] * (shards - len(backward)) + [n - c for c in reversed(backward[1:])]
    earliest = [0, *earliest][-shards:] if len(earliest) >= shards else [0] * (shards - len(earliest)) + earliest
    cuts = [0]
    for k in range(1, shards):
        before = int(ends[cuts[-1] - 1]) if cuts[-1] else 0
        latest = int(np.searchsorted(ends, before + capacity, "right"))
        ideal = total * k / shards
        at = int(np.searchsorted(ends, ideal, "left"))
        if at < n and abs(ends[at] - ideal) < abs((ends[at - 1] if at else 0) - ideal):
            at += 1
        cuts.append(min(max(at, earliest[k], cuts[-1]), latest))
    return cuts


def assign_shards(docs: DataFrame, shards: int = 40, groups: int = GROUPS) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes (null: none) plus 16. Equal texts, null and empty among them, share a shard, so
    a text with many copies can make its shard larger than the others; the largest shard is as small as the order allows.
    Slots number the rows of a shard from 0 without gaps by (hash slice, doc_id), null doc_ids first; rows that repeat a
    doc_id get slots of their own. Other columns are not read. An empty table gives an empty result.
    """
    rows = docs.select(
        "doc_id",
        (F.octet_length(whole()) + ROW_BYTES).cast("long").alias("size"),
        crc(F.col("text")).alias("text_crc32"),
        F.pmod(F.xxhash64(whole()), F.lit(groups)).cast("int").alias("_group"),
    )
    found = rows.groupBy("_group").agg(F.sum("size").alias("bytes")).collect()  # at most ``groups`` rows
    sizes = np.zeros(groups, np.int64)
    for group, n in found:
        sizes[group] = n
    cuts = F.array(*[F.lit(c) for c in minimax_cuts(sizes, shards)])
    shard = F.size(F.filter(cuts, lambda c: c <= F.col("_group"))) - 1
    placed = global_index(rows.withColumn("shard", shard), ["shard", "_group", "doc_id"], "_position")
    starts = placed.groupBy("shard").agg(F.min("_position").alias("_first"))
    return placed.join(F.broadcast(starts), "shard").select(  # a row per shard
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("_position") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, groups: int = GROUPS) -> DataFrame:
    """Write whole rows to ``path/shard=<n>`` and return the plan; rows of a repeated doc_id go where their text goes.

    If ``docs`` has a column of that name it is kept, and the folders get underscores behind theirs.
    """
    plan = assign_shards(docs, shards, groups)
    name = "shard"
    while name in docs.columns:
        name += "_"
    key_id, key_crc = unused(docs, "id", "crc")
    where = plan.groupBy(F.col("doc_id").alias(key_id), F.col("text_crc32").alias(key_crc)).agg(F.first("shard").alias(name))
    same = F.col("doc_id").eqNullSafe(F.col(key_id)) & (crc(F.col("text")) == F.col(key_crc))
    docs.join(where, same).drop(key_id, key_crc).write.partitionBy(name).parquet(path)
    return plan
