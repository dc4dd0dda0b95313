"""Exact dedup by a heavy-hitter split.

Misra-Gries counters find the digests that many rows share. Their exact winners, at most ``counters`` rows, are
broadcast, so copies in large groups are settled where they are read. All other digests have few rows each and go
through one ordinary shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACES, shuffle_partitions, stored, unused, whole

COUNTERS = 1024
_MERGED_AT_ONCE = 64  # summaries


def normalised(text: Column) -> Column:
    """Without the characters of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def misra_gries(counts: dict[bytes, int], more: Iterator[tuple[bytes, int]], counters: int) -> dict[bytes, int]:
    """Add weighted items to a summary of at most ``counters`` items; any item with over n / (counters + 1) of n survives.

    Items are gathered up to twice the size and then cut back by the largest count that must go, which is the merge
    rule of mergeable summaries.
    """
    for item, n in more:
        counts[item] = counts.get(item, 0) + n
        if len(counts) > 2 * counters:
            counts = _cut(counts, counters)
    return _cut(counts, counters)


def _cut(counts: dict[bytes, int], counters: int) -> dict[bytes, int]:
    if len(counts) <= counters:
        return counts
    less = sorted(counts.values(), reverse=True)[counters]
    return {item: n - less for item, n in counts.items() if n > less}


def frequent_items(df: DataFrame, item: str, counters: int = COUNTERS) -> DataFrame:
    """Candidates (column ``item``) for values held by over n / (counters + 1) of n rows; at most ``counters`` rows.

    Each task keeps one summary. The summaries are dealt to the shuffle partitions and merged there, and what comes out is merged
    64 at a time in a tree.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            values = (batch.column(i).to_pylist() for i in range(2))
            counts = misra_gries(counts, zip(*values), counters)
        yield pa.RecordBatch.from_pydict({"item": list(counts), "n": list(counts.values())}, schema)

    schema = pa.schema([("item", pa.binary()), ("n", pa.int64())])
    rows = df.filter(F.col(item).isNotNull()).select(F.col(item).alias("item"), F.lit(1).cast("long").alias("n"))
    summary, parts = rows.mapInArrow(summed, "item binary, n long"), shuffle_partitions(df.sparkSession)
    while True:
        summary = summary.repartition(parts).mapInArrow(summed, "item binary, n long")
        if parts == 1:
            break
        parts = -(-parts // _MERGED_AT_ONCE)
    return summary.select(F.col("item").alias(item))


def duplicate_groups(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when equal without white space. The row with the most code points stays, then the one with the
    smallest doc_id (null last). Null texts count as empty. Rows that repeat a doc_id share their flags, group_size
    counts them all. Only doc_id and text are read; other columns, whatever their names, play no part. An empty table
    gives an empty result.
    """
    digests = stored(
        docs.select(
            "doc_id",
            F.char_length(whole()).alias("chars"),
            F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256)).alias("digest"),
        ),
        "exact-digests",
    )
    # max of (chars, last) is the winner: the smallest id has the largest complement, null comes below all numbers
    best = F.max(F.struct(F.col("chars"), F.bitwise_not("doc_id").alias("last")))
    total = F.count("*")
    candidates = frequent_items(digests, "digest", counters)
    n_rows = digests.count()
    winners = stored(
        digests.join(F.broadcast(candidates), "digest", "left_semi")
        .groupBy("digest")
        .agg(best.alias("best"), total.alias("group_size"))
        .filter(F.col("group_size") > n_rows / (counters + 1)),
        "exact-winners",
    )
    marked = digests.join(F.broadcast(winners), "digest", "left")
    frequent = marked.filter(F.col("best").isNotNull())
    group = W.partitionBy("digest")  # at most n / (counters + 1) rows
    rest = (
        marked.filter(F.col("best").isNull())
        .select("doc_id", "chars", "digest")
        .withColumn("best", best.over(group))
        .withColumn("group_size", total.over(group))
    )
    keep = F.bitwise_not("best.last")
    return frequent.unionByName(rest, allowMissingColumns=True).select(
        "doc_id",
        keep.alias("keep_id"),
        "group_size",
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns.

    Rows of one group that share the doc_id that stays count as repeats of it: the longest one stays, of equal ones any.
    """
    groups = stored(duplicate_groups(docs, counters).select("doc_id", "kept", "text_sha256"), "exact-groups")
    sha = F.sha2(normalised(F.col("text")).cast("binary"), 256)
    key_id, key_sha, name = unused(docs, "id", "sha", "rank")
    same = F.col("doc_id").eqNullSafe(F.col(key_id)) & (sha == F.col(key_sha))
    key = [F.col("doc_id").alias(key_id), F.col("text_sha256").alias(key_sha)]
    left = docs.join(groups.filter(~F.col("kept")).select(*key), same, "left_anti")
    twice = groups.filter("kept").groupBy("doc_id", "text_sha256").count().filter("count > 1").select(*key)
    if not twice.head(1):
        return left
    rank = F.row_number().over(W.partitionBy("doc_id", sha).orderBy(F.char_length(whole()).desc()))
    once = left.join(twice, same, "left_semi").withColumn(name, rank).filter(F.col(name) == 1).drop(name)
    return left.join(twice, same, "left_anti").unionByName(once)


ORACLE = r"""
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
           doc_id = first_value(doc_id) OVER w AS kept, s AS text_sha256
    FROM (SELECT doc_id, length(coalesce(text, '')) AS n,
                 sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS s FROM documents)
    WINDOW w AS (PARTITION BY s ORDER BY n DESC, doc_id)"""
