"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A document whose source is to give f times its words is taken floor(f) times for certain. What is left of f is its
inclusion probability p for one more copy. Documents of a source are ranked by their random odds over their
inclusion odds, U / (1 - U) : p / (1 - p), and the sample is the head of that order, as long as the words that the source
still lacks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.indexing import global_index
from .common import stored, unused, whole

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
_FAN = 4096  # buckets of one level of the search for the cut; three levels leave one document in 7e10
_LEVELS = 3
_U_BITS = 52


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) fixed by key and seed: the first 52 bits of an MD5, in the middle of their interval."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"|{seed}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, _U_BITS // 4), 16, 10).cast("long") + 0.5) / float(1 << _U_BITS)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """Words that each source is to give: rows (source, source_size) in, ``target`` added.

    Sources in code point order, null last, weigh ``weights`` in turn and share the sum of all sizes. No target exceeds
    ``max_copies`` times its source's size; what that cuts off is shared out again by weight until no target is above.
    Each round fixes the sources that reach their limit and brings two sums to the driver, whatever the number of sources.
    """
    ordered = sizes.withColumn("_null", F.col("source").isNull())
    placed = global_index(ordered, ["_null", "source"], "_position").drop("_null")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_position") % len(weights) + 1).cast("int"))
    placed = placed.withColumn("_weight", weight.cast("long"))
    limit = F.col("source_size") * max_copies
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    capped, words, shares = F.lit(False), total, placed.agg(F.sum("_weight")).first()[0] or 1
    while True:
        share = F.col("_weight") * F.lit(float(words)) / F.lit(float(shares))
        above = capped | (share > limit)
        fixed, free = placed.agg(
            F.sum(F.when(above, limit).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("_weight")))
        ).first()
        if not free or free == shares:
            target = F.when(above, limit.cast("double")).otherwise(share)
            return placed.select("source", "source_size", target.alias("target"))
        capped, words, shares = above, total - fixed, free


def _cut_points(ranked: DataFrame, group: str, size: str, wanted: str, rank: str) -> DataFrame:
    """For each group the largest rank whose head of the order holds at most ``wanted`` words: (group, cut, missing).

    The order is searched by buckets of the rank: sums of 4096 buckets find the one in which the cut lies, which is then
    divided again. Only sums per bucket are windowed, and at the end the few rows of one last bucket.
    """
    low, width = F.lit(0.0), F.lit(1.0)
    rest = ranked.select(group, size, rank, F.col(wanted).alias("_lack")).withColumn("_low", low).withColumn("_width", width)
    order = W.partitionBy(group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)
    for _ in range(_LEVELS):
        bucket = F.least(F.floor((F.col(rank) - F.col("_low")) / F.col("_width") * _FAN), F.lit(_FAN - 1))
        rest = rest.withColumn("_bucket", bucket)
        sums = (
            rest.groupBy(group, "_bucket")
            .agg(F.sum(size).alias("_words"), F.first("_lack").alias("_lack"), F.first("_low").alias("_low"), F.first("_width").alias("_width"))
            .withColumn("_to", F.sum("_words").over(order))
        )
        over = sums.filter(F.col("_to") > F.col("_lack")).withColumn(
            "_nth", F.row_number().over(W.partitionBy(group).orderBy("_bucket"))
        )
        step = F.col("_width") / _FAN
        found = over.filter("_nth = 1").select(
            F.col(group).alias("_g"),
            F.col("_bucket").alias("_b"),
            (F.col("_lack") - (F.col("_to") - F.col("_words"))).alias("_lack"),
            (F.col("_low") + F.col("_bucket") * step).alias("_low"),
            step.alias("_width"),
        )
        # one row per group; an equi-join that adaptive execution broadcasts or splits
        rest = (
            rest.select(group, size, rank, "_bucket")
            .join(found, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_bucket") == F.col("_b")))
            .drop("_g", "_b", "_bucket")
        )
    rows = W.partitionBy(group).orderBy(rank, size).rowsBetween(W.unboundedPreceding, 0)
    return (
        rest.withColumn("_to", F.sum(size).over(rows))
        .filter(F.col("_to") > F.col("_lack"))
        .groupBy(F.col(group).alias("_g"))
        .agg(F.min(rank).alias("_cut"))
    )


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: int = 1,
    preference: Column | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken (size * copies).

    ``preference`` (default 1 for all) is a positive factor on a document's expected copies, which makes inclusion
    probabilities unequal within a source too; expected copies stay within 0 and ``max_copies``.

    The head of the Pareto order stops before the document with which the source would exceed its target. The last place
    then goes to the document behind the cut whose size comes nearest to the missing words, if that is nearer than none;
    ties go to the earlier rank. So a source misses its target by less than its smallest gap of document sizes allows.

    Null or empty texts have size 0 and are taken whole or not at all, at no effect. Null sources are one source, sorted
    last. Rows that repeat a doc_id have the same random number; they are ranked next to each other. Other columns are
    not read. An empty table, or one without words, gives targets of 0.
    """
    sized = stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    targets = stored(
        source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_copies), "mix-targets"
    )
    by_source = targets.withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    expected = F.least(rate * (preference if preference is not None else F.lit(1.0)), F.lit(float(max_copies)))
    joined = (
        sized.join(by_source, F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
        .withColumn("_expected", expected)
        .withColumn("_whole", F.floor(F.col("_expected") + 1e-12))
        .withColumn("_p", F.greatest(F.col("_expected") - F.col("_whole"), F.lit(0.0)))
    )
    # odds over odds, folded into (0, 1) by the source's own odds: with one p per source the fold gives U back
    u = uniform(F.col("doc_id"), seed)
    own = rate - F.floor(rate)
    odds = u / (1 - u) / (F.col("_p") / (1 - F.col("_p"))) * (own / (1 - own))
    ranked = joined.withColumn("_rank", F.when(F.col("_p") <= 0, None).when(F.col("_p") == own, u).otherwise(odds / (1 + odds)))
    ranked = stored(ranked, "mix-ranked")
    lacks = ranked.groupBy("source").agg(
        (F.first("target") - F.sum(F.col("size") * F.col("_whole"))).alias("_wanted")
    )
    lacks = stored(lacks.withColumnRenamed("source", "_source"), "mix-lacks")
    open_ = ranked.filter((F.col("_rank").isNotNull()) & (F.col("size") > 0)).join(
        lacks, F.col("source").eqNullSafe(F.col("_source"))
    )
    cuts = stored(_cut_points(open_, "source", "size", "_wanted", "_rank"), "mix-cuts")
    behind = ranked.join(cuts, F.col("source").eqNullSafe(F.col("_g")), "left").drop("_g")
    head = F.col("_rank").isNotNull() & (F.col("_cut").isNull() | (F.col("_rank") < F.col("_cut")))
    behind = behind.withColumn("_head", head)
    filled = behind.groupBy("source").agg(F.sum(F.when(F.col("_head"), F.col("size")).otherwise(0)).alias("_filled"))
    gaps = (
        filled.join(lacks, F.col("source").eqNullSafe(F.col("_source")))
        .select(F.col("source").alias("_g"), (F.col("_wanted") - F.col("_filled")).alias("_gap"))
    )
    gaps = stored(gaps, "mix-gaps")
    with_gap = behind.join(gaps, F.col("source").eqNullSafe(F.col("_g"))).drop("_g")
    miss = F.abs(F.col("size") - F.col("_gap"))
    last = (
        with_gap.filter(F.col("_rank").isNotNull() & ~F.col("_head") & (miss < F.col("_gap")))
        .groupBy(F.col("source").alias("_g"))
        .agg(F.min(F.struct(miss.alias("miss"), F.col("_rank").alias("rank"), F.col("doc_id").alias("id"))).alias("_last"))
    )
    chosen = behind.join(last, F.col("source").eqNullSafe(F.col("_g")), "left")
    extra = F.col("_head") | (F.col("doc_id").eqNullSafe(F.col("_last.id")) & F.col("_last").isNotNull())
    copies = F.col("_whole") + F.when(extra, 1).otherwise(0)
    return chosen.select(
        "doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"),
    )


def repeat_rows(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as ``plan`` (doc_id, copies) says."""
    key, copies, nth = unused(docs, "id", "copies", "n")
    times = plan.groupBy(F.col("doc_id").alias(key)).agg(F.max("copies").cast("int").alias(copies))
    joined = docs.join(times.filter(F.col(copies) > 0), F.col("doc_id").eqNullSafe(F.col(key)))
    return joined.select("*", F.explode(F.sequence(F.lit(1), F.col(copies))).alias(nth)).drop(key, copies, nth)


ORACLE = r"""
    WITH d AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
             (CAST('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|1')[1:13] AS BIGINT) + 0.5) / 4503599627370496.0 AS u
      FROM documents),
    s AS (
      SELECT source, CAST(sum(size) AS BIGINT) AS n,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
      FROM d GROUP BY source),
    r AS (
      SELECT *, sum(n) OVER () - coalesce(sum(3 * n) OVER before, 0) AS words, sum(w) OVER (ORDER BY 3.0 * n / w, source NULLS LAST
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shares
      FROM s WINDOW before AS (ORDER BY 3.0 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    level AS (  -- what the first source within its limit has left to share
      SELECT arg_min(words, 3.0 * n / w) AS words, arg_min(shares, 3.0 * n / w) AS shares
      FROM r WHERE CAST(w * words AS DOUBLE) / shares <= 3 * n),
    t AS (
      SELECT source, n, CASE WHEN CAST(w * level.words AS DOUBLE) / level.shares > 3 * n THEN CAST(3 * n AS DOUBLE)
                             ELSE CAST(w * level.words AS DOUBLE) / level.shares END AS target
      FROM s, level),
    e AS (
      SELECT d.*, t.n, t.target, floor(t.target / t.n + 1e-12) AS k, t.target / t.n - floor(t.target / t.n + 1e-12) > 0 AS partial,
             t.target - t.n * floor(t.target / t.n + 1e-12) AS lack,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY u, d.doc_id) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    h AS (
      SELECT *, partial AND (upto <= lack OR size = 0) AS head,
             coalesce(max(upto) FILTER (WHERE partial AND upto <= lack) OVER (PARTITION BY source), 0) AS had FROM e),
    b AS (
      SELECT source, arg_min(doc_id, (abs(size - (lack - had)), u)) AS last
      FROM h WHERE partial AND NOT head AND abs(size - (lack - had)) < lack - had GROUP BY source)
    SELECT h.doc_id, CAST(h.size AS BIGINT) AS size, h.n AS source_size, h.target,
           CAST(h.size * (h.k + CASE WHEN h.head OR h.doc_id = b.last THEN 1 ELSE 0 END) AS BIGINT) AS taken
    FROM h LEFT JOIN b ON h.source IS NOT DISTINCT FROM b.source"""
