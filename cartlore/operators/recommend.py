"""Recommendation lists: scoring, enrichment, re-ranking, related items."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import categories, signals, vectors
from ..session import drop_stored, shuffle_partitions, stored, stored_in_turns, swept
from . import indexing
from .ranking import top_n
from .similarity import SCORE_DIGITS, IvfIndex, Side, _matrix, nearest, unit_vectors

OVER_FETCH = 10
BLOCK_NUMBERS = 1 << 28  # of a trainer's block: its pairs times the length of a vector


def catalog_vectors(items: DataFrame, id_col: str, vec: str) -> DataFrame:
    """Item vectors scaled to unit length once, ready to be stored."""
    units = unit_vectors(items, vec, "unit")
    return units.select(id_col, F.col("unit").cast("array<float>").alias("unit"))


def shown_score(cosine: Column) -> Column:
    return signals.round4(signals.sigmoid(cosine))


def recommend(users: Side, items: Side | IvfIndex, k: int, overfetch: int = OVER_FETCH, **search) -> DataFrame:
    """The ``k * overfetch`` best catalogue items of every user, for a later cut to ``k``."""
    hits = nearest(users, items, k * overfetch, **search)
    return hits.select(users.id, items.id, shown_score(F.col("score")).alias("score"), "rank")


def _cold_vector(side: Side) -> Column:
    """Vector of the smallest id, which stands for every unknown id: one row, kept as a literal."""
    first = side.df.orderBy(side.id).select(F.col(side.vec).cast("array<double>").alias("v")).first()
    return F.array(*[F.lit(x) for x in first["v"]])


def recommend_candidates(candidates: DataFrame, users: Side, items: Side, k: int, overfetch: int = OVER_FETCH) -> DataFrame:
    """Score given (user, item) rows only, ``k * overfetch`` of them per user for a later cut to ``k``.

    Unknown ids are scored as the first id of the vocabulary.
    """
    scored, named = candidates, {}
    # users last, so that the lists are cut where the rows then lie; the vector of unknown ids is not sent along
    for side, name in ((items, "_i"), (users, "_u")):
        scored = scored.join(side.df.select(F.col(side.id), F.col(side.vec).alias(name)), side.id, "left")
        named[name] = F.coalesce(F.col(name).cast("array<double>"), _cold_vector(side))
    scored = scored.withColumns(named)
    cosine = F.round(vectors.cosine(F.col("_u"), F.col("_i")), SCORE_DIGITS)
    ranked = scored.select(users.id, items.id, cosine.alias("cosine"))
    best = top_n(ranked, [users.id], [F.col("cosine").desc(), items.id], k * overfetch, "rank")
    return best.select(users.id, items.id, shown_score(F.col("cosine")).alias("score"), "rank")


def prefer_metadata(recs: DataFrame, user: str, k: int) -> DataFrame:
    """Items with metadata first, the rest in score order fills the list up to ``k``."""
    renamed = recs.withColumnRenamed("rank", "score_rank")
    return top_n(renamed, [user], [F.col("has_metadata").desc(), "score_rank"], k, "rank")


def persona_boost(recs: DataFrame, user: str, preference: Column, list_size: int) -> DataFrame:
    """Raise scores of items in the preferred category and sort again; equal scores keep their order.

    A user without a preference (null or empty) keeps the scores.
    """
    stated = F.length(F.coalesce(preference, F.lit(""))) > 0
    matches = stated & categories.contains_either_way(preference, F.col("category"))
    boosted = recs.withColumn("boosted", matches).withColumn(
        "score", signals.boosted_score(F.col("score"), F.col("boosted"))
    )
    renamed = boosted.withColumnRenamed("rank", "old_rank")
    return top_n(renamed, [user], [F.col("score").desc(), F.col("old_rank")], list_size, "rank")


# --- every persona with every item ---------------------------------------------------

PERSONA_SLICE = 1_000  # personas scored by a task at once
ITEM_BLOCK = 16_384  # items of such a task


def persona_affinity(personas: Side, items: Side, slice_rows: int = PERSONA_SLICE, block_rows: int = ITEM_BLOCK) -> DataFrame:
    """Score of every item for each persona, ranked within the item; 0 where a vector is missing.

    ``items`` has one row per item. Slices of at most ``slice_rows`` personas and blocks of some ``block_rows`` items meet
    in one task each, by their numbers: the plan is the same for any number of personas, and items are scanned once.
    The result has a row per pair, so its size is what was asked for.
    """
    listed = personas.df.select(F.col(personas.id).cast("string").alias("persona"), F.col(personas.vec).cast("array<double>").alias("v"))
    rows = items.df.select(F.col(items.id).cast("string").alias("item"), F.col(items.vec).cast("array<double>").alias("v"))
    placed = indexing.global_index(listed, ["persona"], "place")
    sizes = placed.count(), rows.count()
    n_slices, n_blocks = -(-sizes[0] // slice_rows), max(1, -(-sizes[1] // block_rows))
    if not n_slices:
        return items.df.sparkSession.createDataFrame([], f"{items.id} string, {personas.id} string, score double, rank int")

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    slices = placed.select("persona", "v", F.floor(F.col("place") / slice_rows).cast("int").alias("s")).withColumn("b", each(n_blocks))
    blocks = rows.withColumn("b", F.pmod(F.xxhash64("item"), F.lit(n_blocks)).cast("int")).withColumn("s", each(n_slices))
    # a pair of blocks is little data but much work: a fixed number of partitions keeps small ones from being merged
    parts = shuffle_partitions(items.df.sparkSession)
    left, right = (df.repartition(parts, "s", "b").groupBy("s", "b") for df in (slices, blocks))
    scored = left.cogroup(right).applyInArrow(_persona_cosines, "item string, persona string, cosine double")
    score = F.coalesce(shown_score(F.col("cosine")), F.lit(0.0))
    order = Window.partitionBy("item").orderBy(F.desc("score"), "persona")
    ranked = scored.withColumn("score", score).withColumn("rank", F.row_number().over(order))
    return ranked.select(F.col("item").alias(items.id), F.col("persona").alias(personas.id), "score", "rank")


def _persona_cosines(personas: pa.Table, items: pa.Table) -> pa.Table:
    """All pairs of a slice of personas and a block of items with their cosine; null where a vector is missing."""

    def known(table: pa.Table) -> pa.Array:
        return pc.greater(pc.fill_null(pc.list_value_length(table["v"]), 0), 0).combine_chunks()

    cosines = np.full((items.num_rows, personas.num_rows), np.nan)
    rows, columns = (np.flatnonzero(known(t).to_numpy(zero_copy_only=False)) for t in (items, personas))
    if len(rows) and len(columns):
        found = _matrix(items["v"].take(pa.array(rows))) @ _matrix(personas["v"].take(pa.array(columns))).T
        cosines[np.ix_(rows, columns)] = np.round(found, SCORE_DIGITS)
    item = items["item"].combine_chunks().take(pa.array(np.repeat(np.arange(items.num_rows), personas.num_rows)))
    persona = personas["persona"].combine_chunks().take(pa.array(np.tile(np.arange(personas.num_rows), items.num_rows)))
    flat = cosines.ravel()
    return pa.table({"item": item, "persona": persona, "cosine": pa.array(flat, pa.float64(), mask=np.isnan(flat))})


# --- related items -----------------------------------------------------------------


def _substrings(text: Column) -> Column:
    """All distinct substrings of a short text, the empty one included."""
    n = F.length(text)
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    cut = F.transform(
        starts,
        lambda s: F.transform(F.sequence(F.lit(0), F.greatest(n - s + 1, F.lit(0))), lambda size: F.substr(text, s, size)),
    )
    return F.array_distinct(F.flatten(cut))


def containing_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of equal-or-containing texts of two one-column tables (``a``, ``b``), lower case.

    Containment is an equality with one of the longer text's substrings, so both
    directions are equi-joins. Meant for short texts such as category names.
    """
    a_parts = left.select("a", F.explode(_substrings(F.col("a"))).alias("b"))
    b_parts = right.select("b", F.explode(_substrings(F.col("b"))).alias("a"))
    holds = a_parts.join(right, "b").select("a", "b")
    held = b_parts.join(left, "a").select("a", "b")
    return holds.unionByName(held).distinct()


def _literal(value) -> Column:
    return F.struct(*(_literal(v) for v in value)) if isinstance(value, (tuple, list)) else F.lit(value)


def related_items(items: DataFrame, scored: DataFrame, k: int) -> DataFrame:
    """For every item the best scored other items of its category, else the best of all.

    ``items``: item_id, category. ``scored``: item_id, title, category, score,
    rank, one row per item. Categories match when one name contains the other; a
    missing category matches every item. Items without title are left out.

    All items of a category name share one candidate list. It needs ``k + 1``
    entries (one more, because an item is never related to itself), so lists are
    built per name and each item takes its ``k`` from its name's list: nothing
    is joined or sorted per pair of items, however large a category is.
    """
    name = F.lower(F.coalesce(F.col("category"), F.lit("")))
    left = items.select("item_id", name.alias("a"))
    right = scored.filter(F.length("title") > 0).select(
        F.col("item_id").alias("related_id"), name.alias("b"), "score", F.col("rank").alias("at")
    )
    left, right = stored(left, "related-items"), stored(right, "related-scored")  # each is read several times
    order = ["at", "related_id"]
    names = left.select("a").distinct()
    per_name = top_n(right, ["b"], order, k + 1)
    entry = F.struct("at", "related_id", "score")
    overall = [_literal(row) for row in right.select("at", "related_id", "score").orderBy(*order).limit(k + 1).collect()]
    kind = f"array<{right.select(entry.alias('e')).schema['e'].dataType.simpleString()}>"
    any_list = (F.array(*overall) if overall else F.array()).cast(kind)  # k + 1 entries, the same for all
    best = top_n(containing_pairs(names, right.select("b").distinct()).join(per_name, "b"), ["a"], order, k + 1)
    lists = best.groupBy("a").agg(F.array_sort(F.collect_list(entry)).alias("same_list"))

    def others(listed: str) -> Column:
        return F.filter(listed, lambda e: e["related_id"] != F.col("item_id"))

    offered = left.join(lists, "a", "left").withColumns({"same_list": F.coalesce("same_list", F.array().cast(kind)), "any_list": any_list})
    chosen = offered.select("item_id", others("same_list").alias("same"), others("any_list").alias("any"))
    has_same = F.size("same") > 0
    taken = F.slice(F.when(has_same, F.col("same")).otherwise(F.col("any")), 1, k)
    rows = chosen.select("item_id", has_same.alias("same_category"), F.posexplode(taken).alias("pos", "e"))
    return rows.select(
        "item_id", "e.related_id", "e.score", "same_category", (F.col("pos") + 1).cast("int").alias("rank")
    )


# --- towers and factors ----------------------------------------------------------------


@dataclass(frozen=True)
class TowerWeights:
    """Two dense layers of one tower; their size is fixed by the model, not by the data."""

    hidden: np.ndarray  # (hidden, in)
    hidden_bias: np.ndarray
    out: np.ndarray  # (out, hidden)
    out_bias: np.ndarray


def tower(df: DataFrame, weights: TowerWeights, embed: str, category_embed: str | None, out: str = "vector") -> DataFrame:
    """Unit output vectors of a tower: embedding and category embedding, two layers, ReLU between."""
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def raw(column: pa.Array) -> np.ndarray:
        n = len(column)
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = raw(batch[embed])
            if category_embed is not None:
                x = np.concatenate([x, raw(batch[category_embed])], axis=1)
            y = np.maximum(x @ w.hidden.T + w.hidden_bias, 0) @ w.out.T + w.out_bias
            y /= np.maximum(np.sqrt((y * y).sum(axis=1, keepdims=True)), vectors.EPS)
            values = pa.array(y.ravel(), pa.float64())
            offsets = pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32))
            yield batch.append_column(out, pa.ListArray.from_arrays(offsets, values))

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
    return df.mapInArrow(run, schema)


def fit_factors(
    interactions: DataFrame, rank: int = 64, iterations: int = 10, seed: int = 7, turns: int = 1
) -> tuple[DataFrame, DataFrame]:
    """User and item vectors by implicit-feedback ALS on the labels, keyed by their text ids.

    A block of users or items per core, or per ``BLOCK_NUMBERS`` if those are more, and at most per shuffle partition: each vector travels to all blocks that
    need it in each step, so more blocks mean more copies. Each step's shuffles go once the next one's vectors are checkpointed. The trainer's ids are 32-bit: beyond 2 ** 31 users or items the cast fails.
    The interactions are read once and their weights made in ``turns``.
    """
    spark = interactions.sparkSession

    def weights(keep: Column) -> DataFrame:
        return interactions.filter(keep).groupBy("user_id", "item_id").agg(F.sum("label").alias("weight"))

    def coded(keep: Column) -> DataFrame:
        known = pairs.filter(keep).join(users, "user_id").join(items, "item_id")
        return known.select(F.col("user_idx").cast("int"), F.col("item_idx").cast("int"), "weight")

    pairs = stored_in_turns(weights, "item_id", turns, "pairs")
    users = indexing.ordinal(pairs, "user_id", "user_idx")
    items = indexing.ordinal(pairs, "item_id", "item_idx")
    indexed = stored_in_turns(coded, "user_id", turns, "weights")
    drop_stored(pairs)
    blocks = min(shuffle_partitions(spark), max(spark.sparkContext.defaultParallelism, indexed.count() * rank // BLOCK_NUMBERS))
    als = ALS(
        rank=rank,
        maxIter=iterations,
        seed=seed,
        numUserBlocks=blocks,
        numItemBlocks=blocks,
        checkpointInterval=1,
        implicitPrefs=True,
        userCol="user_idx",
        itemCol="item_idx",
        ratingCol="weight",
        coldStartStrategy="drop",
    )
    with swept(spark):
        model = als.fit(indexed)

    def keyed(factors: DataFrame, vocabulary: DataFrame, idx: str, key: str) -> DataFrame:
        named = factors.select(F.col("id").cast("long").alias(idx), F.col("features").alias("vector"))
        return named.join(vocabulary, idx).select(key, "vector")

    return keyed(model.userFactors, users, "user_idx", "user_id"), keyed(model.itemFactors, items, "item_idx", "item_id")
