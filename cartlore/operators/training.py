"""Training-set preparation: categories, indices, negatives, staging."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import categories, cleaning
from ..session import brief_shuffles, drop_stored, stored, stored_in_turns, turns_for
from . import indexing
from .features import top_category
from .lookups import attach_item_category, map_lookup, union_distinct

NEGATIVES_PER_ROW = 2
PACKED_IDS = 1 << 25  # ids whose categories, a byte each, are sent to all tasks
PACKED_RUN = 4_096  # ids of one row of such a map


def fill_categories(interactions: DataFrame, metadata: DataFrame) -> DataFrame:
    """Super-category of each row's item, filled from the user's source category where unknown."""
    joined = attach_item_category(interactions, metadata)
    mapped = categories.super_category(F.col("item_category"))
    return joined.withColumn("was_missing", mapped.isNull()).withColumn(
        "item_category", categories.super_category_fill(mapped, F.col("user_primary_category"))
    )


def filled_rows(interactions: DataFrame, metadata: DataFrame) -> DataFrame:
    return fill_categories(interactions, metadata).drop("was_missing", "user_primary_category")


def user_top_category(filled: DataFrame) -> DataFrame:
    return top_category(filled, "item_category", "user_primary_category")


def with_user_category(filled: DataFrame, top: DataFrame) -> DataFrame:
    return map_lookup(filled, top, "user_id", "user_primary_category", categories.DEFAULT_SUPER_CATEGORY)


def super_category_prep(interactions: DataFrame, metadata: DataFrame) -> DataFrame:
    """Rows with both sides' super-categories; the user's is their most frequent item category."""
    filled = filled_rows(interactions, metadata)
    return with_user_category(filled, user_top_category(filled))


def category_vocab(filled: DataFrame, top: DataFrame) -> DataFrame:
    """Sorted item and user categories with their index. At most the five fixed names."""
    item_names = filled.select(F.col("item_category").alias("category")).distinct()
    user_names = top.select(F.col("user_primary_category").alias("category")).distinct()
    return indexing.global_index(union_distinct(item_names, user_names), ["category"])


def entity_category(samples: DataFrame, entity_idx: str, category_idx: str, order: str) -> DataFrame:
    """Category index of each id: the one of its last row in the given order.

    Most ids have one category in all rows, which numbers alone tell; only rows of the others are grouped with their place in the order.
    """
    value, null = F.col(category_idx), F.count_if(F.col(category_idx).isNull())
    found = samples.groupBy(entity_idx).agg(F.min(value).alias("_least"), F.max(value).alias("_most"), null.alias("_nulls"))
    one = F.when(F.col("_nulls") > 0, F.col("_most").isNull()).otherwise(F.col("_least") == F.col("_most"))
    several = found.filter(~one).select(F.col(entity_idx).alias("_several"))
    last = F.max_by(category_idx, F.struct(order, category_idx)).alias(category_idx)
    decided = samples.join(several, F.col(entity_idx).eqNullSafe(F.col("_several")), "left_semi").groupBy(entity_idx).agg(last)
    return found.filter(one).select(entity_idx, F.col("_most").alias(category_idx)).unionByName(decided)


def encode_samples(prepared: DataFrame, users: DataFrame, items: DataFrame, cats: DataFrame) -> DataFrame:
    """Index columns and label of the observed rows.

    Ids are looked up by equi-joins, whose hot keys adaptive execution splits.
    The category vocabulary is broadcast: it holds the fixed super-categories only.
    """
    coded = indexing.encode_ids(prepared, "user_id", users, "user_idx")
    coded = indexing.encode_ids(coded, "item_id", items, "item_idx")
    for column, idx in (("user_primary_category", "user_cat_idx"), ("item_category", "item_cat_idx")):
        lookup = cats.select(F.col("category").alias(column), F.col("idx").alias(idx))
        coded = coded.join(F.broadcast(lookup), column, "left")
    label = cleaning.binary_label(F.col("rating")).cast("float").alias("label")
    return coded.select("row_key", "user_idx", "item_idx", "user_cat_idx", "item_cat_idx", label)


def draw_pairs(rows: DataFrame, key: str, n_users: int, n_items: int, ratio: int, seed: int) -> DataFrame:
    """``ratio`` uniformly drawn (user, item) index pairs per row, repeatable through a keyed hash."""
    drawn = rows.select(F.col(key), F.explode(F.sequence(F.lit(1), F.lit(ratio))).alias("draw"))

    def pick(what: str, n: int):
        text = F.concat_ws("|", F.col(key), F.col("draw").cast("string"), F.lit(what), F.lit(str(seed)))
        return indexing.md5_bucket(text, n)

    return drawn.select(key, "draw", pick("u", n_users).alias("user_idx"), pick("i", n_items).alias("item_idx"))


def _category_of(pairs: DataFrame, known: DataFrame, idx: str, category: str, n: int) -> DataFrame:
    """Pairs with the category of their id, of a stored table; those without one are left out.

    Indices are dense and categories a few small numbers, so the categories are sent as runs of one byte per id, and the pairs, each with
    its row's key, stay where they are. More ids, ids without a row or other numbers are joined.
    """
    nulls = F.count_if(F.col(category).isNull() | F.col(idx).isNull())
    with brief_shuffles(known.sparkSession):
        rows, least, most, nulls = known.agg(F.count("*"), F.min(category), F.max(category), nulls).first()
    if rows != n or not 0 < n <= PACKED_IDS or nulls or least < 0 or most > 127:
        return pairs.join(known, idx)
    run = F.floor(F.col(idx) / PACKED_RUN).alias("_run")
    entry = F.struct(idx, F.col(category).cast("byte").alias("c"))
    codes = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["c"])
    runs = F.broadcast(known.groupBy(run).agg(codes.alias("_codes")))  # a byte per id
    kind = known.schema[category].dataType
    found = pairs.withColumn("_run", F.floor(F.col(idx) / PACKED_RUN)).join(runs, "_run")
    return found.withColumn(category, F.get("_codes", (F.col(idx) % PACKED_RUN).cast("int")).cast(kind)).drop("_run", "_codes")


def negatives(
    samples: DataFrame, n_users: int, n_items: int, ratio: int = NEGATIVES_PER_ROW, seed: int = 42, turns: int = 1
) -> DataFrame:
    """Random pairs with label 0 and their known categories, made in ``turns``; known positives are not rejected.

    Drawn indices are uniform, so where the category maps are joined there is no hot key.
    """
    pairs = draw_pairs(samples, "row_key", n_users, n_items, ratio, seed)

    def of(idx: str, category: str) -> DataFrame:
        return stored_in_turns(lambda keep: entity_category(samples.filter(keep), idx, category, "row_key"), idx, turns, "categories")

    user_cats, item_cats = of("user_idx", "user_cat_idx"), of("item_idx", "item_cat_idx")
    joined = _category_of(pairs, user_cats, "user_idx", "user_cat_idx", n_users)
    joined = _category_of(joined, item_cats, "item_idx", "item_cat_idx", n_items)
    return joined.select(
        "row_key", "user_idx", "item_idx", "user_cat_idx", "item_cat_idx", F.lit(0.0).cast("float").alias("label")
    )


def reject_known(pairs: DataFrame, samples: DataFrame) -> DataFrame:
    """Optional: drop drawn pairs that were observed."""
    return pairs.join(samples.select("user_idx", "item_idx").distinct(), ["user_idx", "item_idx"], "left_anti")


def stored_filled(interactions: DataFrame, metadata: DataFrame, turns: int) -> tuple[DataFrame, DataFrame]:
    """Filled rows and the users' top categories, each made in ``turns`` of users and written to the scratch folder once."""
    if turns > 1:  # read in each
        metadata = stored(metadata.select("item_id", "item_category"), "item-categories")
    filled = stored_in_turns(filled_rows(interactions, metadata).filter, "user_id", turns, "filled")
    if turns > 1:
        drop_stored(metadata)
    return filled, stored_in_turns(user_top_category(filled).filter, "user_id", turns, "top")


def stored_samples(
    filled: DataFrame, top: DataFrame, users: DataFrame, items: DataFrame, cats: DataFrame, turns: int
) -> DataFrame:
    """Encoded rows, made in ``turns`` of users and written to the scratch folder once; the filled rows and top categories go."""
    made = stored_in_turns(
        lambda keep: encode_samples(with_user_category(filled.filter(keep), top), users, items, cats), "user_id", turns, "observed"
    )
    drop_stored(filled)
    drop_stored(top)
    return made


def training_samples(
    interactions: DataFrame, metadata: DataFrame, ratio: int = NEGATIVES_PER_ROW, seed: int = 42,
    turns: int | None = None, release: Callable[[], None] = lambda: None,
):
    """Observed rows and random negatives with all indices, plus the vocabularies used.

    The filled and the encoded rows are each needed several times (vocabularies,
    category maps, draws), so they are written to the scratch folder once, in ``turns`` that follow from the number of rows
    if it is not given. ``release`` is called as soon as nothing reads the given rows any more.
    """
    turns = turns_for(interactions.count()) if turns is None else turns
    filled, top = stored_filled(interactions, metadata, turns)
    release()
    users = indexing.ordinal(filled, "user_id")
    items = indexing.ordinal(filled, "item_id")
    cats = category_vocab(filled, top)
    observed = stored_samples(filled, top, users, items, cats, turns)
    drawn = negatives(observed, users.count(), items.count(), ratio, seed, turns)
    return observed.unionByName(drawn), {"user": users, "item": items, "category": cats}


def stage_training(samples: DataFrame, vocabularies: dict[str, DataFrame], path: str) -> None:
    """Samples, vocabularies and their row counts as tables every training worker can read."""
    spark = samples.sparkSession
    tables = {"samples": samples, **{f"{name}_vocab": df for name, df in vocabularies.items()}}
    for name, df in tables.items():
        with brief_shuffles(spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
    counts = None
    for name in tables:
        one = spark.read.parquet(f"{path}/{name}").agg(F.lit(name).alias("table"), F.count("*").alias("n_rows"))
        counts = one if counts is None else counts.unionByName(one)
    counts.write.mode("overwrite").parquet(f"{path}/counts")


def accuracy(df: DataFrame, logit: str = "logit", label: str = "label") -> DataFrame:
    """Share of rows whose logit has the sign of its label."""
    hit = (F.col(logit) > 0).cast("double") == F.col(label)
    return df.agg(F.avg(hit.cast("double")).alias("accuracy"))


def bce_loss(df: DataFrame, logit: str = "logit", label: str = "label") -> DataFrame:
    """Mean binary cross-entropy on logits, in the form that cannot overflow."""
    z, y = F.col(logit), F.col(label)
    loss = F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))
    return df.agg(F.avg(loss).alias("loss"))


def label_balance(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.avg("label").alias("positive_share"))
