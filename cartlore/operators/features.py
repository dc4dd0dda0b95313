"""Per-user and per-item feature aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning
from ..functions import text as text_fn
from ..sources.reviews import normalize_reviews
from .ranking import first_per_key


def stamp(df: DataFrame, as_of: Column | str | None = None) -> DataFrame:
    """Set the event time of freshly computed features: now, or a given instant."""
    if as_of is None:
        moment = F.current_timestamp()
    else:
        moment = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    return df.withColumn("event_timestamp", moment)


def valid_ratings(df: DataFrame) -> DataFrame:
    return df.filter(cleaning.positive_rating(F.col("rating")))


def user_category_counts(df: DataFrame, category: str = "category", name: str = "cat_count") -> DataFrame:
    return df.groupBy("user_id", category).agg(F.count("*").alias(name))


def most_frequent(count: Column, category: Column) -> Column:
    """Aggregate over per-category counts: the largest, ties to the smallest name."""
    return F.min_by(category, F.struct(-count, category))


def top_category(df: DataFrame, category: str = "category", name: str = "top_category") -> DataFrame:
    """Most frequent category of each user; two map-side combined aggregations, no window."""
    counts = user_category_counts(df.filter(F.col(category).isNotNull()), category)
    return counts.groupBy("user_id").agg(most_frequent(F.col("cat_count"), F.col(category)).alias(name))


def primary_category(reviews: DataFrame) -> DataFrame:
    return top_category(valid_ratings(reviews), name="user_primary_category")


def distinct_counts(df: DataFrame, by: str, columns: list[str], approx: bool = False) -> DataFrame:
    """Number of distinct values per group, exact or by a mergeable sketch."""
    count = F.approx_count_distinct if approx else F.count_distinct
    return df.groupBy(by).agg(*[count(c).alias(f"n_{c}") for c in columns])


def _category_and_item_rows(rows: DataFrame, measures: tuple[str, ...] = ("rating", "chars", "timestamp")) -> DataFrame:
    """Every review as a category row with its measures and an item row without any.

    Both kinds share the following shuffle; the empty measures of the item rows
    compress to nearly nothing.
    """
    kinds = dict(rows.dtypes)

    def empty(name: str) -> Column:
        return F.lit(None).cast(kinds[name]).alias(name)

    category_row = F.struct("category", empty("item_id"), *measures)
    item_row = F.struct(empty("category"), "item_id", *[empty(m) for m in measures])
    return rows.select("user_id", F.explode(F.array(category_row, item_row)).alias("_cell")).select("user_id", "_cell.*")


USER_CELL = ("user_id", "category", "item_id")


def _cell_measures(reviews: DataFrame) -> DataFrame:
    return valid_ratings(normalize_reviews(reviews)).select(
        "user_id",
        "category",
        F.col("parent_asin").alias("item_id"),
        "rating",
        F.length("text").cast("long").alias("chars"),
        "timestamp",
    )


def user_cells(reviews: DataFrame) -> DataFrame:
    """Statistics per (user, category), and a row per (user, item) without any; a plain aggregation, on streams too."""
    return _category_and_item_rows(_cell_measures(reviews)).groupBy(*USER_CELL).agg(
        F.count("rating").alias("n"),  # 0 for an item cell
        F.sum("rating").alias("rating_sum"),
        F.sum("chars").alias("chars_sum"),
        F.count("chars").alias("chars_n"),
        F.min("timestamp").alias("first_ms"),
        F.max("timestamp").alias("last_ms"),
    )


def user_cell_rows(reviews: DataFrame) -> DataFrame:
    """The cells of each review by itself, row by row; ``merge_user_cells`` makes ``user_cells`` of them."""
    measures = {
        "n": F.lit(1).cast("long"),
        "rating_sum": F.col("rating"),
        "chars_sum": F.col("chars"),
        "chars_n": F.col("chars").isNotNull().cast("long"),
        "first_ms": F.col("timestamp"),
        "last_ms": F.col("timestamp"),
    }
    rows = _cell_measures(reviews).select("user_id", "category", "item_id", *[value.alias(name) for name, value in measures.items()])
    return _category_and_item_rows(rows, tuple(measures))


def merge_user_cells(cells: DataFrame) -> DataFrame:
    """Cells of different reviews added up, to one per (user, category) and (user, item)."""
    return cells.groupBy(*USER_CELL).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),  # 0 for an item cell
        F.sum("rating_sum").alias("rating_sum"),
        F.sum("chars_sum").alias("chars_sum"),
        F.coalesce(F.sum("chars_n"), F.lit(0)).alias("chars_n"),
        F.min("first_ms").alias("first_ms"),
        F.max("last_ms").alias("last_ms"),
    )


def users_of_cells(cells: DataFrame) -> DataFrame:
    """User features from all cells of the users."""
    per_user = cells.groupBy("user_id").agg(
        F.sum("n").alias("n"),
        F.sum("rating_sum").alias("rating_sum"),
        F.sum("chars_sum").alias("chars_sum"),
        F.sum("chars_n").alias("chars_n"),
        F.min("first_ms").alias("first_ms"),
        F.max("last_ms").alias("last_ms"),
        F.count("category").alias("categories"),
        F.count("item_id").alias("items"),
        F.min_by("category", F.when(F.col("category").isNotNull(), F.struct(-F.col("n"), F.col("category")))).alias("top"),
    )
    return per_user.select(
        "user_id",
        (F.col("rating_sum") / F.col("n")).alias("user_avg_rating"),
        F.col("n").alias("user_review_count"),
        F.col("items").alias("user_unique_items"),
        F.try_divide(F.col("chars_sum").cast("double"), F.col("chars_n")).alias("user_avg_review_length"),
        F.col("categories").alias("user_category_count"),
        cleaning.tenure_days(F.col("first_ms"), F.col("last_ms")).alias("user_tenure_days"),
        F.col("top").alias("user_primary_category"),
    )


def user_features(reviews: DataFrame) -> DataFrame:
    """Review statistics and main category of every user, in one scan.

    The first aggregation makes one cell per (user, category) and per (user,
    item); a second small one per user adds the category cells up (all other
    measures are sums, minima and maxima) and counts the item cells. Both
    combine before they shuffle, so a user holding much of the data never
    arrives as raw rows in one task, and neither the distinct counts nor the
    category counts need a second scan, a window or a join.
    """
    return users_of_cells(user_cells(reviews))


def item_features(reviews: DataFrame) -> DataFrame:
    """Review statistics of every item; the spread of a single review is NULL."""
    rows = valid_ratings(normalize_reviews(reviews)).select(
        F.col("parent_asin").alias("item_id"),
        "rating",
        cleaning.safe_int(F.col("helpful_vote")).alias("votes"),
        F.length("text").alias("chars"),
    )
    measures = {
        "item_avg_rating": F.avg("rating"),
        "item_rating_stddev": F.stddev_samp("rating"),
        "item_review_count": F.count("*"),
        "item_total_helpful_votes": F.sum("votes"),
        "item_avg_review_length": F.avg("chars"),
    }
    return rows.groupBy("item_id").agg(*[measure.alias(name) for name, measure in measures.items()])


def item_metadata(catalog: DataFrame, tie: list[Column | str] = ()) -> DataFrame:
    """One catalogue row per item.

    Of several rows the one with a title, then a price, then the smallest
    values is taken, unless ``tie`` names another order.
    """
    renamed = catalog.withColumnsRenamed(
        {"parent_asin": "item_id", "title": "item_title", "main_category": "item_category", "brand": "item_brand"}
    ).withColumn("item_price", F.col("price").cast("float"))
    order = list(tie) or [
        F.col("item_title").isNull(),
        F.col("item_price").isNull(),
        "item_title",
        "item_brand",
        "item_category",
        "item_price",
    ]
    chosen = first_per_key(renamed, ["item_id"], order)
    return chosen.select("item_id", "item_title", "item_brand", "item_category", "item_price")


def interactions(reviews: DataFrame) -> DataFrame:
    """One labelled (user, item) row per review; unlike the aggregates, unrated reviews stay in."""
    return normalize_reviews(reviews).select(
        "user_id",
        F.col("parent_asin").alias("item_id"),
        cleaning.binary_label(F.col("rating")).alias("label"),
        "event_timestamp",
    )


def embedding_rows(reviews: DataFrame) -> DataFrame:
    """Rows to embed: long enough texts with their key, before the encoder runs."""
    rows = normalize_reviews(reviews)
    whole = text_fn.full_embed_text(F.col("title"), F.col("text"))
    return rows.filter(F.length(whole) >= text_fn.EMBED_MIN_CHARS).select(
        text_fn.review_id(F.col("user_id"), F.col("parent_asin"), F.col("timestamp")).alias("review_id"),
        F.col("parent_asin").alias("item_id"),
        "user_id",
        F.col("rating").cast("double").alias("rating"),
        F.col("title").alias("review_title"),
        text_fn.embed_text(F.col("title"), F.col("text")).alias("embed_text"),
    )


def training_join(interactions_df: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Interactions that have both user and item features."""
    return interactions_df.join(users, "user_id").join(items, "item_id")


def display_fields(df: DataFrame) -> DataFrame:
    """Item features as they are shown: empty texts for missing ones, zero numbers hidden."""
    return df.withColumns(
        {
            "title": cleaning.text_or_empty(F.col("item_title")),
            "brand": cleaning.text_or_empty(F.col("item_brand")),
            "category": cleaning.text_or_empty(F.col("item_category")),
            "avg_rating": F.col("item_avg_rating"),
            "review_count": F.col("item_review_count"),
            "price": cleaning.shown_price(F.col("item_price")),
            "rating_stddev": F.col("item_rating_stddev"),
            "helpful_votes": cleaning.zero_to_null(F.col("item_total_helpful_votes")),
            "has_metadata": F.length(F.coalesce(F.col("item_title"), F.lit(""))) > 0,
        }
    ).drop(
        "item_title",
        "item_brand",
        "item_category",
        "item_avg_rating",
        "item_review_count",
        "item_price",
        "item_rating_stddev",
        "item_total_helpful_votes",
    )
