"""Column names and types of the raw inputs and of the feature views."""

from __future__ import annotations

from pyspark.sql import types as T


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields.items()])


S, L, I, D, FL, B, TS = (
    T.StringType(),
    T.LongType(),
    T.IntegerType(),
    T.DoubleType(),
    T.FloatType(),
    T.BooleanType(),
    T.TimestampType(),
)
VECTOR = T.ArrayType(FL)  # stored arrays are read back as nullable

REVIEWS = struct(
    user_id=S,
    parent_asin=S,
    rating=D,
    title=S,
    text=S,
    helpful_vote=I,
    timestamp=L,
    verified_purchase=B,
)

CATALOG = struct(parent_asin=S, title=S, main_category=S, price=S, store=S)

CATALOG_JSON = struct(
    parent_asin=S,
    title=S,
    main_category=S,
    price=S,
    store=S,
    description=T.ArrayType(S),
    features=T.ArrayType(S),
)

INSTRUCTIONS = struct(instruction=S, input=S, output=S)

USER_FEATURES = struct(
    user_avg_rating=D,
    user_review_count=L,
    user_unique_items=L,
    user_avg_review_length=D,
    user_category_count=L,
    user_tenure_days=L,
    user_primary_category=S,
)

ITEM_FEATURES = struct(
    item_avg_rating=D,
    item_rating_stddev=D,
    item_review_count=L,
    item_total_helpful_votes=L,
    item_avg_review_length=D,
)

ITEM_METADATA = struct(item_title=S, item_brand=S, item_category=S, item_price=FL)

INTERACTIONS = struct(label=D)

REVIEW_EMBEDDINGS = struct(
    item_id=S,
    user_id=S,
    rating=D,
    review_title=S,
    embed_text=S,
    embedding=VECTOR,
)
