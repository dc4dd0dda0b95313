"""Category lookups: super-categories, identifier prefixes, file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
SUPER_CATEGORY_MEMBERS = {
    "Photography & Audio": [
        "Camera & Photo",
        "Home Audio & Theater",
        "Portable Audio & Accessories",
        "GPS & Navigation",
        "Car Electronics",
        "Musical Instruments",
    ],
    "DIY & Outdoors": [
        "Tools & Home Improvement",
        "Industrial & Scientific",
        "Sports & Outdoors",
        "Automotive",
        "Arts, Crafts & Sewing",
        "Office Products",
    ],
    "Tech & Computing": [
        "Computers",
        "All Electronics",
        "Cell Phones & Accessories",
        "Electronics",
        "Amazon Devices",
        "Apple Products",
        "Amazon Fire TV",
        "AMAZON FASHION",
        "Video Games",
        "Software",
    ],
    "Books & Media": ["Books", "Buy a Kindle"],
}
DEFAULT_SUPER_CATEGORY = "Home & Living"
SOURCE_TO_SUPER_CATEGORY = {
    "Electronics": "Tech & Computing",
    "Books": "Books & Media",
    "Home_and_Kitchen": "Home & Living",
}
# first match in this order wins
PREFIX_CATEGORIES = [
    ("B09", "Electronics"),
    ("B08", "Electronics"),
    ("B07", "Electronics"),
    ("B01", "Gadgets & Accessories"),
    ("B00", "Home & Living"),
    ("B0", "Tech & Computing"),
    ("19", "Books & Media"),
    ("05", "Books & Media"),
    ("03", "Books & Media"),
    ("0", "Books & Media"),
    ("1", "Books & Media"),
]
UNKNOWN_PREFIX_CATEGORY = "General"
REVIEW_PATH_PATTERN = r"/reviews/([^/]+)/"
CATALOG_DEFAULTS = {
    "Electronics_meta": "Electronics",
    "Books_meta": "Books",
    "Home_and_Kitchen_meta": "Home & Kitchen",
}
# -----------------------------------------------------------------------------


def super_category(raw: Column) -> Column:
    """One of five super-categories; NULL and 'None' give NULL, unknown the default."""
    known = [F.when(raw.isin(members), F.lit(name)) for name, members in SUPER_CATEGORY_MEMBERS.items()]
    return F.when(raw.isNotNull() & (raw != "None"), F.coalesce(*known, F.lit(DEFAULT_SUPER_CATEGORY)))


def super_category_from_source(source: Column) -> Column:
    pairs = [F.when(source == key, F.lit(value)) for key, value in SOURCE_TO_SUPER_CATEGORY.items()]
    return F.coalesce(*pairs, F.lit(DEFAULT_SUPER_CATEGORY))


def super_category_fill(category: Column, user_source: Column) -> Column:
    """Fill a missing super-category from the user's own main source category."""
    return F.coalesce(category, super_category_from_source(user_source))


def prefix_category(identifier: Column) -> Column:
    ordered = [F.when(identifier.startswith(p), F.lit(name)) for p, name in PREFIX_CATEGORIES]
    return F.coalesce(*ordered, F.lit(UNKNOWN_PREFIX_CATEGORY))


def path_category(path: Column) -> Column:
    """Category folder in a review file's path, empty when there is none."""
    return F.regexp_extract(path, REVIEW_PATH_PATTERN, 1)


def contains_either_way(left: Column, right: Column) -> Column:
    """Case-insensitive containment in either direction; empty or missing text matches all."""
    a, b = (F.lower(F.coalesce(c, F.lit(""))) for c in (left, right))
    return a.contains(b) | b.contains(a)
