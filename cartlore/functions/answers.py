"""Reading the JSON object out of a generated answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ASPECT_NAME_KEYS = ("aspect", "name")
# the two callers prefer different keys for the value
CLASSIFY_VALUE_KEYS = ("sentiment", "value")
CARD_VALUE_KEYS = ("value", "sentiment")
DEFAULT_ASPECT = "mixed"
END = "end of answer"
# --- fixed values: how many entries of each list are shown ---
CARD_LISTS = {"pros": 5, "cons": 5, "best_for": 4, "not_for": 4, "themes": 6}
# -----------------------------------------------------------------------------


def json_object(text: Column) -> Column:
    """From the first opening to the last closing brace, as a variant; NULL if unreadable.

    The parser stops after the first value, so the text is read as the first
    of two list entries: with anything behind the object, the second entry is
    not the marker and the answer counts as unreadable.
    """
    body = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    listed = F.try_parse_json(F.concat(F.lit("["), body, F.lit(f', "{END}"]')))
    complete = F.try_variant_get(listed, "$[1]", "string") == END
    return F.when(complete, F.try_variant_get(listed, "$[0]", "variant"))


def field_text(parsed: Column, name: str) -> Column:
    return F.try_variant_get(parsed, f"$.{name}", "string")


def field_list(parsed: Column, name: str) -> Column:
    return F.try_variant_get(parsed, f"$.{name}", "array<string>")


def first_readable(*parsed: Column) -> Column:
    """The first answer that could be read."""
    return F.coalesce(*parsed)


def used_model(names: list[str], parsed: list[Column]) -> Column:
    """Name of the model whose answer was the first readable one."""
    return F.coalesce(*[F.when(p.isNotNull(), F.lit(n)) for n, p in zip(names, parsed)])


def _first_text(entry: Column, keys: tuple[str, ...], default: str) -> Column:
    found = [F.try_variant_get(entry, f"$.{k}", "string") for k in keys]
    return F.coalesce(*found, F.lit(default))


def _entry(value_keys: tuple[str, ...]):
    def build(entry: Column) -> Column:
        plain = F.schema_of_variant(entry) == "STRING"
        name = F.when(plain, F.try_variant_get(entry, "$", "string")).otherwise(
            _first_text(entry, ASPECT_NAME_KEYS, "")
        )
        value = F.when(plain, F.lit(DEFAULT_ASPECT)).otherwise(_first_text(entry, value_keys, DEFAULT_ASPECT))
        return F.struct(name.alias("key"), value.alias("value"))

    return build


def _last_of_each(entries: Column) -> Column:
    """Keep the last entry of each name, so that the map has no repeated keys."""

    def is_last(entry: Column, position: Column) -> Column:
        later = F.slice(entries, position + 2, F.size(entries))
        return (entry["key"] != "") & ~F.exists(later, lambda other: other["key"] == entry["key"])

    return F.filter(entries, is_last)


def aspect_map(parsed: Column, value_keys: tuple[str, ...] = CLASSIFY_VALUE_KEYS) -> Column:
    """The ``aspects`` field as a map, whether it was written as a map or as a list."""
    aspects = F.try_variant_get(parsed, "$.aspects", "variant")
    kind = F.schema_of_variant(aspects)
    items = F.try_variant_get(aspects, "$", "array<variant>")
    listed = F.map_from_entries(_last_of_each(F.transform(items, _entry(value_keys))))
    return F.coalesce(
        F.when(kind.startswith("OBJECT"), F.try_variant_get(aspects, "$", "map<string,string>")),
        F.when(kind.startswith("ARRAY"), listed),
        F.create_map().cast("map<string,string>"),
    )


def review_sentiments(parsed: Column) -> Column:
    """The label of every entry of ``per_review``, written as objects or as plain texts; '' where it is missing."""
    entries = F.try_variant_get(parsed, "$.per_review", "array<variant>")

    def label(entry: Column) -> Column:
        plain = F.schema_of_variant(entry) == "STRING"
        return F.when(plain, F.try_variant_get(entry, "$", "string")).otherwise(_first_text(entry, ("sentiment",), ""))

    return F.coalesce(F.transform(entries, label), F.array().cast("array<string>"))


def card_fields(parsed: Column) -> dict[str, Column]:
    """What a product card shows of an answer: the verdict and the first entries of each list."""
    none = F.array().cast("array<string>")
    lists = {n: F.slice(F.coalesce(field_list(parsed, n), none), 1, size) for n, size in CARD_LISTS.items()}
    return {"verdict": F.coalesce(field_text(parsed, "verdict"), F.lit("")), **lists}
