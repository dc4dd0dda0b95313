"""Recommendation lists, re-ranking and related items."""

from __future__ import annotations

import random

import pytest

from cartlore.operators import lookups, recommend
from cartlore.operators import similarity as sim
from pyspark.sql import functions as F


def test_unknown_ids_use_the_first_vector(spark):
    users = sim.Side(spark.createDataFrame([("u1", [0.0, 1.0]), ("u2", [1.0, 0.0])], "user_id string, v array<float>"), "user_id", "v")
    items = sim.Side(spark.createDataFrame([("i1", [0.0, 2.0]), ("i2", [2.0, 0.0])], "item_id string, v array<float>"), "item_id", "v")
    asked = spark.createDataFrame([("u2", "i1"), ("u2", "i2"), ("u2", "zzz"), ("new", "i1")], "user_id string, item_id string")
    rows = recommend.recommend_candidates(asked, users, items, 10).collect()
    scores = {(r.user_id, r.item_id): r.score for r in rows}
    assert scores == {("u2", "i1"): 0.5, ("u2", "i2"): 0.7311, ("u2", "zzz"): 0.5, ("new", "i1"): 0.7311}
    assert {r.item_id: r.rank for r in rows if r.user_id == "u2"} == {"i2": 1, "i1": 2, "zzz": 3}


def recs(spark):
    rows = [("u", "a", 0.9, 1, False, "Books"), ("u", "b", 0.8, 2, True, None), ("u", "c", 0.79, 3, True, "Toys"), ("u", "d", 0.7, 4, False, "E-Books")]
    return spark.createDataFrame(rows, "user_id string, item_id string, score double, rank int, has_metadata boolean, category string")


def test_metadata_first_is_stable(spark):
    found = recommend.prefer_metadata(recs(spark), "user_id", 3).orderBy("rank").collect()
    assert [r.item_id for r in found] == ["b", "c", "a"]


def test_boost(spark):
    found = recommend.persona_boost(recs(spark), "user_id", F.lit("books"), 10).orderBy("rank").collect()
    # a missing category counts as a match; 'E-Books' contains the preference
    assert [(r.item_id, round(r.score, 4), r.boosted) for r in found] == [
        ("a", 1.0, True), ("b", 0.92, True), ("d", 0.805, True), ("c", 0.79, False),
    ]


def test_affinity_scores_missing_vectors_zero(spark):
    personas = spark.createDataFrame([("p", [1.0, 0.0]), ("q", [0.0, 1.0])], "persona string, v array<float>")
    items = spark.createDataFrame([("i", [1.0, 0.0]), ("j", None)], "item_id string, v array<float>")
    rows = recommend.persona_affinity(sim.Side(personas, "persona", "v"), sim.Side(items, "item_id", "v")).collect()
    assert {(r.item_id, r.persona): r.score for r in rows} == {("i", "p"): 0.7311, ("i", "q"): 0.5, ("j", "p"): 0.0, ("j", "q"): 0.0}


def test_affinity_takes_any_list(spark):
    """The same rows from one slice of personas and from several, and more than a thousand of them."""
    rng = random.Random(3)
    vectors = [(f"p{i}", [rng.random() - 0.5, rng.random() - 0.5]) for i in range(1_001)]
    personas = sim.Side(spark.createDataFrame(vectors, "persona string, v array<float>"), "persona", "v")
    items = sim.Side(spark.createDataFrame([("i", [1.0, 0.0]), ("j", None), ("k", [0.3, 0.4])], "item_id string, v array<float>"), "item_id", "v")
    whole = recommend.persona_affinity(personas, items, slice_rows=2_000).collect()
    parts = recommend.persona_affinity(personas, items).collect()
    assert len(whole) == 3 * 1_001 and sorted(whole) == sorted(parts)


def test_boost_needs_a_stated_preference(spark):
    for preference in ("", None):
        found = recommend.persona_boost(recs(spark), "user_id", F.lit(preference).cast("string"), 10).collect()
        assert not any(r.boosted for r in found)


def related_brute(items, k):
    out = []
    ranked = sorted(items, key=lambda r: r[4])
    for item, _, category, _, _ in items:
        c = (category or "").lower()
        others = [r for r in ranked if r[0] != item and r[1]]
        same = [r for r in others if c in (r[2] or "").lower() or (r[2] or "").lower() in c]
        out += [(item, r[0], bool(same), i + 1) for i, r in enumerate((same or others)[:k])]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_related_items(spark, seed):
    rng = random.Random(seed)
    names = ["Books", "E-Books", "Toys", "Toys & Games", "", None, "x", "Garden"]
    rows = [
        (f"i{n}", rng.choice(["t", "t", ""]), rng.choice(names[:4] if rng.random() < 0.5 else names), 1 - n / 100, n)
        for n in range(40)
    ]
    rows.append(("lonely", "t", "Zebra", 0.0, 99))
    df = spark.createDataFrame(rows, "item_id string, title string, category string, score double, rank int")
    found = recommend.related_items(df.select("item_id", "category"), df, 3).collect()
    assert sorted((r.item_id, r.related_id, r.same_category, r.rank) for r in found) == related_brute(rows, 3)


def test_containing_pairs(spark):
    a = spark.createDataFrame([("books",), ("",), ("toys",)], "a string")
    b = spark.createDataFrame([("e-books",), ("book",), ("oy",), ("",), ("zz",)], "b string")
    found = {(r.a, r.b) for r in recommend.containing_pairs(a, b).collect()}
    expected = {(x.a, y.b) for x in a.collect() for y in b.collect() if x.a in y.b or y.b in x.a}
    assert found == expected


def test_factors_cover_all_ids(spark):
    rng = random.Random(1)
    rows = [(f"u{rng.randrange(20)}", f"i{rng.randrange(15)}", float(rng.random() < 0.6)) for _ in range(300)]
    df = spark.createDataFrame(rows, "user_id string, item_id string, label double")
    users, items = recommend.fit_factors(df, rank=4, iterations=2)
    assert users.count() == len({r[0] for r in rows}) and items.count() == len({r[1] for r in rows})
    assert len(users.first().vector) == 4


def test_lookup_keeps_request_rows(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "zz"), (3, "a")], "row int, k string")
    table = spark.createDataFrame([("a", 5), ("b", 6)], "k string, v int")
    for few in (0, 100):
        rows = lookups.online_lookup(asked, [(table, ["k"], ["v"])], few).orderBy("row").collect()
        assert [(r.row, r.v) for r in rows] == [(1, 5), (2, None), (3, 5)]


def test_refs():
    assert lookups.resolve_refs(["a:x", "b:y", "a:z"]) == {"a": ["x", "z"], "b": ["y"]}
    with pytest.raises(ValueError):
        lookups.resolve_refs(["nocolon"])


def test_parity_is_empty_for_equal_tables(spark):
    a = spark.createDataFrame([("k", 1), ("l", None)], "k string, v int")
    b = spark.createDataFrame([("l", None), ("k", 2)], "k string, v int")
    assert lookups.store_parity(a, a).count() == 0
    assert {(r.v, r.surplus) for r in lookups.store_parity(a, b).collect()} == {(1, 1), (2, -1)}


def test_dedup_of_two_searches(spark):
    schema = "p string, text string, rank int"
    first = spark.createDataFrame([("p", "x" * 80 + "one", 1), ("p", "", 2), ("p", "b", 3)], schema)
    second = spark.createDataFrame([("p", "x" * 80 + "two", 1), ("p", "c", 2), ("p", None, 3), ("q", "b", 1)], schema)
    rows = lookups.dedup_union(first, second, ["p"], "text", "rank", 80).orderBy("p", "search", "rank").collect()
    assert [(r.p, r.text[-3:], r.search) for r in rows] == [("p", "one", 1), ("p", "b", 1), ("p", "c", 2), ("q", "b", 2)]
