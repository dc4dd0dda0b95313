"""Searches and product flows in turns: the same rows, and no shuffle is left behind."""

from __future__ import annotations

import numpy as np
import pytest
from test_scaling_turns import left_over, shuffle_files, tables

from cartlore.checks import flows
from cartlore.operators import similarity as sim
from cartlore.plans import serving


def vectors(spark, n: int, name: str, ids: int):
    numbers = np.random.default_rng(len(name)).normal(size=(n, 4)).round(2)
    rows = [(f"{name}{i % ids}", [float(x) for x in v]) for i, v in enumerate(numbers)]
    return sim.Side(spark.createDataFrame(rows, f"{name} string, vec array<double>"), name, "vec")


def test_search_copies_a_bounded_part_of_the_corpus_at_once(spark, monkeypatch):
    """Also where a query's id occurs twice: its rows share the k hits, and a turn."""
    queries, corpus = vectors(spark, 90, "q", 60), vectors(spark, 50, "c", 50)
    whole = sorted(sim.vector_topk(queries, corpus, 3, broadcast_queries=0).collect())
    blocks, real = [], sim._block_hits

    def block_hits(q, c, k, group):
        blocks.append(q.select("_qn").first()[0])
        return real(q, c, k, group)

    monkeypatch.setattr(sim, "_block_hits", block_hits)
    monkeypatch.setattr(sim, "TURN_NUMBERS", 2 * 50 * 4)
    before = shuffle_files(spark)
    found = sim.vector_topk(queries, corpus, 3, broadcast_queries=0, block_rows=10)
    assert not left_over(spark, before)
    assert len(blocks) == 5 and max(blocks) <= 4  # two blocks a turn, more where a turn has got more of the queries
    assert sorted(found.collect()) == whole


@pytest.fixture
def shop(spark):
    texts = [(f"r{i}", f"p{i % 7}", float(i % 6), None if i % 5 == 0 else "t", "abcdefgh"[i % 8] * (i % 4) + f" good {i % 11}") for i in range(40)]
    reviews = spark.createDataFrame(texts, "review_id string, item_id string, rating double, review_title string, embed_text string")
    products = spark.createDataFrame(
        [(f"p{i}", None if i == 3 else f"thing {i}", "c", 1.0, 3.0) for i in range(9)],
        "item_id string, title string, category string, price double, avg_rating double",
    )
    return products, flows.letter_encoder(reviews, "embed_text", "embedding")


@pytest.mark.parametrize("broadcast", [0, 1_000])
@pytest.mark.parametrize("flow", [serving.product_reviews, serving.product_prompts])
def test_products_in_turns_have_the_same_reviews(spark, monkeypatch, shop, flow, broadcast):
    whole = flow(*shop, flows.letter_encoder, 4, broadcast_queries=broadcast).collect()
    monkeypatch.setattr(serving, "turns_for", lambda n: 3)
    before, known = shuffle_files(spark), tables(spark)
    found = flow(*shop, flows.letter_encoder, 4, broadcast_queries=broadcast)
    left = sum(1 for name in left_over(spark, before) if name.endswith(".data"))
    assert left <= 8  # of counts of a row a task, none of hits or texts
    kinds = {name.rsplit("-", 1)[0] for name in tables(spark) - known}
    assert ("prompts" if flow is serving.product_prompts else "found-rows") in kinds
    rows = found.collect()
    assert sorted(rows, key=str) == sorted(whole, key=str) and len(rows) >= 9
