"""Block search and the flows on it: what travels, and what a task holds, stays small."""

from __future__ import annotations

import numpy as np

from cartlore.checks import flows
from cartlore.functions.encoders import hashing_encoder
from cartlore.operators import similarity as sim
from cartlore.plans import serving
from pyspark.sql import functions as F


def vectors(spark, n, name, ids=None):
    rng = np.random.default_rng(5)
    rows = [(ids(i) if ids else f"{name}{i:04d}", rng.normal(size=6).tolist(), f"payload {i}") for i in range(n)]
    return spark.createDataFrame(rows, f"{name} string, vec array<double>, note string")


def test_payload_is_fetched_after_the_search(spark):
    """A hit carries its corpus row's number; texts are not sent to every block of queries."""
    q, c = vectors(spark, 30, "qid"), vectors(spark, 200, "cid")
    hits = sim.vector_topk(sim.Side(q, "qid", "vec"), sim.Side(c, "cid", "vec"), 3, ["note"], broadcast_queries=0, block_rows=8)
    lines = hits._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = {i: len(line) - len(line.lstrip(" :+-")) for i, line in enumerate(lines)}
    at = next(i for i, line in enumerate(lines) if "InArrow" in line)
    below = [line for i, line in enumerate(lines) if i > at and all(depth[j] > depth[at] for j in range(at + 1, i + 1))]
    assert below and not any("note#" in line for line in below if "Relation" not in line)
    assert {r.note.split()[1] for r in hits.collect()} == {str(int(r.cid[3:])) for r in hits.collect()}


def test_rows_of_one_id_are_spread(spark):
    """Blocks are cut by row number: rows that share an id do not meet in one task."""
    c = vectors(spark, 400, "cid", lambda i: "same").select(F.col("cid").alias(sim.CID), F.col("vec").alias(sim.CVEC))
    rows = sim._numbered(c)
    sizes = rows.groupBy(F.pmod(F.xxhash64(sim.CNO), F.lit(4))).count().collect()
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 200


def test_streamed_corpus_gives_the_exact_hits():
    """Whatever the batches, with many equal scores, and never more than a bounded number of hits held."""
    rng = np.random.default_rng(1)
    q = rng.normal(size=(40, 5))
    q = q / np.linalg.norm(q, axis=1, keepdims=True)
    c = rng.normal(size=(3000, 5))
    c[100:2900:3] = c[7]
    c = c / np.linalg.norm(c, axis=1, keepdims=True)
    expected = np.round(q @ c.T, sim.SCORE_DIGITS)
    for k, step in ((1, 3000), (5, 700), (50, 311)):
        running = sim._Running(q, k)
        for at in range(0, len(c), step):
            running.add(c[at : at + step], np.arange(at, min(at + step, len(c))))
        running.settle()
        for i in range(len(q)):
            assert running.no[running.number == i].tolist() == np.lexsort((np.arange(len(c)), -expected[i]))[:k].tolist()
        assert len(running.no) == k * len(q)


def test_found_reviews_are_numbers_until_shown(spark, monkeypatch):
    """Neither search nor prompts write the texts of hits; a review id that occurs twice shows both texts."""
    rows = [(f"r{i % 9}", f"p{i % 3}", float(i % 5), "t", f"good thing number {i} of {i % 4}") for i in range(12)]
    reviews = hashing_encoder(32)(spark.createDataFrame(rows, "review_id string, item_id string, rating double, review_title string, embed_text string"), "embed_text", "embedding")
    products = spark.createDataFrame([(f"p{i}", f"thing {i}", "c", 1.0, 3.0) for i in range(3)], "item_id string, title string, category string, price double, avg_rating double")
    wrote, keep = {}, serving.stored

    def stored(df, name):
        wrote[name] = df.columns
        return keep(df, name)

    monkeypatch.setattr(serving, "stored", stored)
    prompts = serving.product_prompts(products, reviews, hashing_encoder(32), 4, broadcast_queries=0).collect()
    assert len(prompts) == 3 and all("Review 1: good thing" in p.analysis_prompt for p in prompts)
    assert not {"embed_text", "text"} & {c for name in ("hits", "found-reviews") for c in wrote[name]}
    found = serving.product_reviews(products, reviews, hashing_encoder(32), 12, broadcast_queries=0)
    texts = {(r.review_id, r.text) for r in found.collect()}
    assert texts <= {(r[0], r[4]) for r in rows} and len({t for _, t in texts}) > 9


def test_question_prompts_on_many_questions(spark, monkeypatch):
    """The block search of questions gives what the search by few gives."""
    rows = [(f"r{i:02d}", f"p{i % 3}", float(i % 5), None if i % 4 == 0 else "t", f"good thing number {i}") for i in range(30)]
    reviews = flows.letter_encoder(spark.createDataFrame(rows, "review_id string, item_id string, rating double, review_title string, embed_text string"), "embed_text", "embedding")
    asked = spark.createDataFrame([(f"q{i}", f"is number {i} good", f"p{i % 4}") for i in range(9)], "id string, question string, product string")
    few, many = (
        {r.id: (r.n_sources, r.prompt) for r in serving.question_prompts(asked, "id", reviews, flows.letter_encoder, 4, "product", broadcast_queries=n).collect()}
        for n in (100, 0)
    )
    assert few == many and len(few) == 9
