from __future__ import annotations

import re
from collections import defaultdict

import pytest
from odd import no_documents, odd_documents, rows

from cartlore.llm.mixing import mix, repeat_rows, source_targets


def targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    """Share by weight, fix what is above its limit, share again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    fixed: dict[str | None, float] = {}
    while True:
        words = sum(sizes.values()) - sum(fixed.values())
        free = [s for s in order if s not in fixed]
        share = {s: weight[s] * words / sum(weight[f] for f in free) for s in free}
        above = {s: 3.0 * sizes[s] for s in free if share[s] > 3 * sizes[s]}
        if not above:
            return fixed | share
        fixed |= above


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 100, "b": 100, "c": 100, "d": 100}, {"a": 1, "b": 1000, "c": 2, "d": 5000, None: 3}, {None: 7}, {"x": 0, "y": 10},
        {"é": 50, "z": 1, "\U0001f389": 900, "￿": 5},
    ],
)
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_targets(df).collect()}
    assert got == pytest.approx(targets(sizes))


def test_mix_of_odd_documents(spark):
    found = mix(odd_documents(spark)).collect()
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows()]
    sizes = defaultdict(int)
    for r, n in zip(rows(), words):
        sizes[r[3]] += n
    want = targets(sizes)
    assert len(found) == len(rows())
    assert sorted((str(r["doc_id"]), r["size"]) for r in found) == sorted((str(r[0]), n) for r, n in zip(rows(), words))
    for r in found:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
    assert mix(no_documents(spark)).count() == 0


def test_taken_words_come_near_targets_and_reruns_agree(spark):
    texts = ["w " * (1 + (i * 7919) % 300) for i in range(900)]
    found = mix(odd_documents(spark, texts)).collect()
    taken, target = defaultdict(int), {}
    for r in found:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    for s in target:
        assert abs(taken[s] - target[s]) <= 5
    again = mix(odd_documents(spark, texts).repartition(7)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    assert mix(odd_documents(spark, texts), seed=2).filter("copies > 0").count() != 0


def test_preference_makes_unequal_probabilities(spark):
    from pyspark.sql import functions as F

    texts = ["w " * 10 for _ in range(3000)]
    docs = odd_documents(spark, texts)
    liked = mix(docs, weights=(1,), preference=F.when(F.col("doc_id") % 2 == 0, 1.3).otherwise(0.7))
    n = {r["even"]: r["n"] for r in liked.groupBy((F.col("doc_id") % 2 == 0).alias("even")).agg(F.sum("copies").alias("n")).collect()}
    assert n[True] > 1.5 * n[False]


def test_rows_are_repeated(spark):
    docs = odd_documents(spark)
    plan = mix(docs)
    again = repeat_rows(docs, plan)
    assert again.columns == docs.columns
    want = {r["doc_id"]: r["copies"] for r in plan.collect()}
    counts = {r["doc_id"]: r["count"] for r in again.groupBy("doc_id").count().collect()}
    assert counts == {i: n * (2 if i == 7 else 1) for i, n in want.items() if n}
