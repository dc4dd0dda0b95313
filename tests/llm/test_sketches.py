from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from odd import ids_and_texts, no_documents, odd_documents

from cartlore.llm import sketches as sk


def expected(docs):
    order = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, d[1]))
    out = []
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        own, new, following = (sk.sketches([t.encode()])[0] for t in (text, changed, after))
        out.append((
            i, len(text), hashlib.sha256(changed.encode()).hexdigest(), sk.to_text(own), sk.to_text(new),
            sk.containment(own, new), sk.containment(own, following),
        ))
    return sorted(out, key=str)


@pytest.mark.parametrize("partitions", ["1", "4", "9"])
def test_odd_documents(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = sk.compare_with_next(odd_documents(spark))
        assert sorted((tuple(r) for r in found.collect()), key=str) == expected(ids_and_texts())
        assert sk.compare_with_next(no_documents(spark)).count() == 0
        one = odd_documents(spark).filter("doc_id = 3")
        assert [tuple(r) for r in sk.compare_with_next(one).collect()] == expected([(3, "one")])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_equal_texts_have_equal_fingerprints(spark):
    found = {r["doc_id"]: r["fingerprint"] for r in sk.fingerprints(odd_documents(spark)).collect()}
    assert found[7] == found[8] and found[0] == found[1] == found[2] == ""
    assert found[3] and found[3] != found[4]


def test_containment_of_unequal_texts_and_merging():
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(6000)]
    whole, part = " ".join(words), " ".join(words[1000:1900])
    half_new = " ".join(words[2000:2800] + [f"n{i}" for i in range(800)])
    a, b, c = sk.sketches([t.encode() for t in (whole, part, half_new)])
    assert sk.containment(a, b) > 0.97
    assert abs(sk.containment(a, c) - 0.5) < 0.12
    one, other, both = sk.sketches([t.encode() for t in (" ".join(words[:3004]), " ".join(words[3000:]), whole)])
    assert np.array_equal(sk.merged(one, other), both)
    assert np.array_equal(sk.from_text(sk.to_text(a)), a)
    assert abs(len(a) - 6000 * sk.FRACTION) < 5 * (6000 * sk.FRACTION) ** 0.5
