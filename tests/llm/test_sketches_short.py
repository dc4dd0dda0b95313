"""Likeness comes from the fingerprints that are returned, also of short texts; plain Python makes the same fingerprints' sets."""

from __future__ import annotations

import random
import re

import numpy as np
from odd import odd_documents

from cartlore.llm import sketches as sk
from cartlore.llm.common import Words, documents, shingle_sets

SF = "/root/testdata/sf0.01"


def plain_shingles(text):
    words = [w for w in re.split("[ \\t\\n\\x0b\\x0c\\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_every_likeness_follows_from_the_returned_fingerprints(spark):
    rows = sk.compare_with_next(documents(spark, SF)).orderBy("doc_id").collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for row, following in zip(rows, rows[1:] + rows[:1]):
        assert row["near_edited"] == sk.likeness(row["fingerprint"], row["edited_fingerprint"])
        assert row["near_next"] == sk.likeness(row["fingerprint"], following["fingerprint"])
        assert 0 <= row["near_next"] <= 1


def test_sketches_hold_the_share_of_plain_shingle_sets(spark):
    """As many hashes as distinct shingles below the threshold in all, and containment near that of the plain sets."""
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, SF).collect()]
    sets = {i: plain_shingles(t or "") for i, t in rows}
    found = dict(zip([i for i, _ in rows], sk.sketches([(t or "").encode() for _, t in rows])))
    total = sum(map(len, sets.values()))
    below = sum(int((s < int(sk.FRACTION * 2**32)).sum()) for s in found.values())
    assert abs(below - total * sk.FRACTION) < 0.03 * total
    assert all((len(found[i]) == 0) == (not sets[i]) for i in sets)
    only_least = sum(len(found[i]) == 1 and found[i][0] >= int(sk.FRACTION * 2**32) for i in sets)
    assert only_least < 0.03 * len(sets)
    long = [i for i in sets if len(sets[i]) > 400]
    for a, b in zip(long, long[1:]):
        exact = len(sets[a] & sets[b]) / min(len(sets[a]), len(sets[b]))
        assert abs(sk.containment(found[a], found[b]) - exact) < 0.35


def test_a_short_text_without_hash_below_the_threshold(spark):
    rng = random.Random(12)
    texts = []
    for _ in range(30):
        words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        texts += [" ".join(words[50:58]), " ".join(words)]
    limit = np.uint64(int(sk.FRACTION * 2**64))
    alone = [bool(shingle_sets(Words([t.encode()], lower=True), sk.SHINGLE)[0][0] >= limit) for t in texts]
    assert 10 < sum(alone[::2]) < 30
    found = {r["doc_id"]: r["near_next"] for r in sk.compare_with_next(odd_documents(spark, texts)).collect() if r["doc_id"] is not None}
    for i in range(0, len(texts), 2):
        if i != 7:
            assert found[i] == (0 if alone[i] else 1)
    a = sk.to_text(sk.sketches([texts[0].encode()])[0])
    assert sk.likeness(a, a) == 1 and sk.likeness("", "") == 1 and sk.likeness(a, "") == 0
