from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
from odd import ids_and_texts, no_documents, odd_documents

from cartlore.llm import near


def shingles(text):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def expected(docs):
    sets = {i: shingles(t) for i, t in docs if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {(i, len(s), find(i), find(i) == i) for i, s in sets.items()}


def got(df):
    return {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect() if r["doc_id"] is not None}


def test_odd_documents(spark):
    found = near.near_duplicates(odd_documents(spark))
    assert got(found) == expected(ids_and_texts())
    assert [(r["kept"], r["component_id"]) for r in found.filter("doc_id IS NULL").collect()] == [(True, None)]
    assert near.near_duplicates(no_documents(spark)).count() == 0


def test_chained_near_copies(spark, monkeypatch):
    """One family whose members drift apart, so that links lead from member to member and not all to the first."""
    monkeypatch.setattr(near, "BLOCK", 16)
    rng = random.Random(5)
    base = [f"v{rng.randrange(10**6)}" for _ in range(120)]
    texts, now = [], base
    for i in range(150):
        now = list(now if i % 3 else base)
        for _ in range(rng.randrange(1, 4)):
            now[rng.randrange(len(now))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(now))
    rng.shuffle(texts)
    assert got(near.near_duplicates(odd_documents(spark, texts))) == expected(ids_and_texts(texts))


def test_estimates_are_close_and_never_miss():
    rng = np.random.default_rng(3)
    for kind, error in ((near.COARSE, 0.12), (near.FINE, 0.04)):
        for similarity in (0.85, 0.9, 0.97):
            shared, own = round(800 * similarity), round(400 * (1 - similarity))
            u = rng.integers(0, 2**64, size=shared + 2 * own, dtype=np.uint64)
            sets = [u[: shared + own], np.concatenate([u[:shared], u[shared + own :]])]
            sketch = near.odd_sketches(near.minhash(sets, kind[0]), kind[1])
            bits = int(np.bitwise_count((sketch[0] ^ sketch[1]).view(np.uint64)).sum())
            assert abs(near.similarity_estimate(bits, kind) - shared / (shared + 2 * own)) < error
            assert bits <= near.most_differing_bits(0.85, kind)


def test_components(spark):
    edges = [(1, 2), (2, 3), (7, 6), (6, 5), (9, 9), (3, 2)]
    found = near.components(spark.createDataFrame(edges, "a long, b long"))
    assert {tuple(r) for r in found.collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (7, 5), (9, 9)}


def test_stage_keeps_one_of_each_group(spark):
    docs = odd_documents(spark)
    kept = near.drop_near_duplicates(docs)
    want = sorted(i for i, _, _, k in expected(ids_and_texts()) if k)
    assert sorted({r["doc_id"] for r in kept.collect()} - {None}) == want
    assert kept.columns == docs.columns
