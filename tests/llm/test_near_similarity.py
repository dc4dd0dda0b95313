"""Near duplicates from other similarities than op1's, by brute force."""

from __future__ import annotations

import random
from fractions import Fraction
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest
from odd import ids_and_texts, odd_documents
from test_near import got, shingles

from cartlore.llm import near
from cartlore.llm.common import documents

SF = "/root/testdata/sf0.001"


def expected(docs, least):
    sets = {i: shingles(t) for i, t in docs if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common and Fraction(common, len(sets[a] | sets[b])) >= least:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {(i, len(s), find(i), find(i) == i) for i, s in sets.items()}


def copies(words, changes, seed=8):
    """Texts of ``words`` words, each followed by a copy with ``changes`` scattered words changed."""
    rng = random.Random(seed)
    texts = []
    for _ in range(40):
        own = [f"v{rng.randrange(10**6)}" for _ in range(words)]
        new = list(own)
        for at in range(changes):
            new[10 + at * (words - 20) // changes] = f"n{rng.randrange(10**6)}"
        texts += [" ".join(own), " ".join(new)]
    return texts


def test_stage_links_pairs_between_80_and_85(spark):
    texts = copies(100, 2) + copies(300, 6, seed=9) + copies(100, 3, seed=10)
    found = [len(a & b) / len(a | b) for a, b in ((shingles(x), shingles(y)) for x, y in zip(texts[::2], texts[1::2]))]
    assert sum(0.8 <= s < 0.85 for s in found) == 80 and sum(s < 0.8 for s in found) == 40
    docs = odd_documents(spark, texts)
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} - {None}
    assert kept == {i for i, _, _, k in expected(ids_and_texts(texts), Fraction(4, 5)) if k}
    assert len(kept) == 40 + 40 + 80


@pytest.mark.parametrize("similarity", [0.8, 0.5, 1.0])
def test_any_similarity(spark, similarity, monkeypatch):
    """Drifting copies, so that blocks are compared too; and an exact bound: 4 of 5 shingles are 0.8."""
    monkeypatch.setattr(near, "BLOCK", 16)
    rng = random.Random(6)
    base = [f"v{rng.randrange(10**6)}" for _ in range(120)]
    texts, now = ["a b c d e f g h", "a b c d e f g h i", "p q r s t", "p q r s t p q r s t"], base
    for i in range(100):
        now = list(now if i % 3 else base)
        for _ in range(rng.randrange(1, 5)):
            now[rng.randrange(len(now))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(now))
    found = got(near.near_duplicates(odd_documents(spark, texts), similarity))
    assert found == expected(ids_and_texts(texts), Fraction(similarity).limit_denominator(100))
    assert ((1, 5, 0, False) in found) == (similarity <= 0.8)


def test_bands_and_bits_follow_from_the_similarity():
    op1 = near.Limits.of(near.LINK)
    assert (op1.rows, op1.bands, op1.coarse) == (near.ROWS, near.BANDS, near.COARSE)
    for similarity in (0.9, 0.85, 0.8, 0.7, 0.5, 0.3):
        limits = near.Limits.of(similarity)
        assert (1 - similarity**limits.rows) ** limits.bands <= 1.0001e-6
    for similarity in (0, -0.5, 1.01):
        with pytest.raises(ValueError):
            near.Limits.of(similarity)
    rng = np.random.default_rng(4)
    limits = near.Limits.of(0.8)
    for kind, most in ((limits.coarse, limits.most_bits), (near.FINE, limits.most_fine_bits)):
        u = rng.integers(0, 2**64, size=960, dtype=np.uint64)
        sets = [u[:864], np.concatenate([u[:768], u[864:]])]  # 768 of 960
        sketch = near.odd_sketches(near.minhash(sets, kind[0]), kind[1])
        assert int(np.bitwise_count((sketch[0] ^ sketch[1]).view(np.uint64)).sum()) <= most


def test_stage_on_the_given_documents(spark):
    docs = documents(spark, SF).dropDuplicates(["doc_id"])
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect())
    assert kept == sorted(i for i, _, _, k in expected(rows, Fraction(4, 5)) if k)
