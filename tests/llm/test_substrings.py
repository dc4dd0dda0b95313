from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import BASE, ids_and_texts, no_documents, odd_documents

from cartlore.llm.substrings import K, WINDOW, Runs, digests, window_edges


def expected(docs):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in docs]
    first: dict[tuple, int] = {}
    for i, words in split:
        if i is not None:
            for p in range(len(words) - WINDOW + 1):
                key = tuple(words[p : p + WINDOW])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, words in split:
        gone: set[int] = set()
        if i is not None:
            for p in range(len(words) - WINDOW + 1):
                if first[tuple(words[p : p + WINDOW])] < i:
                    gone.update(range(p, p + WINDOW))
        kept = " ".join(w for p, w in enumerate(words) if p not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def got(df):
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect())


def test_odd_documents(spark):
    assert got(digests(odd_documents(spark))) == expected(ids_and_texts())
    assert digests(no_documents(spark)).count() == 0


def test_one_doc_id_with_several_texts(spark):
    docs = odd_documents(spark).selectExpr("CAST(coalesce(doc_id, 3) AS LONG) % 4 AS doc_id", "text")
    pairs = [((3 if i is None else i) % 4, t) for i, t in ids_and_texts()]
    assert got(digests(docs)) == expected(pairs)


def test_passages_that_overlap_branch_and_repeat(spark):
    """Few different words, shared passages of 49 to 130 words, repeats inside a document, passages within passages."""
    rng = random.Random(11)
    passages = [[f"p{rng.randrange(9)}q{rng.randrange(9)}" for _ in range(n)] for n in (49, 50, 51, 70, 130)]
    passages += [passages[4][20:90], passages[3][:60] + passages[2], ["x"] * 120]
    texts = []
    for i in range(160):
        words: list[str] = []
        for _ in range(rng.randrange(1, 5)):
            words += [f"u{i}_{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 40))]
            passage = list(rng.choice(passages))
            if rng.random() < 0.2:
                passage[rng.randrange(len(passage))] = "edited"
            words += passage
        texts.append(" ".join(words))
    assert got(digests(odd_documents(spark, texts))) == expected(ids_and_texts(texts))


@given(st.lists(st.integers(0, 3), min_size=WINDOW, max_size=120))
@settings(max_examples=60, deadline=None)
def test_edges_are_the_least_of_each_window(words):
    own = np.array(words, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    runs = Runs(own)
    at = np.arange(len(own) - K + 1)
    hashes = runs.hash(at, at + K)
    want = [p + int(np.argmin(hashes[p : p + WINDOW - K + 1])) for p in range(len(own) - WINDOW + 1)]
    assert window_edges(runs, len(own)).tolist() == want


def test_run_hashes_depend_on_words_alone():
    words = np.random.default_rng(1).integers(0, 2**64, size=len(BASE), dtype=np.uint64)
    both = Runs(np.concatenate([words[:7], words]))
    start, end = np.array([7 + 20]), np.array([7 + 70])
    for which in (0, 1):
        assert both.hash(start, end, which) == Runs(words).hash(start - 7, end - 7, which)
