"""Near words against brute force, forms and roots, several filter parts, awkward words."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from odd import ids_and_texts, no_documents, odd_documents

from cartlore.llm import variants


def near(a: str, b: str) -> bool:
    """One code point inserted, deleted or replaced, by trying all places."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    longer, shorter = (a, b) if len(a) > len(b) else (b, a)
    return any(longer[:i] + longer[i + 1 :] == shorter for i in range(len(longer)))


def expected(counts: dict[str, int], factor: int = 5):
    found = {}
    for w, n in counts.items():
        others = [o for o in counts if near(w, o)]
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        if best is not None and counts[best] < factor * n:
            best = None
        found[w] = (best, n, len(others), best and counts[best])
    rows = set()
    for w, (form, n, n_near, form_n) in found.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        rows.add((w, form, root, n, n_near, form_n))
    return rows


def groups(spark, counts, **more):
    words = spark.createDataFrame([(w, n, "x") for w, n in counts], "word string, n long, near string").repartition(3)
    rows = [tuple(r) for r in variants.variant_groups(words, **more).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def vocabulary(seed: int, letters: str = "abcé", n: int = 300) -> dict[str, int]:
    draw = random.Random(seed)
    words = {"".join(draw.choices(letters, k=draw.choice((6, 6, 7, 8)))) for _ in range(n)}
    return {w: draw.choice((5, 6, 30, 150, 800, 4000)) for w in sorted(words)}


@pytest.mark.parametrize("parts", [1, 3])
def test_near_words_forms_and_roots(spark, monkeypatch, parts):
    counts = vocabulary(parts)
    monkeypatch.setattr(variants, "FILTER_BITS", len(counts) * variants.BITS_PER_WORD // parts + 1)
    assert groups(spark, list(counts.items())) == expected(counts)


def test_awkward_words(spark):
    long = "ab" * 3000
    counts = {
        long: 5, long[:-1]: 25, long[:-1] + "z": 125, "aaaaaa": 9, "aaaaaaa": 45, "aaaaaaaa": 225, "\U0001f389" * 6: 5,
        "\U0001f389" * 7: 24, "x" * 47: 5, "x" * 48: 25, "x" * 49: 125, "tiesaa": 5, "tiesab": 30, "tiesac": 30,
    }
    repeated = [(w, n - 3) for w, n in counts.items()] + [(w, 3) for w in counts]
    below = [("rarest", 4), ("short", 50), (None, 9), ("nulled", None)]
    assert groups(spark, repeated + below) == expected(counts)
    assert groups(spark, [("rarest", 4), (None, 9)]) == set()
    assert groups(spark, []) == set()
    with pytest.raises(ValueError):
        variants.variant_groups(spark.createDataFrame([], "word string, n long"), factor=1)


def test_filters_miss_nothing_and_pass_little():
    draw = np.random.default_rng(5)
    words = ["".join(map(chr, row)) for row in draw.integers(97, 123, (20_000, 9))]
    counts = {9: len(words)}
    filters = variants.Filters(counts, 1)
    blocks, lanes = [], []
    for _, codes in variants.by_length(words):
        block, lane = filters.places(variants.hashes(codes), 9)
        blocks.append(block)
        lanes.append(lane)
    filled = np.zeros((filters.size, lanes[0].shape[1]), np.uint64)
    np.bitwise_or.at(filled, np.concatenate(blocks), np.concatenate(lanes))
    filters.fill(np.arange(filters.size), filled)
    for _, codes in variants.by_length(words):
        assert len(filters.may_have(variants.hashes(codes), 9)) == len(codes)
    others = draw.integers(0, 1 << 63, 200_000, np.uint64)
    assert len(filters.may_have(others, 9)) < 0.005 * len(others)
    assert len(filters.may_have(others, 8)) == 0


def test_hashes_of_edits():
    word = "banana"
    (_, codes), = variants.by_length([word])
    row, place, found = variants.deletions(codes)
    assert row.tolist() == [0] * 6
    for i, h in zip(place, found):
        (_, short), = variants.by_length([word[:i] + word[i + 1 :]])
        assert variants.hashes(short)[0] == h
    _, place, found = variants.replacements(codes, ord("n"))
    assert place.tolist() == [0, 1, 3, 5]
    for i, h in zip(place, found):
        (_, other), = variants.by_length([word[:i] + "n" + word[i + 1 :]])
        assert variants.hashes(other)[0] == h


def slips(rows) -> Counter:
    import re

    upper = {c: c + 32 for c in range(65, 91)}
    found: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            run = run.translate(upper)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return found


def test_words_with_slips(spark):
    texts = [f"Überlänge{'x' * (i % 7)} ÉCOLE÷ABC plainword{chr(97 + i % 26)} short" for i in range(600)] + [None, "", "ABCDEF" * 5000]
    expected_words = {w: n for w, n in slips(ids_and_texts(texts)).items() if len(w) >= 6}
    rows = variants.words_with_slips(odd_documents(spark, texts)).groupBy("word").count().collect()
    assert {r[0]: r[1] for r in rows if len(r[0]) >= 6} == expected_words
    assert variants.variant_groups(variants.words_with_slips(no_documents(spark))).collect() == []
