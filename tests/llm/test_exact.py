from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import ids_and_texts, no_documents, odd_documents

from cartlore.llm.exact import drop_duplicates, duplicate_groups, misra_gries


@given(st.lists(st.integers(0, 12)), st.integers(1, 6))
@settings(max_examples=200, deadline=None)
def test_summary_keeps_every_frequent_item(items, counters):
    found = misra_gries({}, ((b"%d" % i, 1) for i in items), counters)
    assert len(found) <= counters
    for item, n in Counter(items).items():
        if n > len(items) / (counters + 1):
            assert b"%d" % item in found


@given(st.lists(st.lists(st.integers(0, 9)), max_size=6), st.integers(1, 5))
@settings(max_examples=200, deadline=None)
def test_merged_summaries_keep_it_too(parts, counters):
    merged: dict[bytes, int] = {}
    for part in parts:
        own = misra_gries({}, ((b"%d" % i, 1) for i in part), counters)
        merged = misra_gries(merged, iter(own.items()), counters)
    everything = Counter(i for p in parts for i in p)
    for item, n in everything.items():
        if n > sum(everything.values()) / (counters + 1):
            assert b"%d" % item in merged


def expected(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups["".join(c for c in t if c not in " \t\n\x0b\x0c\r")].append((i, t))
    out = []
    for key, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        sha = hashlib.sha256(key.encode()).hexdigest()
        out += [(i, keep, len(members), i == keep, sha) for i, _ in members]
    return Counter(out)


@pytest.mark.parametrize("counters", [1, 2, 1024])
def test_groups_like_brute_force(spark, counters):
    texts = ["hot text"] * 30 + ["hottext "] * 3 + ["warm"] * 9 + ["cold a", "cold b", None, "", "  "]
    for some in (None, texts):
        got = Counter(tuple(r) for r in duplicate_groups(odd_documents(spark, some), counters).collect())
        assert got == expected(ids_and_texts(some))


def test_empty_table_and_drop(spark):
    assert duplicate_groups(no_documents(spark)).count() == 0
    docs = odd_documents(spark)
    kept = drop_duplicates(docs)
    assert kept.columns == docs.columns
    want = {r[0] for r in expected(ids_and_texts()) if r[3]}
    assert Counter(r["doc_id"] for r in kept.select("doc_id").collect()) == Counter(want)


def test_one_doc_id_with_several_texts(spark):
    rows = [(1, "a b"), (1, "a  b"), (1, "other"), (2, "other"), (3, "ab"), (3, "ab"), (0, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in drop_duplicates(docs).collect()) == [(0, "other"), (1, "a  b")]
