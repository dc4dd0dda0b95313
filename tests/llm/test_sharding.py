from __future__ import annotations

import zlib
from functools import cache

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import no_documents, odd_documents, rows

from cartlore.llm.sharding import assign_shards, minimax_cuts, smallest_capacity, write_shards


def brute(sizes, shards):
    @cache
    def least(start, left):
        if left == 1:
            return sum(sizes[start:])
        return min(max(sum(sizes[start:end]), least(end, left - 1)) for end in range(start, len(sizes) + 1))

    return least(0, shards)


@given(st.lists(st.integers(0, 20), min_size=1, max_size=9), st.integers(1, 5))
@settings(max_examples=300, deadline=None)
def test_capacity_is_the_least(sizes, shards):
    own = np.array(sizes)
    least = brute(tuple(sizes), shards)
    assert smallest_capacity(own, shards) == least
    cuts = minimax_cuts(own, shards)
    assert len(cuts) == shards and cuts[0] == 0 and cuts == sorted(cuts)
    sums = [int(own[a:b].sum()) for a, b in zip(cuts, [*cuts[1:], len(sizes)])]
    assert sum(sums) == sum(sizes) and max(sums) == least


def test_odd_documents(spark, tmp_path):
    docs = odd_documents(spark)
    found = assign_shards(docs, 4).collect()
    want = sorted((str(r[0]), len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows())
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in found) == want
    by_text, slots = {}, {}
    for r in found:
        assert by_text.setdefault(r["text_crc32"], r["shard"]) == r["shard"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 4
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert assign_shards(no_documents(spark)).count() == 0
    write_shards(docs, str(tmp_path / "shards"), 4)
    written = spark.read.parquet(str(tmp_path / "shards"))
    assert written.count() == len(found)
    assert {(r["doc_id"], r["shard_"]) for r in written.collect()} == {(r["doc_id"], r["shard"]) for r in found}


def test_sizes_are_near_equal(spark):
    texts = [f"{i} " * (1 + (i * 7919) % 200) for i in range(3000)]
    sums = {}
    for r in assign_shards(odd_documents(spark, texts), 10).collect():
        sums[r["shard"]] = sums.get(r["shard"], 0) + r["size"]
    assert len(sums) == 10 and max(sums.values()) < 1.02 * min(sums.values())
