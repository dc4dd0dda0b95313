from __future__ import annotations

import hashlib
import os
import random

import pyarrow as pa
import pytest
from odd import TEXTS, ids_and_texts, no_documents, odd_documents

from cartlore.llm import bpe
from cartlore.llm.queries import vocabulary

os.environ["TOKENIZERS_PARALLELISM"] = "false"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


@pytest.fixture(scope="module")
def own():
    return bpe.Vocabulary(vocabulary())


def random_texts(n):
    rng = random.Random(4)
    letters = [range(32, 127), range(160, 0x500), range(0x2000, 0x3100), range(0x1F300, 0x1F9FF), (10, 9, 32, 32, 0x85, 0xA0, 0x3000)]
    return ["".join(chr(rng.choice(rng.choice(letters))) for _ in range(rng.randrange(300))) for _ in range(n)]


def test_same_ids_and_texts_as_the_library(own, library):
    texts = [t for t in TEXTS if t is not None] + random_texts(200) + ["ab" * 200, "日本" * 100, "'S it's I'LL", "x" * 33, "0" * 31]
    ids = own.encode(texts)
    assert ids == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert own.decode(pa.array(ids, pa.list_(pa.int32()))).to_pylist() == texts


def test_any_ids_decode_like_the_library(own, library):
    rng = random.Random(8)
    ids = [[rng.randrange(50257) for _ in range(rng.randrange(20))] for _ in range(300)]
    got = own.decode(pa.array([*ids, None], pa.list_(pa.int32()))).to_pylist()
    assert got == [library.decode(i, skip_special_tokens=False) for i in ids] + [""]


def test_long_and_short_words_take_the_same_merges(own):
    for text in random_texts(60):
        for word in own.split(text):
            data = word.encode()
            if len(data) <= 32:
                assert own.encode_short([data]) == [own.encode_long(data)]


def test_forgetting_changes_nothing(own, monkeypatch):
    monkeypatch.setattr(bpe, "_MEMORY", 10)
    fresh = bpe.Vocabulary(vocabulary())
    for text in random_texts(20):
        assert fresh.encode([text]) == own.encode([text])


def test_odd_documents(spark, library):
    def row(i, text):
        ids = library.encode(text, add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        return (i, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), back)))

    found = bpe.digests(odd_documents(spark), vocabulary()).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(str(row(i, t)) for i, t in ids_and_texts())
    assert bpe.digests(no_documents(spark), vocabulary()).count() == 0
    two = bpe.decode(bpe.encode(odd_documents(spark), vocabulary()), vocabulary())
    assert sorted(map(str, two.collect())) == sorted(map(str, bpe.round_trip(odd_documents(spark), vocabulary()).collect()))
