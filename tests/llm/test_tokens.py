from __future__ import annotations

import os

import pytest
from odd import ids_and_texts, no_documents, odd_documents

from cartlore.llm import tokens
from cartlore.llm.queries import vocabulary

os.environ["TOKENIZERS_PARALLELISM"] = "false"


def expected(docs, count):
    return sorted(str((i, len(t.encode()), count(t), count(t) > 512)) for i, t in docs)


def test_counts_and_cache(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    want = expected(ids_and_texts(), lambda t: len(library.encode(t, add_special_tokens=False).ids))
    cache = str(tmp_path / "cache")
    docs = odd_documents(spark)
    some = docs.filter("doc_id < 6")
    assert tokens.count_tokens(some, vocabulary(), cache).count() == 6
    seen = spark.read.parquet(cache).count()
    assert seen == len({t for i, t in ids_and_texts() if i is not None and i < 6})
    assert sorted(str(tuple(r)) for r in tokens.count_tokens(docs, vocabulary(), cache).collect()) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.distinct().count() == len({t for _, t in ids_and_texts()})
    assert sorted(str(tuple(r)) for r in tokens.count_tokens(docs, vocabulary(), cache).collect()) == want
    assert spark.read.parquet(cache).count() == stored.count()


def test_another_tokenizer_has_its_own_counts(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    import sentencepiece

    cache = str(tmp_path / "cache")
    texts = ["a few words", "", None, "more words here"]
    docs = odd_documents(spark, texts)
    tokens.count_tokens(docs, vocabulary(), cache).count()
    path = public.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = tokens.count_tokens(docs, path, cache)
    want = expected(ids_and_texts(texts), lambda t: len(model.encode(t)))
    assert sorted(str(tuple(r)) for r in found.collect()) == want


def test_a_tokenizer_that_normalises_is_left_to_its_library(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    assert tokens.is_byte_level(vocabulary()) and not tokens.is_byte_level(path)
    library = Tokenizer.from_file(path)
    found = tokens.count_tokens(odd_documents(spark), path)
    want = expected(ids_and_texts(), lambda t: len(library.encode(t, add_special_tokens=False).ids))
    assert sorted(str(tuple(r)) for r in found.collect()) == want


def test_empty_table(spark):
    assert tokens.count_tokens(no_documents(spark), vocabulary()).count() == 0
