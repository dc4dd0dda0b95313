"""Token counts through a cache: every text's digest is looked up, and only texts seen for the first time are encoded."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import is_byte_level, vocabulary_of
from .common import over_texts, scratch_path, text_parts, whole

CACHE_SCHEMA = "version string, digest binary, n_tokens long"
TOKEN_LIMIT = 512
_ENCODED_AT_ONCE = 1 << 18  # bytes of text


def tokenizer_version(vocabulary: str) -> str:
    """Digest of a tokenizer's file: counts of another file, or of a changed one, are not used."""
    return hashlib.sha256(Path(vocabulary).read_bytes()).hexdigest()


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; a cache that does not exist yet is empty."""
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(path)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def _counter(vocabulary: str):
    """Function from texts to token counts, as the library for the file gives them.

    Byte-level files are counted by the rank arrays of ``bpe``, which give the library's ids in half its time; other
    .json files by the library.
    """
    if vocabulary.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    if is_byte_level(vocabulary):
        words = vocabulary_of(vocabulary)
        words.memory.clear()
        return words.count
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def encode_misses(misses: DataFrame, vocabulary: str) -> DataFrame:
    """Counts of distinct texts: (version, digest, text) in, the cache's columns out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary)
        for batch in batches:
            for part in text_parts(batch, limit=_ENCODED_AT_ONCE):
                n = pa.array(counter(part.column("text").to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("version"), part.column("digest"), n], ["version", "digest", "n_tokens"])

    return over_texts(misses.select("version", "digest", "text"), count, CACHE_SCHEMA)


def count_tokens(docs: DataFrame, vocabulary: str, cache_path: str | None = None, limit: int = TOKEN_LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    A text's key is the SHA-256 of its content, null read as empty; no other normalisation would leave the counts as
    they are. Texts whose (version, digest) the cache at ``cache_path`` lacks are made distinct, encoded once each and
    appended. Without a path the cache lives in the scratch folder of this call. Should two jobs append the same text, both rows hold
    the same count and one is used. Special strings inside a text count as the library's default takes them. Other columns are not read;
    repeated rows each get their row; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    cache_path = cache_path or scratch_path(spark, "token-cache")
    version = tokenizer_version(vocabulary)
    digest = F.unhex(F.sha2(whole().cast("binary"), 256))
    known = open_cache(spark, cache_path).filter(F.col("version") == version)
    texts = docs.select(digest.alias("digest"), whole().alias("text"))
    # copies are merged where they are read, then by digest; the anti-join finds them in place
    misses = texts.dropDuplicates(["digest"]).join(known.select("digest"), "digest", "left_anti")
    encode_misses(misses.withColumn("version", F.lit(version)), vocabulary).write.mode("append").parquet(cache_path)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("version") == version)
    counts = counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return docs.select("doc_id", F.octet_length(whole()).cast("long").alias("n_bytes"), digest.alias("digest")).join(
        counts, "digest"
    ).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
