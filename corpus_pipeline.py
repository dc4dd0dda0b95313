"""From raw documents to token ids: screen, deduplicate twice, mix, encode.

Each stage takes the documents that the one before kept and returns documents with the same columns; the last returns
one row per encoded document. Between stages the documents are written to the shared scratch folder, so a stage that fails or loses
executors starts again from files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cartlore.llm import bpe, exact, mixing, near, toxicity
from cartlore.llm.common import documents, stored
from cartlore.llm.queries import vocabulary
from cartlore.session import drop_stored

NEAR = 0.8  # similarity from which documents are near duplicates


def screen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. The classifier is fitted on the labelled ones among them."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, toxicity.labels(spark, sf_dir)))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space one stays."""
    return exact.drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked near duplicates the document with the least doc_id stays."""
    return near.drop_near_duplicates(docs, NEAR)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks, none to three times."""
    return mixing.repeat_rows(docs, mixing.mix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text, a row per copy."""
    return bpe.digests(docs, vocabulary())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", screen),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("bpe", encode),
]

#: A classifier trained by compression has no SQL form; tests/llm checks the stages against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, given = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if given is not None:
            drop_stored(given)  # what the stage was given is not needed any more
        given = docs
    return STAGES[-1][1](spark, docs, sf_dir)
