"""The operators applied to the given tables, whole, with production parameters."""

from __future__ import annotations

from ..checks.base import Checks
from . import bpe, chat, exact, mixing, near, pivots, sharding, sketches, structure, substrings, tokens, toxicity, variants
from .common import documents, stored

checks = Checks()
QUERIES, SQL = checks.queries, checks.sql


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@checks.add("op1_odd_sketch_dedup", near.ORACLE)
def _near(spark, sf_dir):
    return near.near_duplicates(documents(spark, sf_dir), near.LINK).drop("class_id")


@checks.add("op2_pareto_mix", mixing.ORACLE)
def _mix(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@checks.add("op3_minimax_shards")
def _shards(spark, sf_dir):
    return sharding.assign_shards(documents(spark, sf_dir))


@checks.add("op4_scaled_sketch")
def _sketches(spark, sf_dir):
    return sketches.compare_with_next(documents(spark, sf_dir))


@checks.add("op5_bpe_round_trip")
def _bpe(spark, sf_dir):
    return bpe.digests(documents(spark, sf_dir), vocabulary())


@checks.add("op6_debruijn_passages", substrings.ORACLE)
def _passages(spark, sf_dir):
    return substrings.digests(documents(spark, sf_dir))


@checks.add("op7_exact_dedup", exact.ORACLE)
def _exact(spark, sf_dir):
    return exact.duplicate_groups(documents(spark, sf_dir))


@checks.add("op8_compression_toxicity")
def _toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, toxicity.labels(spark, sf_dir)))


@checks.add("op9_token_cache")
def _tokens(spark, sf_dir):
    return tokens.count_tokens(documents(spark, sf_dir), vocabulary())


@checks.add("op10_role_repair")
def _chat(spark, sf_dir):
    return chat.repair(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("place")


@checks.add("op11_bloom_variants", variants.ORACLE)
def _variants(spark, sf_dir):
    return variants.variant_groups(variants.words_with_slips(documents(spark, sf_dir)))


@checks.add("op12_viterbi_repair", structure.ORACLE)
def _structure(spark, sf_dir):
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    repaired = stored(structure.repair_structure(structure.damaged(conversations)), "structure-repaired")
    return structure.summaries(repaired, conversations)


@checks.add("op13_pivot_search", pivots.ORACLE)
def _pivots(spark, sf_dir):
    return pivots.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
