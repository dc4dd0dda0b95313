"""The pipeline's stages against plain Python over what each stage was given."""

from __future__ import annotations

from collections import Counter
from fractions import Fraction

import corpus_pipeline
from odd import no_documents, odd_documents
from test_exact import expected as exact_groups
from test_near import shingles
from test_near_similarity import expected as near_groups

from cartlore.llm import bpe, mixing, toxicity
from cartlore.llm.common import documents, stored
from cartlore.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = documents(spark, SF)
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "exact_dedup", "near_dedup", "mix", "bpe"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        given = docs
        docs = stored(stage(spark, given, SF), f"test-{name}")
        rows = [(r["doc_id"], r["text"] or "") for r in given.collect()]
        kept[name] = Counter(r["doc_id"] for r in docs.collect())
        if name != "bpe":
            assert docs.columns == COLUMNS
            texts = dict(rows)
            assert all((r["text"] or "") == texts[r["doc_id"]] for r in docs.collect())
        if name == "toxicity":
            model = toxicity.train(given, toxicity.labels(spark, SF))
            assert kept[name] == Counter(i for i, t in rows if model.score(t) < 0.7)
        if name == "exact_dedup":
            assert kept[name] == Counter(r[0] for r in exact_groups(rows).elements() if r[3])
        if name == "near_dedup":
            assert kept[name] == Counter(i for i, _, _, k in near_groups(rows, Fraction(4, 5)) if k)
            assert all(shingles(t) is not None for _, t in rows)
        if name == "mix":
            plan = {r["doc_id"]: r["copies"] for r in mixing.mix(given).collect()}
            assert kept[name] == Counter({i: n for i, n in plan.items() if n})
        if name == "bpe":
            assert kept[name] == kept["mix"]
            found = {r["doc_id"]: r["n_tokens"] for r in docs.collect()}
            words = bpe.Vocabulary(vocabulary())
            assert found == {i: len(words.encode([t])[0]) for i, t in rows}
    assert Counter(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()) == kept["bpe"]


def test_odd_and_empty_documents(spark):
    for docs in (odd_documents(spark), no_documents(spark)):
        n = docs.count()
        for _, stage in corpus_pipeline.STAGES:
            given, docs = docs, stored(stage(spark, docs, SF), "test-odd")
            assert docs.columns == given.columns or docs.columns[:2] == ["doc_id", "n_tokens"]
        assert docs.count() > 0 or n == 0
