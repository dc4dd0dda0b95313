"""Checks of long vectors."""

from __future__ import annotations

from cartlore.checks import retrieval


def test_long_vectors_are_gone_through_once(spark):
    """The check of the word counts takes the entries above zero out of the long vector in one expression."""
    import tempfile

    folder = tempfile.mkdtemp()
    rows = [(i, f"some words here number {i} and some more words", "en", "web", 20) for i in range(15)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    found = retrieval.review_embedding_counts(spark, folder)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_remove(") == 1 and "filter(" not in plan
    assert all(r.unit and r.of_counts for r in found.collect())
