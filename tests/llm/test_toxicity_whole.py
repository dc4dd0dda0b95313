"""The classifier sees all parts of a text, and all labelled rows of its sample."""

from __future__ import annotations

import numpy as np

from cartlore.llm import toxicity as tox


class Cancelling(tox.Model):
    """Only short pieces save; in a whole window the saving is cancelled."""

    def saved(self, windows):
        return np.array([3 if b"badword" in w and len(w.split()) <= tox.PART else 0 for w in windows], np.int64)


def test_parts_of_windows_without_saving():
    words = [f"word{i}" for i in range(30)]
    model = Cancelling(b"ordinary words", b"badword")
    clean, bad = model.features(" ".join(words)), model.features(" ".join(words[:17] + ["badword"] + words[17:]))
    assert clean[:10] == bad[:10] and clean != bad
    assert bad[11] == np.log1p(1)  # one part saves 2 bytes or more


def test_rows_that_only_share_a_passage_stay_in_the_sample(spark):
    """40 unlike documents with one long passage in common: most share their least shingle. Equal ones of a label merge."""
    shared = " ".join(f"shared{i}" for i in range(300))
    rows = [(i, f"{shared} " + " ".join(f"own{i}x{j}" for j in range(12)), int(i % 2)) for i in range(40)]
    rows += [(100 + i, "the same few words again here", int(i < 3)) for i in range(12)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    held = {r["doc_id"] for r in docs.filter(tox.held_out(docs["doc_id"])).collect()}
    found = {(r["doc_id"], r["toxic"]) for r in tox._sample(docs, labels, 1000).collect()}
    equal = [min((i, y) for i, _, y in rows[40:] if i not in held and y == label) for label in (0, 1)]
    assert found == {(i, y) for i, _, y in rows[:40] if i not in held} | set(equal)


def test_trained_windows_are_a_parameter(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(2400))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "0 AS toxic")
    few, all_ = (tox.train(docs, labels, windows=n) for n in (1, tox.TRAINED_WINDOWS))
    assert few.ordinary != all_.ordinary and len(few.ordinary) <= len(all_.ordinary)
