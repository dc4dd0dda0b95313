from __future__ import annotations

import zlib

from odd import ids_and_texts, no_documents, odd_documents

from cartlore.llm import toxicity as tox

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    """On rows the classifier did not learn from."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), tox.labels(spark, SF)
    model = tox.train(docs, labels)
    some = docs.join(labels, "doc_id")
    found = tox.score(some.select("doc_id", "text"), model).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)
    held = sorted((r["score"], r["toxic"], r["predicted"]) for r in found if r["held_out"])
    bad = [i for i, r in enumerate(held) if r[1] == 1]
    area = (sum(bad) - len(bad) * (len(bad) - 1) / 2) / (len(bad) * (len(held) - len(bad)))
    assert area > 0.9
    assert sum(p for _, t, p in held if not t) < 0.02 * sum(1 for _, t, _ in held if not t)
    assert sum(p for _, t, p in held if t) > 0.4 * len(bad)
    again = tox.train(docs.repartition(5), labels)
    assert again.toxic == model.toxic and again.ordinary == model.ordinary
    assert tox.drop_toxic(some, model).count() == sum(1 for r in found if not r["predicted"])


def test_odd_documents_and_labels(spark):
    docs = odd_documents(spark)
    for rows in ([], [(1, 1)], [(0, 0), (1, None), (2, 1), (3, 0), (3, 1), (None, 1), (7, 0), (99, 1)]):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        model = tox.train(docs, labels)
        found = tox.score(docs, model).collect()
        assert sorted(str(r["doc_id"]) for r in found) == sorted(str(i) for i, _ in ids_and_texts())
        by_id = {r["doc_id"]: r["score"] for r in found}
        assert by_id[7] == by_id[8] and by_id[0] == by_id[1] == by_id[2]
        assert tox.drop_toxic(docs, model).columns == docs.columns
        assert tox.score(no_documents(spark), model).count() == 0
    assert tox.train(no_documents(spark), labels).score("anything") < 1e-9


def test_ordinary_windows_are_not_told_apart():
    words = [f"word{i % 37}x{i % 11}" for i in range(4000)]
    ordinary = [" ".join(words[i : i + 12]).encode() for i in range(0, 4000, 12)]
    model = tox.Model(tox.train_dictionary(ordinary, 4096), tox.train_dictionary([b" vilewretch nastyfool "] * 400, 1024))
    clean = model.features(" ".join(words[100:400]))
    bad = model.features(" ".join(words[100:200] + ["vilewretch", "nastyfool"] + words[200:300]))
    assert clean[0] == 0 and bad[0] > 0
