"""Tables made in turns, whose shuffle files go."""

from __future__ import annotations

import time
from pathlib import Path
from urllib.parse import urlparse

import pytest

from cartlore import session
from cartlore.checks import frames as fr
from cartlore.operators import training
from pyspark.sql import functions as F


def shuffle_files(spark) -> set[str]:
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = manager.getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def left_over(spark, before: set[str]) -> set[str]:
    """Shuffle files beyond those of before; they are removed in the background."""
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    return left


def tables(spark) -> set[str]:
    top = Path(urlparse(session.ensure_checkpoint_dir(spark)).path) / "tables" / session._SESSION
    return {p.name for p in top.iterdir() if not p.name.startswith(".")} if top.exists() else set()


@pytest.mark.parametrize("turns", [1, 3])
def test_shuffles_of_stored_tables_go(spark, turns):
    rows = spark.range(4000).select(F.when(F.col("id") % 10 > 0, F.col("id") % 97).alias("k"), "id")
    sums = rows.groupBy("k").agg(F.sum("id").alias("s"))
    before = shuffle_files(spark)
    made = session.stored_in_turns(sums.filter, "k", turns, "sums")
    assert not left_over(spark, before)
    assert made.schema == sums.schema
    assert sorted(made.collect(), key=str) == sorted(sums.collect(), key=str)  # the group of no key too


INTERACTIONS = "row_key string, user_id string, item_id string, rating double, user_primary_category string"


def interactions(spark):
    rows = [
        (f"r{i:03d}", f"u{i % 13}" if i % 17 else None, f"i{i % 11}", float(i % 6) if i % 5 else None, ["Books", None, "Electronics"][i % 13 % 3])
        for i in range(200)
    ] + [("r001", "u1", "i1", 1.0, None)]  # a key that repeats
    return spark.createDataFrame(rows, INTERACTIONS)


def metadata(spark):
    return spark.createDataFrame([(f"i{i}", ["Books", "Computers", None][i % 3]) for i in range(10)], "item_id string, item_category string")


def test_training_samples_in_turns_are_the_same_and_leave_two_tables(spark):
    whole, _ = training.training_samples(interactions(spark), metadata(spark), turns=1)
    whole = whole.collect()
    before, known, released = shuffle_files(spark), tables(spark), []
    samples, vocabularies = training.training_samples(interactions(spark), metadata(spark), turns=3, release=lambda: released.append(1))
    assert released == [1]
    assert not left_over(spark, before)
    assert {name.rsplit("-", 1)[0] for name in tables(spark) - known} == {"observed", "categories", "placed"}
    assert sorted(samples.collect()) == sorted(whole)
    assert {name: df.count() for name, df in vocabularies.items()} == {"user": 13, "item": 11, "category": 3}


def test_categories_of_ids_are_those_of_their_last_rows(spark):
    rows = [(0, 1, "a"), (0, 1, "b"), (1, 2, "a"), (1, None, "b"), (2, None, "a"), (2, 3, "b"), (3, None, "a"), (None, 1, "a"), (None, 2, "b"), (4, 5, None), (4, 4, "a")]
    df = spark.createDataFrame(rows, "idx long, cat long, at string")
    found = {r.idx: r.cat for r in training.entity_category(df, "idx", "cat", "at").collect()}
    assert found == {0: 1, 1: None, 2: 3, 3: None, None: 2, 4: 4}


@pytest.mark.parametrize("ids", [[0, 1, 2], [0, 1, 1], [0, 1, None]])
def test_reviews_without_texts_have_the_rows_of_those_with(spark, tmp_path, ids):
    """A repeated document id gives a review as many rows; unique ids leave the join with documents out."""
    spark.createDataFrame([(i, "t") for i in ids], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 10)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(5, "p")], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_shipdate date, l_returnflag string"
    spark.createDataFrame([(1, 5, 1, n, 3.0, 1.5, 0.1, None, "R") for n in range(4)], line).write.parquet(f"{tmp_path}/lineitem.parquet")
    lean = fr.reviews_without_texts(spark, str(tmp_path))
    whole = fr.reviews(spark, str(tmp_path)).drop("text")
    assert lean.dtypes == whole.dtypes
    assert sorted(lean.collect(), key=str) == sorted(whole.collect(), key=str)
    narrow = lean.select("user_id", "rating")._jdf.queryExecution().optimizedPlan().toString()
    assert ("doc_ref" in narrow) == (len(set(ids) - {None}) < 3)
