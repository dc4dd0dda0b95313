"""Scans over files of several layouts, and row quotas."""

from __future__ import annotations

import pytest
from conftest import REVIEW_ROWS, REVIEW_SCHEMA

from cartlore import schemas
from cartlore.operators import ranking
from cartlore.sources import layouts
from cartlore.sources import reviews as src
from pyspark.sql import functions as F


def old(df):
    return df.withColumnRenamed("parent_asin", "asin").drop("helpful_vote")


def reviews(spark, *users):
    return spark.createDataFrame([r for r in REVIEW_ROWS if r[0] in users], REVIEW_SCHEMA).drop("category").coalesce(1)


@pytest.mark.parametrize("schema", [None, schemas.REVIEWS])
def test_both_layouts_in_one_folder(spark, tmp_path, schema):
    old(reviews(spark, "AE22NQ")).write.parquet(f"{tmp_path}/reviews/Books")
    present = reviews(spark, "BKRMX7").withColumn("helpful_vote", F.nullif("helpful_vote", F.lit(7)))
    present.write.mode("append").parquet(f"{tmp_path}/reviews/Books")
    found = src.scan_reviews(spark, f"{tmp_path}/reviews/*/", schema)
    rows = {(r.user_id, r.parent_asin): r.helpful_vote for r in found.collect()}
    assert rows == {
        ("AE22NQ", "B07XJ8C8F5"): 0, ("AE22NQ", "B09K3M2P1Q"): 0, ("AE22NQ", "B08N5WRWNW"): 0,
        ("BKRMX7", "B07XJ8C8F5"): 0, ("BKRMX7", "B09K3M2P1Q"): None,
    }
    assert {r.category for r in found.collect()} == {"Books"} and "asin" not in found.columns
    assert found.filter("event_timestamp IS NULL").count() == 0


def test_folders_of_one_layout_are_read_as_folders(spark, tmp_path):
    reviews(spark, "BKRMX7").repartition(2).write.parquet(f"{tmp_path}/reviews/Books")
    old(reviews(spark, "AE22NQ")).repartition(3).write.parquet(f"{tmp_path}/reviews/Music")
    groups = layouts.by_layout(spark, f"{tmp_path}/reviews/*")
    assert sorted(len(g) for g in groups) == [1, 1]
    assert sorted(g[0].rsplit("/", 1)[1] for g in groups) == ["Books", "Music"]
    reviews(spark, "AE22NQ").write.mode("append").parquet(f"{tmp_path}/reviews/Music")
    groups = layouts.by_layout(spark, f"{tmp_path}/reviews/*")
    assert sorted(len([p for p in g if p.endswith(".parquet")]) for g in groups)[0] == 1
    assert src.scan_reviews(spark, f"{tmp_path}/reviews/*").count() == 8
    assert layouts.base_path("s3a://b/raw/reviews/*/x") == "s3a://b/raw/reviews" and layouts.base_path("/a/b") == "/a/b"


def test_layouts_below_partition_folders(spark, tmp_path):
    whole = spark.createDataFrame(REVIEW_ROWS, REVIEW_SCHEMA)
    whole.filter("user_id = 'AE22NQ'").write.partitionBy("category").parquet(f"{tmp_path}/reviews")
    old(whole.filter("user_id = 'BKRMX7'")).write.mode("append").partitionBy("category").parquet(f"{tmp_path}/reviews")
    found = src.scan_reviews(spark, f"{tmp_path}/reviews")
    assert {r.category: r["count"] for r in found.groupBy("category").count().collect()} == {"Electronics": 4, "Home_and_Kitchen": 1}
    assert found.filter("parent_asin IS NULL").count() == 0
    plan = found.filter("category = 'Electronics'")
    text = plan._sc._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "simple")
    assert text.count("PartitionFilters: [isnotnull(category") == 2


# --- row quotas -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def numbered(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("numbered"))
    spark.range(0, 1000, 1, 4).withColumn("v", F.col("id") * 2).write.option("maxRecordsPerFile", 70).parquet(f"{path}/rows")
    return spark.read.parquet(f"{path}/rows")


def plan_of(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("n", [1, 69, 70, 71, 500, 999, 1000, 5000, 0])
def test_exact_number_of_the_first_rows(numbered, monkeypatch, n):
    monkeypatch.setattr(ranking, "ROWS_PER_RUN", 16)
    found = ranking.limit_rows(numbered, n)
    order = [(r.f, r.i, r.id) for r in numbered.select("_metadata.file_path", "_metadata.row_index", "id").toDF("f", "i", "id").collect()]
    assert sorted(r.id for r in found.collect()) == sorted(i for _, _, i in sorted(order)[:n])
    assert "SinglePartition" not in plan_of(found) and "Limit" not in plan_of(found)
    assert found.columns == ["id", "v"]


def test_filters_and_projections_come_first(numbered):
    some = numbered.filter("id % 7 = 3").select((F.col("v") + 1).alias("w"))
    found = ranking.limit_rows(some, 60)
    assert found.count() == 60 and all((r.w - 1) // 2 % 7 == 3 for r in found.collect())
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, ranking.limit_rows(some, 60).collect()))
    assert ranking.limit_rows(some, 10_000).count() == some.count()


def test_files_behind_the_quota_are_not_read(numbered):
    found = ranking.limit_rows(numbered, 100)
    names = {r[0] for r in found.select("_metadata.file_path").collect()}
    assert len(names) == 2
    found.collect()
    query = found._jdf.queryExecution().executedPlan().toString()
    assert "file_path" in query
    scan = found._jdf.queryExecution().sparkPlan().collectLeaves().head()
    assert scan.metrics().apply("numFiles").value() in (0, 2)


def test_inputs_that_are_no_scans(spark, numbered):
    grouped = numbered.groupBy((F.col("id") % 50).alias("g")).count()
    assert ranking.limit_rows(grouped, 20).count() == 20
    assert ranking.limit_rows(numbered.unionByName(numbered), 1500).count() == 1500
    exploded = numbered.select("id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("e"))
    for n in (1, 2, 3, 4, 299, 300):
        assert ranking.limit_rows(exploded, n).count() == n
    assert ranking.limit_rows(spark.createDataFrame([], "a int"), 5).count() == 0


def test_first_rows_of_an_order(numbered):
    found = ranking.first_rows(numbered, 30, [F.col("id").desc()])
    assert sorted(r.id for r in found.collect()) == list(range(970, 1000)) and found.columns == ["id", "v"]
    assert "Limit" not in plan_of(found)
    assert src.scan_pruned(numbered, ["v"], 40, ["v"]).count() == 40
    assert src.scan_pruned(numbered, ["v"], 40).count() == 40 and src.scan_pruned(numbered, ["v"]).count() == 1000
