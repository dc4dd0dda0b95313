"""File layouts: folders, JSON lines, shards, chunked parts, inventory."""

from __future__ import annotations

import json

import pytest
from conftest import REVIEW_ROWS, REVIEW_SCHEMA

from cartlore import schemas
from cartlore.sources import files
from cartlore.sources import reviews as src
from pyspark.sql import functions as F


def write_lines(path, rows, blank=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    lines = [r if isinstance(r, str) else json.dumps(r) for r in rows]
    path.write_text(("\n\n" if blank else "\n").join(lines) + "\n")


def test_path_category_and_scan(spark, tmp_path):
    df = spark.createDataFrame(REVIEW_ROWS, REVIEW_SCHEMA).drop("category")
    for name in ("Electronics", "Books"):
        df.write.parquet(f"{tmp_path}/raw/reviews/{name}")
    df.coalesce(1).write.parquet(f"{tmp_path}/raw/reviews_flat/Books")
    found = src.scan_reviews(spark, f"{tmp_path}/raw/reviews/*/", schemas.REVIEWS)
    counts = {r.category: r["count"] for r in found.groupBy("category").count().collect()}
    assert counts == {"Electronics": 5, "Books": 5}
    assert found.filter("event_timestamp = timestamp'2021-01-01'").count() == 2
    flat = src.scan_reviews(spark, f"{tmp_path}/raw/reviews_flat/*/")
    assert flat.select("category").distinct().collect()[0][0] == ""


def test_catalog_folders(spark, tmp_path):
    rows = [("a", "T", "None", "1.5", "None"), ("b", None, "Music", "None", "Acme")]
    for folder in ("Electronics_meta", "Books_meta"):
        spark.createDataFrame(rows, schemas.CATALOG).write.parquet(f"{tmp_path}/{folder}")
    found = src.scan_catalog(spark, {f"{tmp_path}/Electronics_meta": "Electronics", f"{tmp_path}/Books_meta": "Books"})
    assert sorted(r.main_category for r in found.collect()) == ["Books", "Electronics", "Music", "Music"]
    assert {r.brand for r in found.collect()} == {None, "Acme"}


def test_jsonl_ingest_skips_blank_lines(spark, tmp_path):
    row = {"user_id": "u", "parent_asin": "p", "rating": 4.0, "text": "x", "timestamp": 1}
    write_lines(tmp_path / "in" / "Books.jsonl", [row, row, row], blank=True)
    target = src.ingest_jsonl(spark, str(tmp_path / "in" / "Books.jsonl"), f"{tmp_path}/raw/reviews", "Books", rows_per_file=2)
    assert spark.read.parquet(target).count() == 3
    assert len(files.glob(spark, f"{target}/*.parquet")) == 2  # two rows, one row


def test_malformed_line_fails(spark, tmp_path):
    write_lines(tmp_path / "bad.jsonl", [{"user_id": "u"}, '{"user_id": '])
    with pytest.raises(Exception):
        src.read_jsonl(spark, str(tmp_path / "bad.jsonl"), schemas.REVIEWS).collect()


def test_catalog_prefers_shards(spark, tmp_path):
    assert src.ingest_catalog(spark, str(tmp_path), "Books") is None
    write_lines(tmp_path / "meta_categories" / "meta_Books.jsonl", [{"parent_asin": "j", "features": ["a"]}])
    assert [r.parent_asin for r in src.ingest_catalog(spark, str(tmp_path), "Books").collect()] == ["j"]
    spark.createDataFrame([("s", "T", "Books", "1", "B")], schemas.CATALOG).write.parquet(f"{tmp_path}/raw_meta_Books")
    assert [r.parent_asin for r in src.ingest_catalog(spark, str(tmp_path), "Books").collect()] == ["s"]


def test_instruction_split(spark, tmp_path):
    assert src.scan_split(spark, str(tmp_path), "train") is None
    record = {"instruction": "i", "input": "", "output": "o"}
    write_lines(tmp_path / "train" / "a.jsonl", [record])
    write_lines(tmp_path / "train" / "b.txt", [record, record])
    write_lines(tmp_path / "train" / "part-00000", [record] * 4)
    write_lines(tmp_path / "train" / "notes.md", ["ignored"])
    spark.createDataFrame([("i", "", "o")] * 8, schemas.INSTRUCTIONS).coalesce(1).write.parquet(f"{tmp_path}/train/z.parquet")
    assert src.scan_split(spark, str(tmp_path), "train").count() == 15
    assert src.scan_split(spark, str(tmp_path), "train", max_files=2).count() == 3


def test_chunked_parts_and_inventory(spark, tmp_path):
    src.write_chunked(spark.range(10).coalesce(1), f"{tmp_path}/out", rows_per_file=3)
    listing = files.file_inventory(spark, f"{tmp_path}/out")
    summary = files.inventory_summary(listing, first=2).first()
    assert (summary.n_files, len(summary.first_files)) == (4, 2)
    assert summary.total_bytes == listing.agg(F.sum("size_bytes")).first()[0] > 0
    assert all("snappy" in r.file_name for r in listing.collect())


def test_training_sink_partitions(spark, tmp_path):
    assert src.write_training(spark.range(10), f"{tmp_path}/t", 4) == 10
    assert src.write_training(spark.range(64), f"{tmp_path}/t", 4) == 64
    assert len(files.glob(spark, f"{tmp_path}/t/*.parquet")) == 4
    assert spark.read.parquet(f"{tmp_path}/t").count() == 64


def test_stringify(spark):
    df = spark.createDataFrame([(1, None, ["a"]), (2, "x", None)], "n int, s string, l array<string>")
    rows = src.stringify(df).orderBy("n").collect()
    assert [tuple(r) for r in rows] == [(1, "None", '["a"]'), (2, "x", "None")]


def test_bounded_partition_writer(spark, tmp_path):
    target = str(tmp_path)

    def send(chunk):
        import uuid

        with open(f"{target}/{uuid.uuid4()}", "w") as out:
            out.write("\n".join(str(r.id) for r in chunk))

    src.write_in_chunks(spark.range(25), send, partitions=2, chunk_rows=5)
    chunks = [p.read_text().split("\n") for p in tmp_path.iterdir()]
    assert max(len(c) for c in chunks) <= 5
    assert sorted(int(x) for c in chunks for x in c) == list(range(25))


def test_pruning_and_pushdown_reach_the_scan(spark):
    from cartlore.plans.views import window_filter

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = window_filter(events, "2024-01-08", "2024-01-15", ts="ts").select("event_id")
    text = plan._sc._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(ts" in text and "LessThan(ts" in text
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in text


def test_partition_folders_are_pruned(spark, tmp_path):
    df = spark.createDataFrame(REVIEW_ROWS, REVIEW_SCHEMA)
    df.write.partitionBy("category").parquet(f"{tmp_path}/reviews")
    found = src.scan_reviews(spark, f"{tmp_path}/reviews").filter("category = 'Electronics'")
    plan = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
    assert "PartitionFilters: [isnotnull(category" in plan
    assert found.count() == 4
