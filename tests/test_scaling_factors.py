"""Factor training on many shuffle partitions."""

from __future__ import annotations

from cartlore.operators import recommend
from cartlore.session import shuffle_partitions


def test_factor_training_has_few_blocks_and_drops_its_shuffles(spark, monkeypatch):
    seen = {}
    real = recommend.ALS

    def als(**options):
        seen.update(options)
        return real(**options)

    monkeypatch.setattr(recommend, "ALS", als)
    before = shuffle_partitions(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        rows = spark.createDataFrame([(f"u{i % 7}", f"i{i % 5}", 1.0) for i in range(40)], "user_id string, item_id string, label double")
        users, items = recommend.fit_factors(rows, rank=2, iterations=2)
        assert (users.count(), items.count()) == (7, 5)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", str(before))
    assert seen["checkpointInterval"] == 1
    assert seen["numUserBlocks"] == seen["numItemBlocks"] == spark.sparkContext.defaultParallelism


def test_factors_in_turns_are_the_same_and_blocks_follow_the_numbers_they_hold(spark, monkeypatch):
    """Weights made in parts of the keys; a block holds pairs in proportion to the length of their vectors, so short vectors need fewer copies."""
    blocks, real = [], recommend.ALS

    def als(**options):
        blocks.append(options["numUserBlocks"])
        return real(**options)

    monkeypatch.setattr(recommend, "ALS", als)
    rows = [(f"u{i % 7}" if i % 9 else None, f"i{i % 5}", 1.0) for i in range(40)]
    given = spark.createDataFrame(rows, "user_id string, item_id string, label double")
    found = []
    for rank, numbers, turns in ((2, 1 << 28, 1), (2, 1 << 28, 3), (1, 7, 1)):
        monkeypatch.setattr(recommend, "BLOCK_NUMBERS", numbers)
        users, items = recommend.fit_factors(given, rank=rank, iterations=2, turns=turns)
        found.append({r[0]: r["vector"] for side in (users, items) for r in side.collect()})
    assert found[0].keys() == found[1].keys() and len(found[0]) == 12
    assert all(abs(a - b) < 1e-4 for key, vector in found[0].items() for a, b in zip(vector, found[1][key]))
    assert blocks[0] == blocks[1] == spark.sparkContext.defaultParallelism
