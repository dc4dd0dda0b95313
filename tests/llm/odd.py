"""Documents with every awkward case, and a few plain ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# names that the operators use for their own columns
CLASHING = (
    "n size key part extra digest crc copies taken target source_size shard slot _group edge nth place start end "
    "component component_id id a b bands sketch version n_tokens least marks ids rank held_out score best _bit stretch "
    "_id _sha _lost _copies _n _crc _rank __id _hash word h run"
).split()
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
BASE = [f"word{i}" for i in range(200)]
TEXTS: list[str | None] = [
    None, "", " \t\n\x0b\x0c\r ", "one", "one two three", "One  TWO\tthree", LONG, " ".join(BASE), " ".join(BASE),
    " ".join(BASE[:100] + ["changed"] + BASE[100:]), " ".join(["lead"] * 5 + BASE[20:120]), "éß \U0001f389 中文 x",
    "a" * 5000, "<|endoftext|> x<|endoftext|>", "same words " * 60, "o n e", "tie b", "b tie",
]


def rows(texts: list[str | None] | None = None) -> list[tuple]:
    texts = TEXTS if texts is None else texts
    found = [(i, t, "en", None if i % 5 == 4 else f"src{i % 3}", None) for i, t in enumerate(texts)]
    found.append(found[min(7, len(found) - 1)])  # a row twice
    found.append((None, "no id", None, None, None))
    return found


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents(spark: SparkSession, texts: list[str | None] | None = None) -> DataFrame:
    df = spark.createDataFrame(rows(texts), SCHEMA).repartition(3)
    return df.selectExpr("*", *(f"'x' AS `{c}`" for c in CLASHING))


def no_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def ids_and_texts(texts: list[str | None] | None = None) -> list[tuple[int | None, str]]:
    return [(r[0], r[1] or "") for r in rows(texts)]
