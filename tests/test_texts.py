"""Labels, answer parsing, prompts."""

from __future__ import annotations

import pytest

from cartlore.functions import answers, categories, signals
from cartlore.functions import text as t
from cartlore.operators import assembly
from pyspark.sql import functions as F


def column(spark, rows, kind, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", fn(F.col("v"))).orderBy("i").collect()]


def test_bands_and_flags(spark):
    assert column(spark, [0.0, 299.9, 300.0, 1999.9, 2000.0, None], "double", signals.latency_band) == ["fast", "fast", "ok", "ok", "slow", None]
    assert column(spark, [1.6, 1.5, 0.5, 0.4, None], "double", signals.polarization_flag) == ["vary widely", None, None, "consistent", None]
    assert column(spark, [51, 50, 1, 0, None], "int", signals.credibility_flag) == ["strong", "some", "some", None, None]


def test_sentiment_words(spark):
    assert column(spark, ["Positive, not negative", "Negative!", "fine"], "string", signals.response_sentiment) == ["positive", "negative", "neutral"]
    given = ["neutral", "NEUTRAL", "great but BROKEN", "Comfortable", "meh", None]
    assert column(spark, given, "string", signals.lexicon_sentiment) == ["neutral", "mixed", "negative", "positive", "mixed", None]


def test_categories(spark):
    raw = ["Camera & Photo", "Office Products", "Software", "Buy a Kindle", "Garden", "None", None]
    assert column(spark, raw, "string", categories.super_category) == [
        "Photography & Audio", "DIY & Outdoors", "Tech & Computing", "Books & Media", "Home & Living", None, None,
    ]
    ids = ["B09X", "B01X", "B00X", "B0ZX", "19X", "1X", "0316", "05", "X"]
    assert column(spark, ids, "string", categories.prefix_category) == [
        "Electronics", "Gadgets & Accessories", "Home & Living", "Tech & Computing",
        "Books & Media", "Books & Media", "Books & Media", "Books & Media", "General",
    ]


ANSWERS = [
    ('x {"aspects": {"a": "good"}} y', {"a": "good"}),
    ('{"aspects": [{"aspect": "a", "sentiment": "s", "value": "v"}, {"name": "b", "value": "w"}, {"value": "lost"}]}', {"a": "s", "b": "w"}),
    ('{"aspects": ["a", {"aspect": "a", "sentiment": "later"}, "b"]}', {"a": "later", "b": "mixed"}),
    ('{"aspects": "text"}', {}),
    ('{"aspects": {"a": ', {}),
    ("no object", {}),
    ('{"a": 1} {"b": 2}', {}),
    (None, {}),
]


def test_aspects(spark):
    found = column(spark, [a for a, _ in ANSWERS], "string", lambda c: answers.aspect_map(answers.json_object(c)))
    assert found == [m for _, m in ANSWERS]
    card = column(spark, [ANSWERS[1][0]], "string", lambda c: answers.aspect_map(answers.json_object(c), answers.CARD_VALUE_KEYS))
    assert card == [{"a": "v", "b": "w"}]


def test_fallback_and_fields(spark):
    df = spark.createDataFrame([('{"pros": ["x", "y"]}', '{"verdict": "2"}'), ("{broken", 'say {"verdict": "buy"}'), ("", None)], "a string, b string")
    one, two = answers.json_object(F.col("a")), answers.json_object(F.col("b"))
    parsed = answers.first_readable(one, two)
    rows = df.select(
        answers.field_text(parsed, "verdict"), answers.field_list(parsed, "pros"), answers.used_model(["m1", "m2"], [one, two])
    ).collect()
    assert [tuple(r) for r in rows] == [(None, ["x", "y"], "m1"), ("buy", None, "m2"), (None, None, None)]


def test_instruction_text(spark):
    df = spark.createDataFrame([("do", "it", "done"), ("do", "", "done"), ("do", None, None)], "instruction string, input string, output string")
    assert [r.text for r in assembly.format_instructions(df).collect()] == [
        "[INST] do\n\nit [/INST] done", "[INST] do [/INST] done", "[INST] do [/INST]",
    ]


def test_context_order_and_fallback(spark):
    questions = spark.createDataFrame([("q1", "ok?"), ("q2", "ok?")], "key string, question string")
    hits = spark.createDataFrame(
        [("q1", 2, 3.0, None, "b" * 600), ("q1", 1, 5.0, "t" * 70, "a"), ("q1", 3, None, "", None), ("q1", 4, 1.0, "x", "cut")],
        "key string, rank int, rating double, title string, text string",
    )
    rows = {r.key: r.context for r in assembly.rag_context(questions, hits, "key", 3).collect()}
    assert rows["q2"] == t.NO_CONTEXT
    assert rows["q1"] == "\n\n".join(
        [f"Review 1 (5.0/5 stars) — {'t' * 60}: a", f"Review 2 (3.0/5 stars): {'b' * 500}", "Review 3 (?/5 stars): "]
    )


def test_prompts(spark):
    reviews = spark.createDataFrame([("p", i, f"{i} " + "x" * 400) for i in range(1, 15)], "key string, rank int, text string")
    products = spark.createDataFrame([("p", None, "Books", 5.0, 4.25), ("none", "N", "", None, None)], "key string, title string, category string, price double, avg_rating double")
    summary = assembly.summary_prompt(products, reviews, "key").collect()
    assert len(summary) == 1 and "Product: Unknown\n" in summary[0].prompt
    body = summary[0].prompt.split("Review: ")[1].removesuffix("\n[/INST]")
    assert len(body) == 1500 and body.startswith("1 xxx") and " | 2 x" in body
    analysis = assembly.analysis_prompt(products, reviews, "key").first().prompt
    assert '"Unknown" (Category: Books, Price: $5.00, Avg Rating: 4.25)' in analysis
    assert "Review 12: 12 x" in analysis and "Review 13" not in analysis and '{"per_review"' in analysis


def test_classify_prompt(spark):
    rows = [("bad", "T", "C", 40), ("bad", "T", None, None), ("bad", None, "C", 40), ("y" * 900, "", None, None)]
    prompts = [r.prompt for r in assembly.classify_prompt(spark.createDataFrame(rows, "text string, title string, category string, pos_pct int")).collect()]
    assert "Product: T (C)\nAggregate sentiment: 40% positive\nReview: bad\n" in prompts[0]
    assert "Product: T ()\nReview: bad\n" in prompts[1]
    assert "Product" not in prompts[2] and "y" * 500 + "\n" in prompts[3] and "y" * 501 not in prompts[3]
    assert '{{"sentiment": "positive|mixed|negative"' in prompts[0]


def test_sentiment_percentages(spark):
    rows = [("p", x) for x in ["positive"] * 2 + ["negative", "other"]] + [("q", "other")]
    found = {r.key: r for r in assembly.sentiment_summary(spark.createDataFrame(rows, "key string, sentiment string"), "key").collect()}
    p, q = found["p"], found["q"]
    assert (p.total, p.pos_pct, p.neu_pct, p.neg_pct) == (3, 66, 0, 33)
    assert (q.total, q.pos_pct) == (1, 0)


def test_average_rating_falls_back(spark):
    df = spark.createDataFrame([("p", 0.0, 3.3), ("p", None, 3.3), ("q", 4.0, 1.0), ("q", 0.0, 1.0)], "key string, rating double, item_avg double")
    assert {r.key: r.avg_rating for r in assembly.avg_rating_or(df, "key", F.col("item_avg")).collect()} == {"p": 3.3, "q": 4.0}


@pytest.mark.parametrize(("text", "n"), [("a  b\tc\n d ", 4), ("", 0), ("one", 1), ("x y", 2)])
def test_word_count(spark, text, n):
    assert column(spark, [text], "string", t.word_count) == [n]


def test_join_nonempty(spark):
    df = spark.createDataFrame([("a", "", None), (None, None, None)], "x string, y string, z string")
    line = t.join_nonempty(" · ", F.col("x"), F.col("y"), F.lit("b"))
    assert [r[0] for r in df.select(line).collect()] == ["a · b", "b"]


def test_labels_and_lists_of_an_answer(spark):
    given = ['{"per_review": [{"sentiment": "positive"}, "negative", {"x": 1}, 3], "themes": ["1","2","3","4","5","6","7"]}', '{"per_review": "none"}', "text"]
    labels = column(spark, given, "string", lambda c: answers.review_sentiments(answers.json_object(c)))
    assert labels == [["positive", "negative", "", ""], [], []]
    df = spark.createDataFrame([(g,) for g in given], "v string")
    rows = df.select(*[c.alias(n) for n, c in answers.card_fields(answers.json_object(F.col("v"))).items()]).collect()
    assert [len(r.themes) for r in rows] == [6, 0, 0] and [r.verdict for r in rows] == ["", "", ""]
