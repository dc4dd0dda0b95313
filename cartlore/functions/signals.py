"""Labels read off numbers and short texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
FAST_BELOW_MS = 300
OK_BELOW_MS = 2000
WIDE_SPREAD_ABOVE = 1.5
TIGHT_SPREAD_BELOW = 0.5
STRONG_VOTES_ABOVE = 50
SENTIMENT_LABELS = ["positive", "negative", "mixed", "neutral"]
NEGATIVE_WORDS = [
    "bad", "poor", "terrible", "awful", "worst", "broken",
    "slow", "dim", "cheap", "flimsy", "fails", "disappointing",
]
POSITIVE_WORDS = [
    "great", "excellent", "good", "amazing", "fantastic", "fast",
    "solid", "love", "perfect", "best", "comfortable", "smooth",
]
BOOST_FACTOR = 1.15
# -----------------------------------------------------------------------------


def latency_band(ms: Column) -> Column:
    return F.when(ms < FAST_BELOW_MS, "fast").when(ms < OK_BELOW_MS, "ok").when(ms.isNotNull(), "slow")


def polarization_flag(stddev: Column) -> Column:
    return F.when(stddev > WIDE_SPREAD_ABOVE, "vary widely").when(stddev < TIGHT_SPREAD_BELOW, "consistent")


def credibility_flag(votes: Column) -> Column:
    return F.when(votes > STRONG_VOTES_ABOVE, "strong").when(votes > 0, "some")


def response_sentiment(text: Column) -> Column:
    """Sentiment word found in a generated answer; 'positive' is looked for first."""
    low = F.lower(text)
    return (
        F.when(low.contains("positive"), "positive")
        .when(low.contains("negative"), "negative")
        .when(text.isNotNull(), "neutral")
    )


def _has_word(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(words))


def lexicon_sentiment(value: Column) -> Column:
    """A label stays; other text is judged by the word lists, negative words first."""
    low = F.lower(value)
    return (
        F.when(value.isin(SENTIMENT_LABELS), value)
        .when(_has_word(low, NEGATIVE_WORDS), "negative")
        .when(_has_word(low, POSITIVE_WORDS), "positive")
        .when(value.isNotNull(), "mixed")
    )


def boosted_score(score: Column, matches: Column) -> Column:
    return F.when(matches, F.least(score * F.lit(BOOST_FACTOR), F.lit(1.0))).otherwise(score)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def round4(x: Column) -> Column:
    return F.round(x, 4)
