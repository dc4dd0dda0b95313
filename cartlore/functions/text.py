"""Text building blocks: keys, embedding input, prompts, instruction records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
EMBED_MIN_CHARS = 20
EMBED_MAX_CHARS = 511
DEDUP_KEY_CHARS = 80
NO_CONTEXT = "No relevant reviews found."
CONTEXT_TITLE_CHARS = 60
CONTEXT_TEXT_CHARS = 500
ANSWER_PROMPT = (
    "[INST] Based on the following product reviews, answer the user's question. "
    "Be helpful, accurate, and concise. If the reviews don't contain enough information, say so.\n\n"
    "Reviews:\n{context}\n\nQuestion: {question} [/INST]"
)
SUMMARY_PROMPT = (
    "[INST] Summarize the following product review in 1-2 sentences. "
    "Include the overall sentiment (positive/negative/neutral).\n\n"
    "Product: {title}\nReview: {review}\n[/INST]"
)
ONE_REVIEW_SUMMARY_PROMPT = (
    "[INST] Summarize the following product review in 1-2 sentences. "
    "Include the overall sentiment (positive/negative/neutral).\n\n"
    "Product: {title}\nReview: {review} [/INST]"
)
ANALYSIS_PROMPT = (
    "[INST] You are a product intelligence analyst. Analyze each review for "
    '"{title}" (Category: {category}, Price: {price}, Avg Rating: {rating}).\n\n'
    "Respond ONLY with valid JSON (no markdown, no extra text):\n"
    '{"per_review": [{"sentiment": "positive|neutral|negative"}, ...],\n'
    ' "verdict": "<conditional buy/skip recommendation>",\n'
    ' "pros": ["pro1", "pro2", "pro3"], "cons": ["con1", "con2", "con3"],\n'
    ' "best_for": ["audience1", "audience2"],\n'
    ' "not_for": ["audience1", "audience2"],\n'
    ' "aspects": {"aspect_name": "positive|neutral|negative|mixed", ...},\n'
    ' "themes": ["theme1", "theme2", "theme3"]}\n\n'
    "Reviews:\n{reviews}\n[/INST]"
)
CLASSIFY_PROMPT = (
    "[INST] You are a review analyst. Classify this review and respond ONLY with valid JSON.\n\n"
    "{product}Review: {review}\n\n"
    'Required JSON: {{"sentiment": "positive|mixed|negative", '
    '"aspects": {{"aspect": "positive|negative", ...}}, '
    '"context_note": "brief note on how this compares to typical reviews"}}\n[/INST]'
)
SUMMARY_REVIEWS, SUMMARY_REVIEW_CHARS, SUMMARY_CHARS = 8, 200, 1500
ANALYSIS_REVIEWS, ANALYSIS_REVIEW_CHARS = 12, 250
CLASSIFY_REVIEW_CHARS = 500
ONE_REVIEW_CHARS = 500
# -----------------------------------------------------------------------------


def fill(template: str, **parts: Column) -> Column:
    """Put columns into the named places of a template; other braces stay text."""
    pieces: list[Column] = []
    rest = template
    while rest:
        hits = [(rest.find("{" + n + "}"), n) for n in parts if "{" + n + "}" in rest]
        if not hits:
            pieces.append(F.lit(rest))
            break
        at, name = min(hits)
        if at:
            pieces.append(F.lit(rest[:at]))
        pieces.append(parts[name])
        rest = rest[at + len(name) + 2 :]
    return F.concat(*pieces)


def review_id(user_id: Column, item_id: Column, epoch_ms: Column) -> Column:
    """SHA-256 of the three parts; a NULL part is left out."""
    return F.sha2(F.concat_ws("_", user_id, item_id, epoch_ms.cast("string")), 256)


def full_embed_text(title: Column, text: Column) -> Column:
    """Title and text with one blank between; a missing title leaves the blank in front."""
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit("")))


def embed_text(title: Column, text: Column, max_chars: int = EMBED_MAX_CHARS) -> Column:
    return full_embed_text(title, text).substr(1, max_chars)


def word_count(text: Column) -> Column:
    """Number of blank-separated tokens."""
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def join_nonempty(separator: str, *columns: Column) -> Column:
    return F.concat_ws(separator, *[F.nullif(c, F.lit("")) for c in columns])


def instruction_text(instruction: Column, context: Column, output: Column) -> Column:
    """Training line of an instruction record; empty input or output part is left out."""
    blank = F.lit("")
    head = F.concat(F.lit("[INST] "), F.coalesce(instruction, blank))
    middle = F.when(F.length(context) > 0, F.concat(F.lit("\n\n"), context)).otherwise(blank)
    tail = F.when(F.length(output) > 0, F.concat(F.lit(" "), output)).otherwise(blank)
    return F.concat(head, middle, F.lit(" [/INST]"), tail)


def rating_text(rating: Column) -> Column:
    """A rating as it is shown in a prompt, '?' when missing."""
    return F.coalesce(rating.cast("string"), F.lit("?"))
