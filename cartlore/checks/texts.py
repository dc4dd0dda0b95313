"""Scalar functions, text assembly and answer parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers, categories, signals, vectors
from ..functions import text as t
from ..operators import assembly
from . import frames as fr
from .base import Checks

checks = Checks()
load, sql = fr.load, fr.sql

ASIN = "concat(lpad(CAST(l_orderkey % 31 AS VARCHAR), 2, '0'), 'x')"


@checks.add("review_id", sql("doc_reviews", "SELECT doc_key, sha256(concat_ws('_', user_id, parent_asin, CAST(ts_ms AS VARCHAR))) AS review_id FROM doc_reviews"))
def review_id(spark, sf):
    key = t.review_id(F.col("user_id"), F.col("parent_asin"), F.col("timestamp"))
    return fr.doc_reviews(spark, sf).select("doc_key", key.alias("review_id"))


@checks.add("embed_text", sql("doc_reviews", "SELECT doc_key, substr(coalesce(title, '') || ' ' || coalesce(text, ''), 1, 511) AS embed_text FROM doc_reviews"))
def embed_text(spark, sf):
    return fr.doc_reviews(spark, sf).select("doc_key", t.embed_text(F.col("title"), F.col("text")).alias("embed_text"))


@checks.add("text_length", sql("reviews", "SELECT row_key, CAST(length(text) AS INTEGER) AS n_chars FROM reviews"))
def text_length(spark, sf):
    return fr.reviews(spark, sf).select("row_key", F.length("text").alias("n_chars"))


@checks.add("regex_category", "SELECT page_id, regexp_extract(url, '/([^/]+)/', 1) AS host, regexp_extract(concat('s3://raw/reviews/', regexp_extract(url, '/([a-z]{2})/', 1), '/part-0.parquet'), '/reviews/([^/]+)/', 1) AS category FROM pages")
def regex_category(spark, sf):
    """A review path made from each page's language folder."""
    folder = F.regexp_extract("url", "/([a-z]{2})/", 1)
    path = F.concat(F.lit("s3://raw/reviews/"), folder, F.lit("/part-0.parquet"))
    return load(spark, sf, "pages").select(
        "page_id",
        F.regexp_extract("url", "/([^/]+)/", 1).alias("host"),
        categories.path_category(path).alias("category"),
    )


@checks.add("super_category", sql("catalog", f"SELECT parent_asin, copy_no, {fr.SUPER.format(c='main_category')} AS super FROM catalog"))
def super_category(spark, sf):
    return load(spark, sf, "catalog").select(
        "parent_asin", "copy_no", categories.super_category(F.col("main_category")).alias("super")
    )


PREFIX_SQL = """CASE WHEN regexp_matches(a, '^B0[987]') THEN 'Electronics' WHEN starts_with(a, 'B01') THEN 'Gadgets & Accessories'
    WHEN starts_with(a, 'B00') THEN 'Home & Living' WHEN starts_with(a, 'B0') THEN 'Tech & Computing'
    WHEN regexp_matches(a, '^[01]') THEN 'Books & Media' ELSE 'General' END"""


@checks.add(
    "prefix_category",
    f"""SELECT o_orderkey, a, {PREFIX_SQL} AS category FROM (
          SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN concat('B', lpad(CAST(o_orderkey % 23 AS VARCHAR), 2, '0'))
                                  ELSE lpad(CAST(o_orderkey % 97 AS VARCHAR), 2, '0') END AS a FROM orders)""",
)
def prefix_category(spark, sf):
    key = F.col("o_orderkey")

    def two(n: int):
        return F.lpad((key % n).cast("string"), 2, "0")

    made = F.when(key % 2 == 0, F.concat(F.lit("B"), two(23))).otherwise(two(97))
    return load(spark, sf, "orders").select("o_orderkey", made.alias("a")).withColumn(
        "category", categories.prefix_category(F.col("a"))
    )


@checks.add("latency_band", sql("requests", "SELECT request_id, CASE WHEN ms < 300 THEN 'fast' WHEN ms < 2000 THEN 'ok' ELSE 'slow' END AS band FROM (SELECT request_id, latency_ms * 5 AS ms FROM requests)"))
def latency_band(spark, sf):
    return load(spark, sf, "requests").select("request_id", signals.latency_band(F.col("latency_ms") * 5).alias("band"))


@checks.add(
    "polarization_flag",
    sql(
        "reviews",
        f"""SELECT item_id, CASE WHEN item_rating_stddev > 1.5 THEN 'vary widely' WHEN item_rating_stddev < 0.5 THEN 'consistent' END AS flag
            FROM ({fr.ITEM_FEATURES}) f""",
    ),
)
def polarization_flag(spark, sf):
    return fr.item_features(spark, sf).select("item_id", signals.polarization_flag(F.col("item_rating_stddev")).alias("flag"))


@checks.add(
    "credibility_flag",
    sql(
        "reviews",
        f"""SELECT item_id, CASE WHEN item_total_helpful_votes > 50 THEN 'strong' WHEN item_total_helpful_votes > 0 THEN 'some' END AS flag
            FROM ({fr.ITEM_FEATURES}) f""",
    ),
)
def credibility_flag(spark, sf):
    return fr.item_features(spark, sf).select("item_id", signals.credibility_flag(F.col("item_total_helpful_votes")).alias("flag"))


@checks.add(
    "response_sentiment",
    sql(
        "analysis",
        """SELECT doc_id, CASE WHEN contains(lower(raw), 'positive') THEN 'positive' WHEN contains(lower(raw), 'negative') THEN 'negative'
                               ELSE 'neutral' END AS sentiment FROM analysis""",
    ),
)
def response_sentiment(spark, sf):
    return load(spark, sf, "analysis").select("doc_id", signals.response_sentiment(F.col("raw")).alias("sentiment"))


NEG = "bad|poor|terrible|awful|worst|broken|slow|dim|cheap|flimsy|fails|disappointing"
POS = "great|excellent|good|amazing|fantastic|fast|solid|love|perfect|best|comfortable|smooth"
LEXICON = f"""CASE WHEN {{v}} IN ('positive', 'negative', 'mixed', 'neutral') THEN {{v}}
    WHEN regexp_matches(lower({{v}}), '{NEG}') THEN 'negative' WHEN regexp_matches(lower({{v}}), '{POS}') THEN 'positive'
    WHEN {{v}} IS NOT NULL THEN 'mixed' END"""


@checks.add("lexicon_sentiment", f"SELECT doc_id, {LEXICON.format(v='text')} AS sentiment FROM documents")
def lexicon_sentiment(spark, sf):
    return load(spark, sf, "documents").select("doc_id", signals.lexicon_sentiment(F.col("text")).alias("sentiment"))


# --- answers ---------------------------------------------------------------------

OBJECT = r"nullif(regexp_extract({c}, '(?s)(\{{.*\}})', 1), '')"
PARSED = """, p AS (SELECT doc_id, TRY_CAST({a} AS JSON) AS j, TRY_CAST({b} AS JSON) AS j2 FROM analysis)""".format(
    a=OBJECT.format(c="raw"), b=OBJECT.format(c="raw_second")
)


def _parsed(spark, sf):
    return load(spark, sf, "analysis").select(
        "doc_id", answers.json_object(F.col("raw")).alias("j"), answers.json_object(F.col("raw_second")).alias("j2")
    )


@checks.add("extract_json", sql("analysis", PARSED + "SELECT doc_id, j IS NOT NULL AS readable, j->>'$.sentiment' AS sentiment, CAST(coalesce(json_array_length(j, '$.pros'), 0) AS INTEGER) AS n_pros FROM p"))
def extract_json(spark, sf):
    return _parsed(spark, sf).select(
        "doc_id",
        F.col("j").isNotNull().alias("readable"),
        answers.field_text(F.col("j"), "sentiment").alias("sentiment"),
        F.greatest(F.size(answers.field_list(F.col("j"), "pros")), F.lit(0)).alias("n_pros"),
    )


@checks.add(
    "model_fallback",
    sql(
        "analysis",
        PARSED + "SELECT doc_id, coalesce(j, j2)->>'$.sentiment' AS sentiment, CASE WHEN j IS NOT NULL THEN 'tuned' WHEN j2 IS NOT NULL THEN 'base' END AS model FROM p",
    ),
)
def model_fallback(spark, sf):
    first, second = F.col("j"), F.col("j2")
    return _parsed(spark, sf).select(
        "doc_id",
        answers.field_text(answers.first_readable(first, second), "sentiment").alias("sentiment"),
        answers.used_model(["tuned", "base"], [first, second]).alias("model"),
    )


@checks.add(
    "normalize_aspects",
    sql(
        "analysis",
        PARSED
        + """SELECT doc_id,
               CASE json_type(j, '$.aspects') WHEN 'OBJECT' THEN j->>'$.aspects.battery'
                    WHEN 'ARRAY' THEN CASE json_type(j, '$.aspects[0]') WHEN 'OBJECT' THEN j->>'$.aspects[0].sentiment' ELSE 'mixed' END END AS battery,
               CASE json_type(j, '$.aspects') WHEN 'ARRAY' THEN 'mixed' END AS screen,
               CAST(CASE json_type(j, '$.aspects') WHEN 'OBJECT' THEN 1 WHEN 'ARRAY' THEN json_array_length(j, '$.aspects') ELSE 0 END AS INTEGER) AS n
             FROM p""",
    ),
)
def normalize_aspects(spark, sf):
    mapped = _parsed(spark, sf).select("doc_id", answers.aspect_map(F.col("j")).alias("m"))
    return mapped.select(
        "doc_id",
        F.try_element_at("m", F.lit("battery")).alias("battery"),
        F.try_element_at("m", F.lit("screen")).alias("screen"),
        F.size("m").alias("n"),
    )


@checks.add(
    "answer_sentiments",
    sql(
        "review_answers",
        """, s AS (SELECT doc_id, unnest([raw->>'$.per_review[0].sentiment', raw->>'$.per_review[1]', '']) AS sentiment FROM review_answers),
            c AS (SELECT doc_id, count(*) FILTER (WHERE sentiment = 'positive') AS positive, count(*) FILTER (WHERE sentiment = 'neutral') AS neutral,
                         count(*) FILTER (WHERE sentiment = 'negative') AS negative FROM s GROUP BY doc_id),
            t AS (SELECT *, greatest(positive + neutral + negative, 1) AS total FROM c)
           SELECT *, CAST(trunc(positive / total * 100) AS INTEGER) AS pos_pct, CAST(trunc(neutral / total * 100) AS INTEGER) AS neu_pct,
                  CAST(trunc(negative / total * 100) AS INTEGER) AS neg_pct FROM t""",
    ),
)
def answer_sentiments(spark, sf):
    """Labels of all reviews in an answer, counted per answer."""
    parsed = answers.json_object(F.col("raw"))
    labels = F.explode(answers.review_sentiments(parsed)).alias("sentiment")
    return assembly.sentiment_summary(load(spark, sf, "review_answers").select("doc_id", labels), "doc_id")


@checks.add(
    "answer_card",
    sql(
        "review_answers",
        """SELECT doc_id, raw->>'$.verdict' AS verdict, 'a b c d e' AS pros, CASE WHEN doc_id % 2 = 0 THEN 'x' ELSE '' END AS cons,
                  '' AS best_for, '' AS not_for, '' AS themes FROM review_answers""",
    ),
)
def answer_card(spark, sf):
    fields = answers.card_fields(answers.json_object(F.col("raw")))
    shown = [c.alias(n) if n == "verdict" else F.array_join(c, " ").alias(n) for n, c in fields.items()]
    return load(spark, sf, "review_answers").select("doc_id", *shown)


@checks.add("join_nonempty", sql("catalog", "SELECT parent_asin, copy_no, concat_ws(' · ', nullif(store, ''), nullif(main_category, '')) AS line FROM catalog"))
def join_nonempty(spark, sf):
    line = t.join_nonempty(" · ", F.col("store"), F.col("main_category")).alias("line")
    return load(spark, sf, "catalog").select("parent_asin", "copy_no", line)


@checks.add("sigmoid", "SELECT event_id, round(1 / (1 + exp(-(value - 50) / 20)), 9) AS score FROM events")
def sigmoid(spark, sf):
    score = signals.sigmoid((F.col("value") - 50) / 20)
    return load(spark, sf, "events").select("event_id", F.round(score, 9).alias("score"))


@checks.add("round4", "SELECT event_id, round(1 / (1 + exp(-(value - 50) / 20)), 4) AS score FROM events")
def round4(spark, sf):
    score = signals.round4(signals.sigmoid((F.col("value") - 50) / 20))
    return load(spark, sf, "events").select("event_id", score.alias("score"))


@checks.add(
    "l2_normalize",
    """SELECT vec_id, round(list_sum(list_transform(v, lambda x: x / n)), 6) AS unit_sum, round(sqrt(list_inner_product(v, v)) / n, 6) AS unit_norm
       FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3) AS v,
                    sqrt(list_inner_product(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3), list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3))) AS n
             FROM embeddings)""",
)
def l2_normalize(spark, sf):
    scaled = F.transform("embedding", lambda x: x.cast("double") * 3)
    unit = load(spark, sf, "embeddings").select("vec_id", vectors.l2_normalize(scaled).alias("u"))
    total = F.aggregate("u", F.lit(0.0), lambda a, x: a + x)
    return unit.select("vec_id", F.round(total, 6).alias("unit_sum"), F.round(vectors.norm(F.col("u")), 6).alias("unit_norm"))


LABEL_SUMS = """WITH c AS (SELECT label, list(s ORDER BY pos) AS v FROM (
    SELECT label, pos, sum(CAST(embedding[pos] AS DOUBLE)) AS s FROM embeddings, (SELECT unnest(range(1, 65)) AS pos) GROUP BY label, pos) GROUP BY label)"""


def _with_label_sum(spark, sf):
    """Every vector beside the sum vector of its label."""
    rows = load(spark, sf, "embeddings")
    cells = rows.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(
        F.sum(F.col("x").cast("double")).alias("s")
    )
    sums = cells.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda c: c["s"]).alias("v")
    )
    return rows.join(sums, "label")


@checks.add("dot_product", LABEL_SUMS + "SELECT vec_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), v), 6) AS dot FROM embeddings JOIN c USING (label)")
def dot_product(spark, sf):
    dot = vectors.dot(F.col("embedding"), F.col("v"))
    return _with_label_sum(spark, sf).select("vec_id", F.round(dot, 6).alias("dot"))


@checks.add("cosine", LABEL_SUMS + "SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 6) AS cosine FROM embeddings JOIN c USING (label)")
def cosine(spark, sf):
    value = vectors.cosine(F.col("embedding"), F.col("v"))
    return _with_label_sum(spark, sf).select("vec_id", F.round(value, 6).alias("cosine"))


@checks.add("array_slice", "SELECT doc_id, CAST(len(string_split(text, ' ')[1:8]) AS INTEGER) AS n, string_split(text, ' ')[1:8][-1] AS last_word FROM documents")
def array_slice(spark, sf):
    words = F.slice(F.split("text", " "), 1, 8)
    return load(spark, sf, "documents").select("doc_id", F.size(words).alias("n"), F.element_at(words, -1).alias("last_word"))


@checks.add("array_join", "SELECT doc_id, array_to_string(string_split(text, ' '), ' · ') AS words FROM documents")
def array_join(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.array_join(F.split("text", " "), " · ").alias("words"))


@checks.add("word_count", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[^\s]+')) AS INTEGER) AS n_words FROM documents")
def word_count(spark, sf):
    return load(spark, sf, "documents").select("doc_id", t.word_count(F.col("text")).alias("n_words"))


# --- assembly ----------------------------------------------------------------------


@checks.add(
    "instruction_format",
    sql(
        "instruction",
        """SELECT conv_id, turn, '[INST] ' || instruction || CASE WHEN input <> '' THEN E'\\n\\n' || input ELSE '' END || ' [/INST]'
                  || CASE WHEN output <> '' THEN ' ' || output ELSE '' END AS text FROM instruction""",
    ),
)
def instruction_format(spark, sf):
    return assembly.format_instructions(load(spark, sf, "instruction")).select("conv_id", "turn", "text")


CONTEXT = """, q AS (SELECT concat('P', CAST(p_partkey AS VARCHAR)) AS parent_asin, p_name AS question FROM part),
    ctx AS (SELECT parent_asin, string_agg('Review ' || rank || ' (' || CAST(rating AS VARCHAR) || '/5 stars)'
              || CASE WHEN title <> '' THEN ' — ' || substr(title, 1, 60) ELSE '' END || ': ' || substr(coalesce(text, ''), 1, 500), E'\\n\\n' ORDER BY rank) AS context
            FROM (SELECT parent_asin, CAST(hit_rank AS INTEGER) AS rank, rating, title, text FROM doc_reviews WHERE hit_rank <= 5) GROUP BY parent_asin),
    answered AS (SELECT parent_asin, question, coalesce(context, 'No relevant reviews found.') AS context FROM q LEFT JOIN ctx USING (parent_asin))"""


def _context(spark, sf):
    questions = load(spark, sf, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("parent_asin"), F.col("p_name").alias("question")
    )
    hits = fr.doc_reviews(spark, sf).withColumnRenamed("hit_rank", "rank")
    return assembly.rag_context(questions, hits, "parent_asin", 5)


@checks.add("rag_context", sql("doc_reviews", CONTEXT + " SELECT parent_asin, question, context FROM answered"))
def rag_context(spark, sf):
    return _context(spark, sf).select("parent_asin", "question", "context")


def template_sql(template: str, **parts: str) -> str:
    """A template as a DuckDB concatenation with the named places replaced by expressions."""
    pieces = [template]
    for name, expression in parts.items():
        split = []
        for piece in pieces:
            if isinstance(piece, tuple):
                split.append(piece)
                continue
            before, mark, after = piece.partition("{" + name + "}")
            split.extend([before, (expression,), after] if mark else [piece])
        pieces = split
    texts = [f"({p[0]})" if isinstance(p, tuple) else "'" + p.replace("'", "''") + "'" for p in pieces if p]
    return " || ".join(texts)


@checks.add(
    "rag_prompt",
    sql("doc_reviews", CONTEXT + f" SELECT parent_asin, {template_sql(t.ANSWER_PROMPT, context='context', question='question')} AS prompt FROM answered"),
)
def rag_prompt(spark, sf):
    return assembly.rag_prompt(_context(spark, sf)).select("parent_asin", "prompt")


PRODUCTS = """, products AS (SELECT DISTINCT parent_asin, CASE WHEN parent_asin = 'P7' THEN NULL ELSE 'Thing ' || parent_asin END AS title,
      'Books' AS category, CASE WHEN parent_asin = 'P3' THEN NULL ELSE 12.5::DOUBLE END AS price FROM doc_reviews),
    avgs AS (SELECT parent_asin, avg(rating) AS avg_rating FROM doc_reviews GROUP BY 1)"""


def _products(spark, sf):
    rows = fr.doc_reviews(spark, sf)
    key = F.col("parent_asin")
    return rows.groupBy("parent_asin").agg(F.avg("rating").alias("avg_rating")).select(
        "parent_asin",
        F.when(key != "P7", F.concat(F.lit("Thing "), key)).alias("title"),
        F.lit("Books").alias("category"),
        F.when(key != "P3", F.lit(12.5)).alias("price"),
        "avg_rating",
    )


def _ranked(spark, sf):
    return fr.doc_reviews(spark, sf).select("parent_asin", F.col("hit_rank").alias("rank"), "text")


@checks.add(
    "summary_prompt",
    sql(
        "doc_reviews",
        PRODUCTS
        + f""", texts AS (SELECT parent_asin, string_agg(substr(coalesce(text, ''), 1, 200), ' | ' ORDER BY hit_rank) AS txt
                          FROM doc_reviews WHERE hit_rank <= 8 GROUP BY parent_asin)
              SELECT parent_asin, {template_sql(t.SUMMARY_PROMPT, title="coalesce(title, 'Unknown')", review='substr(txt, 1, 1500)')} AS prompt
              FROM products JOIN texts USING (parent_asin)""",
    ),
)
def summary_prompt(spark, sf):
    return assembly.summary_prompt(_products(spark, sf), _ranked(spark, sf), "parent_asin").select("parent_asin", "prompt")


ANALYSIS_PARTS = template_sql(
    t.ANALYSIS_PROMPT,
    title="coalesce(title, 'Unknown')",
    category="category",
    price="CASE WHEN price IS NULL THEN 'N/A' ELSE printf('$%.2f', price) END",
    rating="CAST(round(avg_rating, 4) AS VARCHAR)",
    reviews="txt",
)


@checks.add(
    "analysis_prompt",
    sql(
        "doc_reviews",
        PRODUCTS
        + f""", texts AS (SELECT parent_asin, string_agg('Review ' || hit_rank || ': ' || substr(coalesce(text, ''), 1, 250), E'\\n\\n' ORDER BY hit_rank) AS txt
                          FROM doc_reviews WHERE hit_rank <= 12 GROUP BY parent_asin)
              SELECT parent_asin, {ANALYSIS_PARTS} AS prompt FROM products JOIN avgs USING (parent_asin) JOIN texts USING (parent_asin)""",
    ),
)
def analysis_prompt(spark, sf):
    products = _products(spark, sf).withColumn("avg_rating", F.round("avg_rating", 4))
    return assembly.analysis_prompt(products, _ranked(spark, sf), "parent_asin").select("parent_asin", "prompt")


CLASSIFY_PRODUCT = """CASE WHEN title <> '' THEN 'Product: ' || title || ' (Books)' || chr(10)
    || CASE WHEN pos_pct IS NOT NULL THEN 'Aggregate sentiment: ' || pos_pct || '% positive' || chr(10) ELSE '' END ELSE '' END"""


@checks.add(
    "classify_prompt",
    sql(
        "doc_reviews",
        f"""SELECT doc_key, {template_sql(t.CLASSIFY_PROMPT, product=CLASSIFY_PRODUCT, review="substr(coalesce(text, ''), 1, 500)")} AS prompt
            FROM (SELECT doc_key, title, text, CASE WHEN helpful_vote > 4 THEN helpful_vote * 10 END AS pos_pct FROM doc_reviews)""",
    ),
)
def classify_prompt(spark, sf):
    rows = fr.doc_reviews(spark, sf).select(
        "doc_key",
        "title",
        "text",
        F.lit("Books").alias("category"),
        F.when(F.col("helpful_vote") > 4, F.col("helpful_vote") * 10).alias("pos_pct"),
    )
    return assembly.classify_prompt(rows).select("doc_key", "prompt")


@checks.add(
    "review_summary_prompt",
    sql(
        "doc_reviews",
        """SELECT doc_key, '[INST] Summarize the following product review in 1-2 sentences. Include the overall sentiment (positive/negative/neutral).'
                  || chr(10) || chr(10) || 'Product: ' || coalesce(title, '') || chr(10) || 'Review: ' || coalesce(text, '') || ' [/INST]' AS prompt,
                  '[INST] Summarize the following product review in 1-2 sentences. Include the overall sentiment (positive/negative/neutral).'
                  || chr(10) || chr(10) || 'Product: ' || coalesce(title, 'Unknown') || chr(10) || 'Review: ' || substr(coalesce(text, ''), 1, 500)
                  || chr(10) || '[/INST]' AS short_prompt
           FROM doc_reviews""",
    ),
)
def review_summary_prompt(spark, sf):
    rows = load(spark, sf, "doc_reviews").select("doc_key", "title", "text")
    whole = assembly.review_summary_prompt(rows)
    short = assembly.review_summary_prompt(whole.withColumnRenamed("prompt", "_whole"), shortened=True)
    return short.select("doc_key", F.col("_whole").alias("prompt"), F.col("prompt").alias("short_prompt"))
