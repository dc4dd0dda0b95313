"""Shop-shaped tables derived from the given star-schema Parquet tables.

Each fixture is one SQL text for both engines: ``{name}`` stands for a base
table or another fixture, ``@MS`` for the engine's timestamp-to-epoch-ms function.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

FIXTURES: dict[str, str] = {
    "reviews": """
        SELECT md5(concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING),
                   CAST(l_linenumber AS STRING), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING))) AS row_key,
               user_id, parent_asin, rating, title, d.text AS text, helpful_vote, ts_ms, verified_purchase, category
        FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice,
                     concat('U', CAST(o_custkey AS STRING)) AS user_id,
                     concat('P', CAST(l_partkey AS STRING)) AS parent_asin,
                     CAST(CASE WHEN l_quantity = 1 THEN 0 ELSE floor((l_quantity - 1) / 10) + 1 END AS DOUBLE) AS rating,
                     p_name AS title,
                     CAST(round(l_discount * 100) AS INT) AS helpful_vote,
                     @MS(CAST(l_shipdate AS TIMESTAMP)) AS ts_ms,
                     l_returnflag <> 'R' AS verified_purchase,
                     CASE l_partkey % 3 WHEN 0 THEN 'Electronics' WHEN 1 THEN 'Books' ELSE 'Home_and_Kitchen' END AS category,
                     (l_orderkey * 7 + l_linenumber) % (SELECT count(*) FROM {documents}) AS doc_ref
              FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey) r
        LEFT JOIN {documents} d ON d.doc_id = r.doc_ref""",
    # every document read as one review; used where whole texts are part of the output
    "doc_reviews": """
        SELECT CAST(doc_id AS STRING) AS doc_key, concat('U', CAST(doc_id % 97 AS STRING)) AS user_id,
               concat('P', CAST(doc_id % 41 AS STRING)) AS parent_asin,
               CAST(doc_id % 6 AS DOUBLE) AS rating,
               CASE WHEN doc_id % 7 = 0 THEN NULL ELSE concat('About ', source) END AS title,
               CASE WHEN doc_id % 13 = 0 THEN NULL ELSE text END AS text,
               CAST(doc_id % 9 AS INT) AS helpful_vote, 1600000000000 + doc_id * 86400 AS ts_ms,
               row_number() OVER (PARTITION BY doc_id % 41 ORDER BY md5(CAST(doc_id AS STRING)), doc_id) AS hit_rank
        FROM {documents}""",
    "catalog": """
        SELECT concat('P', CAST(p_partkey AS STRING)) AS parent_asin,
               CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_name END AS title,
               CASE p_partkey % 8 WHEN 0 THEN 'Camera & Photo' WHEN 1 THEN 'Tools & Home Improvement' WHEN 2 THEN 'Computers'
                    WHEN 3 THEN 'Books' WHEN 4 THEN 'Toys & Games' WHEN 5 THEN 'None' WHEN 6 THEN '' ELSE NULL END AS main_category,
               CASE WHEN p_partkey % 5 = 0 THEN 'None' ELSE CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING) END AS price,
               CASE WHEN p_partkey % 7 = 0 THEN 'None' ELSE p_brand END AS store, 0 AS copy_no
        FROM {part}
        UNION ALL
        SELECT concat('P', CAST(p_partkey AS STRING)), concat(p_name, ' (dup)'), 'Books', 'None', p_brand, 1
        FROM {part}""",
    "user_daily": """
        SELECT concat('U', CAST(o_custkey AS STRING)) AS user_id, CAST(l_shipdate AS TIMESTAMP) AS event_timestamp,
               count(*) AS day_reviews, round(avg(l_quantity), 6) AS day_avg_qty
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    "item_daily": """
        SELECT concat('P', CAST(l_partkey AS STRING)) AS item_id, CAST(l_shipdate AS TIMESTAMP) AS event_timestamp,
               count(*) AS day_sales, CAST(sum(l_quantity) AS BIGINT) AS day_qty
        FROM {lineitem} GROUP BY 1, 2""",
    "spine": """
        SELECT DISTINCT concat('U', CAST(o_custkey AS STRING)) AS user_id, concat('P', CAST(l_partkey AS STRING)) AS item_id,
               CAST(o_orderdate AS TIMESTAMP) AS event_timestamp, o_orderkey AS order_id
        FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey""",
    "requests": """
        SELECT event_id AS request_id, CAST(ts AS TIMESTAMP) AS ts,
               CASE event_type WHEN 'click' THEN 'rec' WHEN 'view' THEN 'rec' WHEN 'purchase' THEN 'rag' ELSE 'llm' END AS service,
               CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
               CASE WHEN event_type = 'signup' THEN 'summarize' ELSE 'completions' END AS endpoint,
               round(value * 10, 3) AS latency_ms, user_id % 11 AS n_sources
        FROM {events}""",
    # monotone counter that restarts every 997 samples, one series per event type
    "counter_samples": """
        SELECT event_type AS series, CAST(ts AS TIMESTAMP) AS ts, CAST(event_id % 997 AS DOUBLE) AS value FROM {events}""",
    "item_vectors": """
        SELECT concat('P', CAST(vec_id AS STRING)) AS item_id, embedding, CAST(label AS STRING) AS category FROM {embeddings}""",
    "user_vectors": """
        SELECT concat('U', CAST(vec_id AS STRING)) AS user_id, embedding, CAST(label AS STRING) AS category FROM {embeddings}""",
    "candidates": """
        SELECT DISTINCT concat('U', CAST(o_custkey AS STRING)) AS user_id, concat('P', CAST(l_partkey AS STRING)) AS item_id
        FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey""",
    "instruction": """
        SELECT conv_id, turn, instruction, input, output FROM (
          SELECT conv_id, turn, role, text AS instruction,
                 CASE WHEN turn % 2 = 0 THEN '' ELSE role END AS input,
                 lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS output
          FROM {conversations}) c
        WHERE role = 'user'""",
    # model answers in every shape the parser must take: map, list of objects, list of strings, broken, none
    "analysis": """
        SELECT doc_id,
               CASE doc_id % 6
                 WHEN 0 THEN concat('Sure: {"sentiment": "', s, '", "aspects": {"battery": "', v, '"}, "pros": ["a", "b"]} done')
                 WHEN 1 THEN concat('{"sentiment": "', s, '", "aspects": [{"aspect": "battery", "sentiment": "', v, '"}, {"name": "screen"}]}')
                 WHEN 2 THEN concat('{"sentiment": "', s, '", "aspects": ["battery", "screen"], "pros": []}')
                 WHEN 3 THEN concat('{"sentiment": "', s, '", "aspects": ')
                 WHEN 4 THEN concat('no json here, ', s)
                 ELSE concat('{"sentiment": "', s, '"} {"x": }') END AS raw,
               concat('Fallback {"sentiment": "', s, '", "aspects": {"screen": "neutral"}}') AS raw_second
        FROM (SELECT doc_id, CASE WHEN quality = 1 THEN 'positive' WHEN toxic = 1 THEN 'negative' ELSE 'mixed' END AS s,
                     CASE WHEN toxic = 1 THEN 'poor' ELSE 'great value' END AS v FROM {labels}) l""",
    # answers that label several reviews, as objects and as plain texts, and list pros and cons
    "review_answers": """
        SELECT doc_id, concat('{"per_review": [{"sentiment": "', CASE WHEN quality = 1 THEN 'positive' ELSE 'neutral' END, '"}, "',
                              CASE WHEN toxic = 1 THEN 'negative' ELSE 'positive' END, '", {"other": 1}], "verdict": "',
                              CASE WHEN toxic = 1 THEN 'skip' ELSE 'buy' END, '", "pros": ["a", "b", "c", "d", "e", "f", "g"]',
                              CASE WHEN doc_id % 2 = 0 THEN ', "cons": ["x"], "themes": []' ELSE '' END, '}') AS raw
        FROM {labels}""",
    "logits": """
        SELECT event_id, (value - 50.0) / 12.5 AS logit, CASE WHEN event_type IN ('click', 'purchase') THEN 1.0 ELSE 0.0 END AS label
        FROM {events}""",
}

_NAME = re.compile(r"\{(\w+)\}")


def _tables(sql: str) -> list[str]:
    return list(dict.fromkeys(_NAME.findall(sql)))


def _for_spark(sql: str) -> str:
    return sql.replace("@MS", "unix_millis")


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, in the files it comes in."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """A base table or fixture as a DataFrame; tables in ``given`` are taken in place of the stored ones."""
    if name in given:
        return given[name]
    if name in BASE_TABLES:
        return base(spark, sf_dir, name)
    sql = _for_spark(FIXTURES[name])
    # braces of JSON literals must survive str.format
    names = _tables(sql)
    escaped = sql.replace("{", "{{").replace("}", "}}")
    escaped = reduce(lambda text, n: text.replace("{{" + n + "}}", "{" + n + "}"), names, escaped)
    frame = spark.sql(escaped, **{n: load(spark, sf_dir, n, **given) for n in names})
    return frame.withColumnRenamed("ts_ms", "timestamp") if "ts_ms" in frame.columns else frame


def duckdb_sql(name: str) -> str:
    sql = FIXTURES[name].replace("@MS", "epoch_ms")
    return reduce(lambda text, n: text.replace("{" + n + "}", n), _tables(sql), sql)


def with_fixtures(names: str, body: str) -> str:
    """DuckDB text: the named fixtures as a WITH list in front of ``body``.

    ``body`` may start with further common tables, written ``, name AS (...)``.
    """
    parts = ", ".join(f"{n} AS ({duckdb_sql(n)})" for n in names.split())
    return f"WITH {parts} {body}"
