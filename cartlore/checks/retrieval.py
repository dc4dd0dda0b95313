"""Vector search and recommendation lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as text_fn
from ..functions import vectors
from ..functions.encoders import hashing_encoder
from ..operators import features as ops
from ..operators import recommend
from ..operators import similarity as sim
from ..operators import upkeep
from ..plans import views
from ..session import scratch_path, stored
from . import frames as fr
from .base import Checks
from .joins import cosine_sql

checks = Checks()
load, sql = fr.load, fr.sql

NLIST, NPROBE = 16, 8


def users(spark, sf):
    return sim.Side(load(spark, sf, "user_vectors"), "user_id", "embedding")


def items(spark, sf):
    return sim.Side(load(spark, sf, "item_vectors"), "item_id", "embedding")


# unit vectors once per side, so that the pair score is one inner product
SCORED = """, u AS (SELECT user_id, category AS user_category, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM user_vectors),
    i AS (SELECT item_id, category, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM item_vectors),
    scored AS (SELECT user_id, user_category, item_id, category, round(list_inner_product(u.v, i.v), 9) AS cosine FROM u, i),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY cosine DESC, item_id) AS INTEGER) AS rank FROM scored)"""
SIGMOID = "round(1 / (1 + exp(-cosine)), 4)"


@checks.add(
    "vector_topk",
    sql("user_vectors item_vectors", SCORED + " SELECT user_id, item_id, round(cosine, 6) AS score, round(1 - cosine, 6) AS distance, rank, category FROM ranked WHERE rank <= 10"),
)
def vector_topk(spark, sf):
    hits = sim.vector_topk(users(spark, sf), items(spark, sf), 10, ["category"])
    return hits.withColumns({"score": F.round("score", 6), "distance": F.round("distance", 6)})


@checks.add(
    "vector_topk_filtered",
    sql(
        "user_vectors item_vectors",
        SCORED
        + """, hits AS (SELECT *, category = user_category AS m FROM ranked WHERE rank <= 3)
            SELECT user_id, item_id, rank FROM hits WHERE m OR user_id NOT IN (SELECT user_id FROM hits WHERE m)""",
    ),
)
def vector_topk_filtered(spark, sf):
    """Each query asks for items of its own label and keeps everything where there are none."""
    hits = sim.vector_topk(users(spark, sf), items(spark, sf), 3, ["category"])
    asked = load(spark, sf, "user_vectors").select("user_id", F.col("category").alias("asked"))
    matches = F.col("category") == F.col("asked")
    return sim.prefer_matching(hits.join(asked, "user_id"), "user_id", matches).select("user_id", "item_id", "rank")


@checks.add("ivf_search")
def ivf_search(spark, sf):
    return sim.search_ivf(users(spark, sf), sim.build_ivf(items(spark, sf), NLIST), NPROBE, 10)


@checks.add(
    "ivf_search_all_cells",
    sql("user_vectors item_vectors", SCORED + " SELECT user_id, item_id, round(cosine, 6) AS score, rank FROM ranked WHERE rank <= 10"),
)
def ivf_search_all_cells(spark, sf):
    """Probing every cell must give the exact result."""
    hits = sim.search_ivf(users(spark, sf), sim.build_ivf(items(spark, sf), NLIST), NLIST, 10)
    return hits.withColumn("score", F.round("score", 6)).drop("distance")


RECALL = 0.9
TREE_CELLS, TREE_PROBE = 64, 32


def _recall(spark, sf, found):
    """Queries, whether on average their hits are among the exact ten as often as stated, and whether each has ten."""
    exact = sim.vector_topk(users(spark, sf), items(spark, sf), 10)
    hits = stored(found, "hits")
    per_query = sim.recall(exact, hits, "user_id", "item_id")
    counts = hits.groupBy("user_id").agg(F.count("*").alias("n"))
    return per_query.join(counts, "user_id").agg(
        F.count("*").alias("n_queries"), (F.avg("recall") >= RECALL).alias("found_enough"), F.bool_and(F.col("n") == 10).alias("ten_each")
    )


RECALL_SQL = sql("user_vectors", "SELECT count(*) AS n_queries, true AS found_enough, true AS ten_each FROM user_vectors")


@checks.add("ivf_search_recall", RECALL_SQL)
def ivf_search_recall(spark, sf):
    """Three in four cells probed."""
    return _recall(spark, sf, sim.search_ivf(users(spark, sf), sim.build_ivf(items(spark, sf), NLIST), 3 * NLIST // 4, 10))


@checks.add("ivf_tree_recall", RECALL_SQL)
def ivf_tree_recall(spark, sf):
    """Two-level centres, probed top-down."""
    return _recall(spark, sf, sim.search_ivf(users(spark, sf), sim.build_tree(items(spark, sf), TREE_CELLS), TREE_PROBE, 10))


@checks.add(
    "ivf_index_upkeep",
    sql("user_vectors item_vectors", SCORED + " SELECT user_id, item_id, round(cosine, 6) AS score, rank FROM ranked WHERE rank <= 10"),
)
def ivf_index_upkeep(spark, sf):
    """An index over stale, missing and superfluous rows, mended by three increments and a split of large cells: then the exact result."""
    path, rows = scratch_path(spark, "kept-index"), load(spark, sf, "item_vectors")
    nth = F.substring("item_id", 2, 20).cast("long") % 4
    stale = rows.filter(nth != 3).withColumn("embedding", F.when(nth == 0, F.reverse("embedding")).otherwise(F.col("embedding")))
    extra = rows.filter(nth == 1).withColumn("item_id", F.concat(F.lit("X"), "item_id"))
    sim.write_vectors(sim.build_tree(sim.Side(stale.unionByName(extra), "item_id", "embedding"), 16), path)
    upkeep.update_index(spark, path, rows.filter(nth == 0))
    upkeep.update_index(spark, path, rows.filter(nth == 3))
    upkeep.update_index(spark, path, deleted=extra.select("item_id"))
    upkeep.split_oversized(spark, path, 1.5)
    index = sim.read_vectors(spark, path)
    hits = sim.search_ivf(users(spark, sf), index, len(index.centres), 10)
    return hits.select("user_id", "item_id", F.round("score", 6).alias("score"), "rank")


@checks.add("ivf_index", sql("item_vectors", "SELECT item_id, true AS in_nearest_cell FROM item_vectors"))
def ivf_index(spark, sf):
    """Every row once, in the cell of its nearest centre."""
    index = sim.build_ivf(items(spark, sf), NLIST)
    unit = vectors.l2_normalize(F.col("embedding"))

    def far(centre):
        numbers = F.array(*[F.lit(float(x)) for x in centre])
        gaps = F.zip_with(unit, numbers, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
        return F.aggregate(gaps, F.lit(0.0), lambda total, x: total + x)

    distances = F.array(*[far(c) for c in index.centres.cells])  # one number per centre
    own = F.get("_d", F.col("cell"))
    return index.rows.withColumn("_d", distances).select("item_id", (own <= F.array_min("_d") + 1e-6).alias("in_nearest_cell"))


@checks.add(
    "vector_topk_prefiltered",
    sql(
        "user_vectors item_vectors",
        SCORED
        + """ SELECT user_id, item_id, round(cosine, 6) AS score, CAST(rn AS INTEGER) AS rank FROM (
                SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cosine DESC, item_id) AS rn FROM scored WHERE category = user_category) WHERE rn <= 3""",
    ),
)
def vector_topk_prefiltered(spark, sf):
    """The filter before the search: three items of its own label for each query."""
    hits = sim.vector_topk_matching(users(spark, sf), items(spark, sf), 3, "category", "category")
    return hits.select("user_id", "item_id", F.round("score", 6).alias("score"), "rank")


REPEATED = """, c AS (SELECT CASE WHEN item_id < 'P3' THEN 'P1' ELSE item_id END AS item_id, item_id AS source, v FROM i),
    hits AS (SELECT u.user_id, c.item_id, c.source, round(list_inner_product(u.v, c.v), 9) AS cosine FROM u, c)
    SELECT user_id, item_id, source, round(cosine, 6) AS score, CAST(rn AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cosine DESC, item_id) AS rn FROM hits) WHERE rn <= 5"""


def _repeated_ids(spark, sf, few: int):
    """Many corpus rows share an id; each hit must carry the payload of its own row."""
    rows = load(spark, sf, "item_vectors").withColumn("source", F.col("item_id"))
    rows = rows.withColumn("item_id", F.when(F.col("item_id") < "P3", "P1").otherwise(F.col("item_id")))
    hits = sim.vector_topk(users(spark, sf), sim.Side(rows, "item_id", "embedding"), 5, ["source"], broadcast_queries=few)
    return hits.select("user_id", "item_id", "source", F.round("score", 6).alias("score"), "rank")


@checks.add("vector_topk_repeated_ids", sql("user_vectors item_vectors", SCORED + REPEATED))
def vector_topk_repeated_ids(spark, sf):
    return _repeated_ids(spark, sf, sim.BROADCAST_QUERIES)


@checks.add("vector_topk_repeated_ids_blocks", sql("user_vectors item_vectors", SCORED + REPEATED))
def vector_topk_repeated_ids_blocks(spark, sf):
    return _repeated_ids(spark, sf, 0)


@checks.add(
    "catalog_vectors",
    sql(
        "item_vectors",
        """SELECT item_id, round(list_sum(CAST(embedding AS DOUBLE[])) / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 3) AS unit_sum
           FROM item_vectors""",
    ),
)
def catalog_vectors(spark, sf):
    unit = recommend.catalog_vectors(load(spark, sf, "item_vectors"), "item_id", "embedding")
    total = F.aggregate("unit", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return unit.select("item_id", F.round(total, 3).alias("unit_sum"))


@checks.add(
    "review_embedding_rows",
    sql(
        "doc_reviews",
        """SELECT sha256(concat_ws('_', user_id, parent_asin, CAST(ts_ms AS VARCHAR))) AS review_id, parent_asin AS item_id, user_id, rating,
                  title AS review_title, substr(e, 1, 511) AS embed_text
           FROM (SELECT *, coalesce(title, '') || ' ' || coalesce(text, '') AS e FROM doc_reviews) WHERE length(e) >= 20""",
    ),
)
def review_embedding_rows(spark, sf):
    return ops.embedding_rows(fr.doc_reviews(spark, sf))


@checks.add("review_embeddings")
def review_embeddings(spark, sf):
    return views.review_embeddings(fr.doc_reviews(spark, sf))


@checks.add(
    "review_embedding_counts",
    sql(
        "doc_reviews",
        """, kept AS (SELECT doc_key, substr(coalesce(title, '') || ' ' || coalesce(text, ''), 1, 511) AS e FROM doc_reviews
                      WHERE length(coalesce(title, '') || ' ' || coalesce(text, '')) >= 20),
            words AS (SELECT doc_key, unnest(regexp_extract_all(lower(e), '[\\p{L}\\p{N}\\p{M}_]+')) AS w FROM kept),
            counts AS (SELECT doc_key, w, count(*) AS n FROM words GROUP BY ALL)
            SELECT doc_key, CAST(count(*) AS BIGINT) AS n_words, CAST(sum(n) AS BIGINT) AS n_tokens, true AS unit, true AS of_counts
            FROM counts GROUP BY doc_key""",
    ),
)
def review_embedding_counts(spark, sf):
    """Stand-in vectors are unit vectors of counts: times its smallest entry's count, each entry is a whole number, and they add up to the words."""
    rows = fr.doc_reviews(spark, sf)
    text = text_fn.embed_text(F.col("title"), F.col("text"))
    kept = rows.filter(F.length(text_fn.full_embed_text(F.col("title"), F.col("text"))) >= text_fn.EMBED_MIN_CHARS)
    found = views.with_embedding(kept.select("doc_key", text.alias("embed_text")), hashing_encoder(1 << 16))
    words = F.regexp_extract_all(F.lower("embed_text"), F.lit(r"(?U)(\w+)"), F.lit(1))
    entries = F.array_remove("embedding", F.lit(0.0).cast("float")).cast("array<double>")  # counts are not negative
    squares = F.aggregate("entries", F.lit(0.0), lambda total, x: total + x * x)
    total = F.aggregate("entries", F.lit(0.0), lambda total, x: total + x)
    tokens = F.size("words")
    # the counts behind a unit vector: its entries times the length that makes them add up to the number of tokens
    counts = F.transform("entries", lambda x: x * tokens / F.col("total"))
    whole = F.forall(counts, lambda c: F.abs(c - F.round(c)) < 1e-2)
    # the few entries above zero first, so that the long vector is gone through once
    short = found.select("doc_key", words.alias("words"), entries.alias("entries")).filter(tokens > 0)
    return short.select("*", squares.alias("squares"), total.alias("total")).select(
        "doc_key", F.size(F.array_distinct("words")).cast("long").alias("n_words"), tokens.cast("long").alias("n_tokens"),
        (F.abs(F.col("squares") - 1) < 1e-5).alias("unit"), whole.alias("of_counts"),
    )


# --- recommendation lists --------------------------------------------------------------


@checks.add("topk_items", sql("user_vectors item_vectors", SCORED + f" SELECT user_id, item_id, {SIGMOID} AS score, rank FROM ranked WHERE rank <= 100"))
def topk_items(spark, sf):
    return recommend.recommend(users(spark, sf), items(spark, sf), 10)


COLD = "(SELECT {v} FROM {t} ORDER BY {id} LIMIT 1)"


@checks.add(
    "topk_candidates",
    sql(
        "candidates user_vectors item_vectors",
        f""", x AS (SELECT c.user_id, c.item_id, coalesce(u.embedding, {COLD.format(v='embedding', t='user_vectors', id='user_id')}) AS a,
                          coalesce(i.embedding, {COLD.format(v='embedding', t='item_vectors', id='item_id')}) AS b
                   FROM candidates c LEFT JOIN user_vectors u USING (user_id) LEFT JOIN item_vectors i USING (item_id)),
            s AS (SELECT user_id, item_id, {cosine_sql('a', 'b')} AS cosine FROM x)
            SELECT user_id, item_id, {SIGMOID} AS score, rank FROM (
              SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY cosine DESC, item_id) AS INTEGER) AS rank FROM s) WHERE rank <= 10""",
    ),
)
def topk_candidates(spark, sf):
    return recommend.recommend_candidates(load(spark, sf, "candidates"), users(spark, sf), items(spark, sf), 10, overfetch=1)


FETCHED = SCORED + f", recs AS (SELECT user_id, user_category, item_id, {SIGMOID} AS score, rank FROM ranked WHERE rank <= 100)"


@checks.add(
    "metadata_first",
    sql(
        "user_vectors item_vectors catalog",
        FETCHED
        + f""", e AS (SELECT user_id, item_id, score, rank AS score_rank, coalesce(item_title, '') <> '' AS has_metadata
                      FROM recs LEFT JOIN ({fr.METADATA}) m USING (item_id))
              SELECT user_id, item_id, score, score_rank, has_metadata, CAST(rn AS INTEGER) AS rank FROM (
                SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY has_metadata DESC, score_rank) AS rn FROM e) WHERE rn <= 10""",
    ),
)
def metadata_first(spark, sf):
    recs = recommend.recommend(users(spark, sf), items(spark, sf), 10)
    titles = fr.metadata(spark, sf).select("item_id", "item_title")
    joined = recs.join(titles, "item_id", "left").withColumn(
        "has_metadata", F.length(F.coalesce("item_title", F.lit(""))) > 0
    )
    return recommend.prefer_metadata(joined.drop("item_title"), "user_id", 10).select(
        "user_id", "item_id", "score", "score_rank", "has_metadata", "rank"
    )


@checks.add(
    "persona_boost",
    sql(
        "user_vectors item_vectors catalog",
        FETCHED
        + f""", e AS (SELECT user_id, item_id, rank AS old_rank, coalesce(pref <> '' AND (contains(lower(coalesce(item_category, '')), pref) OR contains(pref, lower(coalesce(item_category, '')))), false) AS boosted, score
                      FROM (SELECT *, CASE WHEN user_category < '3' THEN 'books' WHEN user_category < '6' THEN 'camera & photo' WHEN user_category < '8' THEN '' END AS pref FROM recs) r LEFT JOIN ({fr.METADATA}) m USING (item_id)),
              b AS (SELECT user_id, item_id, old_rank, boosted, CASE WHEN boosted THEN least(score * CAST(1.15 AS DOUBLE), 1) ELSE score END AS score FROM e)
              SELECT user_id, item_id, old_rank, boosted, round(score, 6) AS score,
                     CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, old_rank) AS INTEGER) AS rank FROM b""",
    ),
)
def persona_boost(spark, sf):
    recs = recommend.recommend(users(spark, sf), items(spark, sf), 10)
    named = fr.metadata(spark, sf).select("item_id", F.col("item_category").alias("category"))
    prefs = load(spark, sf, "user_vectors").select(
        "user_id",
        F.when(F.col("category") < "3", "Books").when(F.col("category") < "6", "Camera & Photo").when(F.col("category") < "8", "").alias("preference"),
    )
    joined = recs.join(named, "item_id", "left").join(prefs, "user_id")
    boosted = recommend.persona_boost(joined, "user_id", F.col("preference"), 100)
    return boosted.select("user_id", "item_id", "old_rank", "boosted", F.round("score", 6).alias("score"), "rank")
