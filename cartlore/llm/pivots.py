"""Exact top-k search by inner product over a pivot-distance index.

Vectors get one more component, which lifts all of them to the length of the longest one; queries get a zero there. The larger
the inner product, the smaller then the distance, so inner products are searched like distances. Every vector is keyed by
its nearest pivot (its cell) and its distance to it, and the vectors in the order of these keys are cut into blocks: an
annulus around a pivot each.

Queries are grouped by the same keys. By the triangle inequality a vector x of an annulus around p is at least ``|d(q, p) - d(x, p)|`` away from q.
A group first searches the block that may hold the nearest vectors, which gives each query a k-th best score; then
all blocks that the bound does not exclude. Inside a task blocks come in the order of their bounds, of each sorted block only the
ring between ``d(q, p) - r`` and ``d(q, p) + r`` is multiplied, and r, the distance of the k-th best so far, shrinks on the way.
What is left out cannot belong to the result, so results are exact.

Groups and blocks have bounded sizes and meet in tasks of one group and one slice of neighbouring blocks.
Where the bounds exclude nothing (directions without any clusters), that is all queries against all rows, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.indexing import global_index
from .common import over_texts, stored

PIVOTS = 64
SAMPLE = 1024  # vectors of least hash, of which the pivots are chosen; the only part of the index that is fitted
BLOCK = 4096  # vectors of a block
SLICE = 16  # blocks of a task
GROUP = 8192  # queries of a task
_AT_ONCE = 512  # queries of a product
_SLACK = 1e-6  # of the longest vector, for rounding in distances
_MOST = float((1 << 63) - 1024)  # the largest double that is a long


def quantized(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, v): ``floor(scale * x)`` of each component x, as double. Vectors that are null or hold null, NaN or infinity are left out."""
    x = F.col(embedding)
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))

    def floor(c):
        y = c.cast("double") * scale
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)  # larger doubles are whole

    return df.filter(x.isNotNull() & sound).select(F.col(vec_id).cast("long").alias("id"), F.transform(x, floor).alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of ``dims`` components; shorter ones are filled up with zeros, what is longer is cut."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    found = np.zeros((len(sizes), dims))
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = place < dims
    found[row[kept], place[kept]] = flat[kept]
    return found


def _squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def farthest_first(x: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` distinct rows, each as far as possible from those before."""
    kept = [0] if len(x) else []
    away = np.full(len(x), np.inf)
    while kept and len(kept) < n:
        away = np.minimum(away, _squares(x - x[kept[-1]]))
        if away.max() <= 0:
            break
        kept.append(int(away.argmax()))
    return x[kept]


@dataclass(frozen=True)
class PivotIndex:
    """``rows``: id, v, cell, dist, block; ``blocks``: cell, block, low, high (distances); both stored. ``pivots`` have the additional component."""

    rows: DataFrame
    blocks: DataFrame
    pivots: np.ndarray
    longest: float  # squared

    @property
    def dims(self) -> int:
        return self.pivots.shape[1] - 1

    @property
    def slack(self) -> float:
        return _SLACK * float(np.sqrt(self.longest))


def _lift(x: np.ndarray, longest: float) -> np.ndarray:
    return np.sqrt(np.maximum(longest - _squares(x), 0))


def _distances(x: np.ndarray, last: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """From each row (with its additional component) to each pivot."""
    square = (_squares(x) + last**2)[:, None] + _squares(pivots) - 2 * (x @ pivots[:, :-1].T + np.outer(last, pivots[:, -1]))
    return np.sqrt(np.maximum(square, 0))


def _salted(df: DataFrame) -> DataFrame:
    """With a last part for an order, which spreads repeated rows over its ranges."""
    return df.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))


def build_index(vectors: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE, block: int = BLOCK) -> PivotIndex:
    """Index of every row of ``vectors`` (id long, v array<double>, components finite and below 1e150 in size).

    Null vectors are left out, shorter ones count as filled up with zeros; null and repeated ids and repeated rows are kept as rows
    of their own; other columns are not read. An empty table gives an empty index.
    """
    rows = stored(vectors.filter("v IS NOT NULL").select("id", "v"), "pivot-vectors")
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
    dims, longest = rows.agg(F.max(F.size("v")), F.max(square)).first()
    dims, longest = max(dims or 0, 1), longest or 0.0
    drawn = rows.orderBy(F.xxhash64("id", "v"), "id").limit(sample).select("v").toArrow()
    chosen = farthest_first(_matrix(drawn.column("v"), dims), pivots) if len(drawn) else np.zeros((1, dims))
    chosen = np.column_stack([chosen, _lift(chosen, longest)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), dims)
            away = _distances(x, _lift(x, longest), chosen)
            cell = away.argmin(1)
            v = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dims), pa.array(x.ravel()))
            columns = [batch.column("id"), v, pa.array(cell.astype(np.int32)), pa.array(away[np.arange(len(x)), cell])]
            yield pa.RecordBatch.from_arrays(columns, ["id", "v", "cell", "dist"])

    keyed = _salted(over_texts(rows, run, "id long, v array<double>, cell int, dist double"))
    placed = global_index(keyed, ["cell", "dist", "id", "salt"], "place").drop("salt")
    indexed = stored(placed.withColumn("block", F.expr(f"place div {block}")).drop("place"), "pivot-index")
    blocks = indexed.groupBy("cell", "block").agg(F.min("dist").alias("low"), F.max("dist").alias("high"))
    return PivotIndex(indexed, stored(blocks, "pivot-blocks"), chosen, longest)


def _grouped(index: PivotIndex, queries: DataFrame, group: int) -> DataFrame:
    """Queries with their number, group, squared length and distances to all pivots."""
    pivots, dims = index.pivots, index.dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), dims)
            away = _distances(x, np.zeros(len(x)), pivots)

            def lists(m: np.ndarray) -> pa.ListArray:
                return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))

            cell = away.argmin(1)
            columns = [batch.column("id"), lists(x), pa.array(_squares(x)), lists(away), pa.array(cell.astype(np.int32)), pa.array(away[np.arange(len(x)), cell])]
            yield pa.RecordBatch.from_arrays(columns, ["id", "v", "square", "away", "cell", "dist"])

    schema = "id long, v array<double>, square double, away array<double>, cell int, dist double"
    keyed = _salted(over_texts(queries.filter("v IS NOT NULL").select("id", "v"), run, schema))
    placed = global_index(keyed, ["cell", "dist", "id", "salt"], "query").drop("salt", "cell", "dist")
    return stored(placed.withColumn("grp", F.expr(f"query div {group}")), "pivot-queries")


def _bounds(index: PivotIndex, queries: DataFrame) -> DataFrame:
    """(grp, cell, block, least): the distance that a query of the group and a vector of the block have at least."""
    ranges = (
        queries.select("grp", F.posexplode("away").alias("cell", "d"))
        .groupBy("grp", "cell")
        .agg(F.min("d").alias("near"), F.max("d").alias("far"))
    )
    least = F.greatest(F.lit(0.0), F.col("low") - F.col("far"), F.col("near") - F.col("high"))
    return ranges.join(index.blocks, "cell").select("grp", "cell", "block", least.alias("least"))


class _Best:
    """The k best (score, row) of each of some queries so far; of equal scores the smaller id."""

    def __init__(self, n: int, k: int, worst: np.ndarray):
        self.k, self.worst = k, worst.copy()  # a score that a row must reach
        self.score = np.full((n, k), -np.inf)
        self.row = np.full((n, k), -1)

    def add(self, queries: np.ndarray, scores: np.ndarray, first: int, ids: np.ndarray) -> None:
        """Scores of some queries with the rows from ``first`` on; ``ids`` are those of all rows."""
        k = self.k
        if scores.shape[1] > k:
            kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
            need = np.maximum(self.worst[queries], kth)
        else:
            need = self.worst[queries]
        own, col = np.nonzero((scores >= need[:, None]) & (scores > -np.inf))
        if not len(own):
            return
        known, place = np.nonzero(self.row[queries] >= 0)
        who = np.concatenate([own, known])
        score = np.concatenate([scores[own, col], self.score[queries][known, place]])
        row = np.concatenate([col + first, self.row[queries][known, place]])
        order = np.lexsort((ids[row], -score, who))
        who, score, row = who[order], score[order], row[order]
        nth = np.arange(len(who)) - np.searchsorted(who, who)
        kept = nth < k
        who, score, row, nth = queries[who[kept]], score[kept], row[kept], nth[kept]
        self.score[who, nth], self.row[who, nth] = score, row
        self.worst[queries] = np.maximum(self.worst[queries], self.score[queries, k - 1])


def _search(index: PivotIndex, queries: DataFrame, pairs: DataFrame, k: int, own: bool) -> DataFrame:
    """(query, id, score): at least the k best of each query in each slice of its group's blocks, if they reach its ``worst``."""
    dims, longest, slack, pivots = index.dims, index.longest, index.slack, len(index.pivots)

    def best(queries: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("least", "ascending"), ("block", "ascending"), ("cell", "ascending"), ("dist", "ascending")])
        x, dist = _matrix(rows.column("v"), dims), rows.column("dist").to_numpy()
        ids = rows.column("id").fill_null((1 << 63) - 1).to_numpy()
        block, cells = rows.column("block").to_numpy(), rows.column("cell").to_numpy()
        new = np.flatnonzero((np.diff(block, prepend=-1) != 0) | (np.diff(cells, prepend=-1) != 0))
        q, away = _matrix(queries.column("v"), dims), _matrix(queries.column("away"), pivots)
        square, qid = queries.column("square").to_numpy(), queries.column("id").fill_null(-1).to_numpy()
        has_id = queries.column("id").is_valid().to_numpy()
        worst = queries.column("worst").fill_null(-np.inf).to_numpy()
        number = queries.column("query").to_numpy()
        found: tuple[list, list, list] = ([], [], [])
        for a in range(0, len(q), _AT_ONCE):
            part = slice(a, a + _AT_ONCE)
            top = _Best(len(q[part]), k, worst[part])
            for start, end in zip(new, [*new[1:], len(x)]):
                gap = square[part] + longest - 2 * top.worst
                reach = np.sqrt(np.maximum(gap, 0)) * (1 + 1e-9) + slack
                middle = away[part, cells[start]]
                low = np.searchsorted(dist[start:end], middle - reach)
                high = np.searchsorted(dist[start:end], middle + reach, "right")
                active = np.flatnonzero(high > low)
                if not len(active):
                    continue
                first, last = start + low[active].min(), start + high[active].max()
                scores = q[part][active] @ x[first:last].T
                if own:
                    same = (qid[part][active][:, None] == ids[first:last]) & has_id[part][active][:, None]
                    scores[same] = -np.inf
                top.add(active, scores, int(first), ids)
            who, nth = np.nonzero(top.row >= 0)
            found[0].append(number[part][who])
            found[1].append(top.row[who, nth])
            found[2].append(top.score[who, nth])
        query, row, score = (np.concatenate(f) if f else np.zeros(0) for f in found)
        picked = rows.column("id").take(pa.array(row.astype(np.int64)))
        return pa.table({"query": pa.array(query.astype(np.int64)), "id": picked, "score": pa.array(score.astype(float))})

    tasks = pairs.withColumn("slice", F.expr(f"block div {SLICE}"))
    asked = queries.join(tasks.select("grp", "slice").distinct(), "grp")
    rows = index.rows.join(tasks.select("cell", "block", "least", F.col("grp").alias("of"), F.col("slice").alias("part")), ["cell", "block"])
    return (
        asked.select("grp", "slice", "query", "id", "v", "square", "away", "worst")
        .groupBy("grp", "slice")
        .cogroup(rows.select("of", "part", "least", "id", "v", "cell", "dist", "block").groupBy("of", "part"))
        .applyInArrow(best, "query long, id long, score double")
    )


def search(index: PivotIndex, queries: DataFrame, k: int, exclude_own: bool = True, group: int = GROUP) -> DataFrame:
    """query_id, rank, id, score of the ``k`` rows of the index with the largest inner product, for each row of ``queries`` (id, v).

    Fewer if the index has fewer. Of equal scores the smaller id comes first, null last. With ``exclude_own`` rows that have the query's id
    are left out (a null id is nobody's own). Queries without a vector have no rows; queries that repeat an id are queries of their own,
    with rows under the same query_id. Vectors of unlike lengths count as filled up with zeros. Integer components give exact scores
    as long as squared lengths stay below 2 ** 53. Empty tables give an empty result.
    """
    asked = _grouped(index, queries, group)
    bounds = stored(_bounds(index, asked), "pivot-bounds")
    first = bounds.groupBy("grp").agg(F.min(F.struct("least", "cell", "block")).alias("m")).select("grp", "m.least", "m.cell", "m.block")
    near = stored(_search(index, asked.withColumn("worst", F.lit(None).cast("double")), stored(first, "pivot-first"), k, exclude_own), "pivot-near")
    full = near.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("s"))
    bounded = asked.join(full, "query", "left").withColumn("worst", F.when(F.col("n") >= k, F.col("s"))).drop("n", "s")
    bounded = stored(bounded, "pivot-bounded")
    reach = F.sqrt(F.greatest(F.lit(0.0), F.col("square") + index.longest - 2 * F.col("worst")))
    known = F.when(F.col("worst").isNotNull(), reach).otherwise(F.lit(float("inf")))  # fewer than k so far exclude nothing
    radius = bounded.groupBy("grp").agg(F.max(known).alias("radius"))
    seen = first.select("grp", "cell", "block")
    within = F.col("least") <= F.col("radius") * (1 + 1e-9) + index.slack
    open_pairs = bounds.join(seen, ["grp", "cell", "block"], "left_anti").join(radius, "grp").filter(within).drop("radius")
    further = _search(index, bounded, stored(open_pairs, "pivot-pairs"), k, exclude_own)
    order = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = near.unionByName(further).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = asked.select("query", F.col("id").alias("query_id"))
    return ranked.join(names, "query").select("query_id", "rank", "id", "score")


def nearest(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of all other rows for each row whose vec_id is divisible by ``every``.

    Components count as ``floor(256 * x)``; vectors null or with null or non-finite components take no part. Scores beyond a long are cut to its ends.
    """
    rows = stored(quantized(embeddings), "pivot-quantized")
    found = search(build_index(rows), rows.filter(F.col("id") % every == 0), k)
    score = F.greatest(F.least(F.col("score"), F.lit(_MOST)), F.lit(-_MOST)).cast("long")
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), score.alias("score"))


ORACLE = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
               WHERE embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
    scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
               FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5"""
