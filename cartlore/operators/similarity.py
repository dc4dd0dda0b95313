"""Exact and approximate nearest-vector search."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors
from ..session import counted, shuffle_partitions, stored, stored_in_turns
from ..sources import files
from .centres import SAMPLE_ROWS, Centres, train_centres
from .ranking import top_n

BLOCK_ROWS = 65_536  # queries of one task at most
TASK_HITS = 1_000_000  # hits such a task holds at most
TASK_NUMBERS = 4_000_000  # vector entries of its queries at most
LEAST_CORPUS_ROWS = 8_192  # and at least, where there are so many
CORPUS_ROWS = 1 << 22  # corpus rows such a task reads at most, one batch at a time
TURN_NUMBERS = 1 << 30  # vector entries of all copies of corpus rows that are shuffled at once
BROADCAST_QUERIES = 1_024  # up to here queries travel to the corpus instead of both being shuffled
SCORES_AT_ONCE = 4_000_000  # entries of the score matrix a task holds
TILE_ROWS = 1_024  # rows of either side in one matrix product of a block search
SCORE_DIGITS = 9  # scores are rounded here, so that ranking does not depend on the block layout
QID, QNO, CID, CNO, QVEC, CVEC = "_qid", "_qno", "_cid", "_cno", "_qvec", "_cvec"


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit rows of an array column, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(n, -1) if n else flat.reshape(0, 0)
    lengths = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.maximum(lengths, vectors.EPS)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and column numbers and rounded scores of the k best per row; equal scores go to the smaller id.

    Only entries that can be among the k best after rounding are rounded and sorted.
    """
    k = min(k, scores.shape[1])
    floor = np.full(scores.shape[0], -np.inf)
    if k < scores.shape[1]:
        floor = -np.partition(-scores, k - 1, axis=1)[:, k - 1] - 2 * 10.0**-SCORE_DIGITS
    row, col = np.nonzero(scores >= floor[:, None])
    score = np.round(scores[row, col], SCORE_DIGITS)
    order = np.lexsort((ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    place = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)]))
    return row[place < k], col[place < k], score[place < k]


def _scored(q: np.ndarray, c: np.ndarray, ids: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Query numbers, corpus row numbers and scores of the k best of one block, a bounded number of scores at a time."""
    step = max(1, SCORES_AT_ONCE // max(len(ids), 1))
    place = np.empty(len(ids), dtype=np.int64)
    place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))  # ids compared once, then as numbers
    for start in range(0, len(q) if len(ids) else 0, step):
        row, col, score = _best(q[start : start + step] @ c.T, place, k)
        yield start + row, col, score


def _keep_best(hits: pa.Table, k: int) -> pa.Table:
    """The k best hits of each query number, in query order."""
    hits = hits.sort_by([(QNO, "ascending"), ("score", "descending"), (CID, "ascending")])
    number = hits[QNO].to_numpy()
    first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
    place = np.arange(len(number)) - np.repeat(first, np.diff(np.r_[first, len(number)]))
    return hits.filter(pa.array(place < k))


def _floors(best: pa.Table, n_queries: int, k: int) -> np.ndarray:
    """Score of each query's k-th hit so far: what is below it cannot be among the k best."""
    number, score = best[QNO].to_numpy(), best["score"].to_numpy()
    floor = np.full(n_queries, -np.inf)
    last = np.flatnonzero(np.r_[number[1:] != number[:-1], True])
    full = np.diff(np.r_[-1, last]) >= k
    floor[number[last[full]]] = score[last[full]]
    return floor


_HITS = T.StructType(
    [T.StructField(QID, T.StringType()), T.StructField(CID, T.StringType()), T.StructField("score", T.DoubleType())]
)


def _broadcast_hits(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Few queries: every task scores its own corpus rows and returns its k best per query.

    The corpus is not shuffled, and its other columns come along with the hits.
    """
    small = queries.toArrow()  # at most BROADCAST_QUERIES rows, checked by the caller
    shared = corpus.sparkSession.sparkContext.broadcast((small[QID].to_pylist(), _matrix(small[QVEC])))
    payload = [f for f in corpus.schema.fields if f.name not in (CID, CVEC)]
    names = [QID, CID, "score", *[f.name for f in payload]]

    def score_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = shared.value
        best, floor = None, np.full(len(qids), -np.inf)
        for batch in batches:
            rows = pa.Table.from_batches([batch]).drop_columns([CVEC])
            for number, col, score in _scored(q, _matrix(batch[CVEC]), batch[CID], k):
                near = score >= floor[number]
                if not near.any():
                    continue
                found = rows.take(pa.array(col[near])).append_column(QNO, pa.array(number[near]))
                found = found.append_column("score", pa.array(score[near]))
                best = _keep_best(found if best is None else pa.concat_tables([best, found]), k)
                floor = _floors(best, len(qids), k)
        if best is not None:
            asked = pa.array(qids, pa.string()).take(best[QNO].combine_chunks())
            yield from best.append_column(QID, asked).select(names).to_batches()

    return corpus.mapInArrow(score_partition, T.StructType([*_HITS.fields, *payload]))


class _Running:
    """The k best hits of a block of queries while corpus rows stream by in ascending order of their number.

    Products in single precision sort out what cannot be among the k best, with a margin for their error; what is left is scored in double precision.
    """

    def __init__(self, units: np.ndarray, k: int):
        self.q, self.q32, self.k = units, units.astype(np.float32), k
        self.margin = (units.shape[1] + 8) * 2.0**-22 + 2 * 10.0**-SCORE_DIGITS
        self.floor = np.full(len(units), -np.inf)
        self.number, self.no, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def add(self, units: np.ndarray, numbers: np.ndarray) -> None:
        c32 = units.astype(np.float32)
        for at in range(0, len(units), TILE_ROWS):
            for start in range(0, len(self.q), TILE_ROWS):
                self._tile(start, at, c32[at : at + TILE_ROWS], units, numbers)
            if self.n_waiting > max(self.number.size, 4 * TILE_ROWS):
                self.settle()

    def _tile(self, start: int, at: int, c32: np.ndarray, units: np.ndarray, numbers: np.ndarray) -> None:
        scores = self.q32[start : start + TILE_ROWS] @ c32.T
        floor = self.floor[start : start + TILE_ROWS]
        least = (floor - self.margin).astype(np.float32)
        if self.k < scores.shape[1] and np.isinf(floor).any():
            best = -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1]
            least = np.maximum(least, (best - 2 * self.margin).astype(np.float32))
        rows = np.flatnonzero(scores.max(axis=1) >= least)
        if not len(rows):
            return
        if 2 * len(rows) > len(scores):
            rows = np.arange(len(scores))
        else:
            scores = scores[rows]
        row, col = np.divmod(np.flatnonzero(scores >= least[rows, None]), scores.shape[1])
        row, col = rows[row] + start, col + at
        step = max(1, SCORES_AT_ONCE // max(units.shape[1], 1))
        for part in range(0, len(row), step):
            r, c = row[part : part + step], col[part : part + step]
            score = np.round(np.einsum("ij,ij->i", self.q[r], units[c]), SCORE_DIGITS)
            over = score > self.floor[r]  # an equal score of a later row comes behind
            self.waiting.append((r[over], numbers[c[over]], score[over]))
            self.n_waiting += int(over.sum())
            if self.n_waiting > 2 * TASK_HITS:
                self.settle()

    def settle(self) -> None:
        parts = [(self.number, self.no, self.score), *self.waiting]
        number, no, score = (np.concatenate([p[i] for p in parts]) for i in range(3))
        self.waiting, self.n_waiting = [], 0
        order = np.lexsort((no, -score, number))
        number, no, score = number[order], no[order], score[order]
        first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(number) else np.zeros(0, np.int64)
        place = np.arange(len(number)) - np.repeat(first, np.diff(np.r_[first, len(number)]))
        kept = place < self.k
        self.number, self.no, self.score = number[kept], no[kept], score[kept]
        full = place == self.k - 1
        self.floor[number[full]] = score[full]


def _stream_hits(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of task: the queries of each (without ``CNO``), then its corpus rows, one batch of which is held at a time."""
    task, ids, vecs, running = None, [], [], None

    def found() -> Iterator[pa.RecordBatch]:
        if running is None:
            return
        running.settle()
        names = pa.concat_arrays(ids)
        for at in range(0, len(running.number), TILE_ROWS * 8):
            number, no, score = (x[at : at + TILE_ROWS * 8] for x in (running.number, running.no, running.score))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(number)), pa.array(no), pa.array(score)], [QID, CNO, "score"])

    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch["_task"]
        is_corpus = pc.is_valid(batch[CNO]).to_numpy(zero_copy_only=False)
        changed = pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False) | (is_corpus[1:] != is_corpus[:-1])
        cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if names[start].as_py() != task:
                yield from found()
                task, ids, vecs, running = names[start].as_py(), [], [], None
            part = batch.slice(start, end - start)
            if not is_corpus[start]:
                ids.append(part[QID])
                vecs.append(_matrix(part["_vec"]))
            elif vecs or running is not None:
                if running is None:
                    running, vecs = _Running(np.concatenate(vecs), k), []
                running.add(_matrix(part["_vec"]), part[CNO].to_numpy())
    yield from found()


def _numbered(corpus: DataFrame) -> DataFrame:
    """The corpus, written once, each row with a number (``CNO``) that sorts as its id does."""
    order = [F.col(CID), F.xxhash64(CVEC)]  # rows that share an id are spread
    sorted_rows = corpus.repartitionByRange(shuffle_partitions(corpus.sparkSession), *order).sortWithinPartitions(*order)
    return stored(sorted_rows.withColumn(CNO, F.monotonically_increasing_id()), "corpus")


def _width(queries: DataFrame) -> int:
    first = queries.select(F.size(QVEC)).first()
    return max(first[0] if first else 1, 1)


def _query_rows(width: int, k: int, block_rows: int) -> int:
    """Queries of one task: so many that their vectors and hits stay small."""
    return max(1, min(block_rows, TASK_HITS // max(k, 1), TASK_NUMBERS // width))


def _block_hits(queries: DataFrame, corpus: DataFrame, k: int, group: list[str]) -> DataFrame:
    """Many queries: a block of them per task, past which the corpus rows of their group (the whole table, or one cell of an index) stream.

    Both sides carry the number of blocks, ``_qn`` and ``_cn``, of their group and are split by a hash, so a large group becomes
    many tasks. Pairs are never rows, and of the corpus only vectors and row numbers travel: a task keeps k results per query,
    and holds its queries and one batch of the corpus, however large that is.
    """

    def block(col: str, n: str) -> Column:
        return F.pmod(F.xxhash64(col), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def rows(df: DataFrame, name: Column, no: Column, vec: str) -> DataFrame:
        task = F.concat_ws("|", *[F.col(c).cast("string") for c in group], "_qb", "_cb")
        return df.select(task.alias("_task"), name.alias(QID), no.alias(CNO), F.col(vec).alias("_vec"))

    q_blocks = queries.withColumn("_qb", block(QNO, "_qn")).withColumn("_cb", every("_cn"))
    c_blocks = corpus.withColumn("_cb", block(CNO, "_cn")).withColumn("_qb", every("_qn"))
    kind = corpus.schema[CVEC].dataType
    left = rows(q_blocks, F.col(QID), F.lit(None).cast("long"), QVEC)
    right = rows(c_blocks, F.lit(None).cast("string"), F.col(CNO), CVEC)
    if queries.schema[QVEC].dataType != kind:
        left, right = (df.withColumn("_vec", F.col("_vec").cast("array<double>")) for df in (left, right))
    # a block is little data but much work: a fixed number of partitions keeps the small ones from being merged, and few blocks from sharing one
    parts = 4 * shuffle_partitions(queries.sparkSession)
    ordered = left.unionByName(right).repartition(parts, "_task").sortWithinPartitions("_task", F.col(CNO).asc_nulls_first())
    schema = T.StructType([T.StructField(QID, T.StringType()), T.StructField(CNO, T.LongType()), T.StructField("score", T.DoubleType())])
    return ordered.mapInArrow(lambda batches: _stream_hits(batches, k), schema)


def _with_rows(hits: DataFrame, corpus: DataFrame, k: int, payload: list[str]) -> DataFrame:
    """The k best hits of each query with the id and the payload of their own corpus rows."""
    return _named(_ranked(hits, k), corpus, payload)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    return top_n(hits, [QID], [F.col("score").desc(), CNO], k, "rank")


def _named(best: DataFrame, corpus: DataFrame, payload: list[str]) -> DataFrame:
    return best.join(corpus.select(CNO, CID, *payload), CNO).drop(CNO)


def _best_hits(hits: DataFrame, k: int) -> DataFrame:
    return top_n(hits, [QID], [F.col("score").desc(), CID], k, "rank")


@dataclass(frozen=True)
class Side:
    """A table of vectors: the text id and the array column."""

    df: DataFrame
    id: str
    vec: str


def _plain(side: Side, id_name: str, vec_name: str, payload: list[str] = ()) -> DataFrame:
    found = side.df.select(F.col(side.id).cast("string").alias(id_name), F.col(side.vec).alias(vec_name), *payload)
    return found.filter(F.size(vec_name) > 0)


def vector_topk(
    queries: Side,
    corpus: Side,
    k: int,
    payload: list[str] = (),
    broadcast_queries: int = BROADCAST_QUERIES,
    block_rows: int = BLOCK_ROWS,
    keep_hits: bool = False,
) -> DataFrame:
    """The k corpus rows of highest cosine for each query: ids, ``score``, ``distance``, ``rank`` and payload columns.

    Each block of queries costs a copy of the corpus vectors. Where these are more than ``TURN_NUMBERS`` numbers, the queries are searched in
    turns, and the copies of a turn go before the next one begins. Hits are then stored, as with ``keep_hits``, which a
    caller asks for that reads parts of the result at a time.
    """
    payload = list(payload)
    q, c = _plain(queries, QID, QVEC), _plain(corpus, CID, CVEC, payload)
    if queries.df.limit(broadcast_queries + 1).count() <= broadcast_queries:
        best = _best_hits(_broadcast_hits(q, c, k), k)
        best = stored(best, "found") if keep_hits else best
    else:
        q, c = stored(q.withColumn(QNO, F.monotonically_increasing_id()), "queries"), _numbered(c)
        n_rows, width = counted(c), _width(q)  # of file footers only
        busy = 3 * q.sparkSession.sparkContext.defaultParallelism

        at_once = max(1, TURN_NUMBERS // max(n_rows * width, 1))  # blocks of queries

        def least(n_queries: int) -> int:
            return max(1, -(-n_queries // _query_rows(width, k, block_rows)))

        def search(keep: Column) -> DataFrame:
            asked = q.filter(keep)
            n_queries = counted(asked)
            q_blocks = max(least(n_queries), min(busy, n_queries // TILE_ROWS, at_once))
            # the corpus is cut where it is very long, and where there are fewer blocks of queries than tasks to keep busy
            wanted = max(-(-n_rows // CORPUS_ROWS), busy // q_blocks)
            c_blocks = max(1, min(wanted, -(-n_rows // min(block_rows, LEAST_CORPUS_ROWS))))
            sizes = {"_qn": F.lit(q_blocks), "_cn": F.lit(c_blocks)}
            return _ranked(_block_hits(asked.withColumns(sizes), c.withColumns(sizes), k, []), k)

        turns = -(-least(counted(q)) // at_once)
        hits = stored_in_turns(search, QID, turns, "hits") if keep_hits or turns > 1 else search(F.lit(True))
        best = _named(hits, c, payload)
    return _shown(best, queries.id, corpus.id, payload)


def _shown(best: DataFrame, query: str, item: str, payload: list[str]) -> DataFrame:
    return best.select(
        F.col(QID).alias(query),
        F.col(CID).alias(item),
        "score",
        (F.lit(1.0) - F.col("score")).alias("distance"),
        "rank",
        *payload,
    )


def vector_topk_matching(
    queries: Side, corpus: Side, k: int, asked: str, has: str, payload: list[str] = (), block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The k best among the corpus rows that match: the query's column ``asked`` equals the row's ``has``.

    The filter comes before the search, so a query gets k matching rows wherever they rank in the whole corpus.
    Each value is searched on its own, large ones in blocks.
    """
    payload = list(payload)
    q = queries.df.select(F.col(queries.id).cast("string").alias(QID), F.col(queries.vec).alias(QVEC), F.col(asked).alias("_match"))
    named = [F.col(c) for c in payload]
    c = corpus.df.select(F.col(corpus.id).cast("string").alias(CID), F.col(corpus.vec).alias(CVEC), F.col(has).alias("_match"), *named)
    q, c = q.filter(F.size(QVEC) > 0), c.filter(F.size(CVEC) > 0)
    return _shown(_grouped_hits(q, c, k, "_match", payload, block_rows), queries.id, corpus.id, payload)


def _grouped_hits(q: DataFrame, c: DataFrame, k: int, group: str, payload: list[str], block_rows: int) -> DataFrame:
    """Search inside equal values of a column; large values are split into blocks of both sides."""
    q, c = stored(q.withColumn(QNO, F.monotonically_increasing_id()), "queries"), _numbered(c)

    def sizes(df: DataFrame, name: str, rows: int) -> DataFrame:
        return df.groupBy(group).agg(F.ceil(F.count("*") / F.lit(rows)).cast("int").alias(name))

    counts = sizes(q, "_qn", _query_rows(_width(q), k, block_rows)).join(sizes(c, "_cn", min(block_rows, BLOCK_ROWS) * 8), group)
    hits = _block_hits(q.join(counts, group), c.join(counts, group), k, [group])
    return _with_rows(hits, c, k, payload)


def prefer_matching(hits: DataFrame, query: str, matches: Column) -> DataFrame:
    """Keep a query's matching hits; a query without any keeps them all. A query has at most k hits."""
    flagged = hits.withColumn("_match", F.coalesce(matches, F.lit(False)))
    any_match = F.max("_match").over(Window.partitionBy(query))
    kept = flagged.withColumn("_any", any_match).filter(F.col("_match") | ~F.col("_any"))
    return kept.drop("_match", "_any")


# --- inverted-list index -----------------------------------------------------------


def unit_vectors(df: DataFrame, vec: str, out: str = "unit") -> DataFrame:
    """Catalogue vectors scaled once, to be stored and scored by inner product."""
    return df.withColumn(out, vectors.l2_normalize(F.col(vec)))


@dataclass(frozen=True)
class IvfIndex:
    """Vectors with their ``cell``, and the cell centres."""

    rows: DataFrame
    centres: Centres
    id: str
    vec: str


def build_ivf(
    corpus: Side, nlist: int, seed: int = 7, max_iter: int = 10, train_share: float = 1.0
) -> IvfIndex:
    """Group unit vectors into ``nlist`` cells by k-means.

    The centres may be trained on a share of the rows; every row gets a cell.
    """
    units = corpus.df.withColumn("_features", array_to_vector(vectors.l2_normalize(F.col(corpus.vec))))
    train = units if train_share >= 1.0 else units.sample(train_share, seed)
    model = KMeans(k=nlist, seed=seed, maxIter=max_iter, featuresCol="_features", predictionCol="cell").fit(train)
    centres = Centres(np.array(model.clusterCenters()))
    return IvfIndex(model.transform(units).drop("_features"), centres, corpus.id, corpus.vec)


def build_tree(corpus: Side, nlist: int, seed: int = 7, sample_rows: int = SAMPLE_ROWS) -> IvfIndex:
    """Some ``nlist`` cells, thousands if wanted, below the root of that many top centres, trained on a bounded sample of all rows.

    Rows without a vector are in no cell.
    """
    centres = train_centres(corpus.df, corpus.id, corpus.vec, nlist, sample_rows, seed)
    rows = nearest_cells(corpus.df.filter(F.size(corpus.vec) > 0), centres, 1, corpus.vec)
    return IvfIndex(rows, centres, corpus.id, corpus.vec)


def write_vectors(index: IvfIndex, path: str) -> None:
    """Store the rows in one folder per cell, so that a search reads its cells only, and the centres beside them; replaces a former index."""
    spark = index.rows.sparkSession
    write_cells(index.rows, path, whole=True)
    write_centres(spark, index.centres, index.id, index.vec, path)
    files.delete_tree(spark, f"{path}/places")  # of the former one, see upkeep


def write_cells(rows: DataFrame, path: str, whole: bool = False) -> None:
    """Replace all cells, or the folders of those that ``rows`` have; small cells become one file, large ones several."""
    writer = rows.hint("rebalance", "cell").write.mode("overwrite")
    writer = writer.option("partitionOverwriteMode", "static" if whole else "dynamic")
    writer.partitionBy("cell").parquet(f"{path}/rows")


def write_centres(spark: SparkSession, centres: Centres, key: str, vec: str, path: str) -> None:
    """A row per cell, and one per top centre (with negative numbers)."""

    def plain(x: np.ndarray) -> list[float]:
        return [float(v) for v in x]

    parent = centres.parent if centres.parent is not None else [None] * len(centres)
    rows = [(n, plain(c), None if p is None else int(p), key, vec) for n, (c, p) in enumerate(zip(centres.cells, parent))]
    rows += [(-1 - n, plain(c), None, key, vec) for n, c in enumerate(centres.tops if centres.tops is not None else [])]
    table = spark.createDataFrame(rows, "cell int, centre array<double>, parent int, id string, vec string")
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def read_vectors(spark: SparkSession, path: str) -> IvfIndex:
    """A stored index: its rows by cell folders, and its centres (one row per cell)."""
    found = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    cells, tops = [r for r in found if r["cell"] >= 0], [r for r in found if r["cell"] < 0][::-1]
    centres = Centres(np.array([r["centre"] for r in cells]))
    if tops:
        centres = Centres(centres.cells, np.array([r["centre"] for r in tops]), np.array([r["parent"] for r in cells]))
    return IvfIndex(spark.read.parquet(f"{path}/rows"), centres, cells[0]["id"], cells[0]["vec"])


def nearest_cells(rows: DataFrame, centres: Centres, nprobe: int, vec: str = QVEC) -> DataFrame:
    """Each row once per probed cell. The centres number ``nlist``, not the size of the data."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = centres.probe(_matrix(batch[vec]), nprobe)
            table = pa.Table.from_batches([batch]).take(pa.array(np.repeat(np.arange(batch.num_rows), cells.shape[1])))
            table = table.append_column("cell", pa.array(cells.ravel().astype(np.int32)))
            yield from table.to_batches()

    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())])
    return rows.mapInArrow(probe, schema)


def search_ivf(
    queries: Side, index: IvfIndex, nprobe: int, k: int, payload: list[str] = (), block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Approximate top-k: exact cosine inside the probed cells; large cells are split into blocks.

    Only cells that some query probes are read from a stored index.
    """
    payload = list(payload)
    q = nearest_cells(_plain(queries, QID, QVEC), index.centres, nprobe)
    probed = [r["cell"] for r in q.select("cell").distinct().collect()]  # at most one number per cell
    rows = index.rows.filter(F.col("cell").isin(probed))
    c = _plain(Side(rows, index.id, index.vec), CID, CVEC, ["cell", *payload])
    return _shown(_grouped_hits(q, c, k, "cell", payload, block_rows), queries.id, index.id, payload)


def nearest(
    queries: Side, corpus: Side | IvfIndex, k: int, payload: list[str] = (), nprobe: int | None = None, **options
) -> DataFrame:
    """The k nearest rows of a table (exact) or of an index (``nprobe`` cells, all of them if not given)."""
    if isinstance(corpus, IvfIndex):
        return search_ivf(queries, corpus, nprobe or len(corpus.centres), k, payload, **options)
    return vector_topk(queries, corpus, k, payload, **options)


def recall(exact: DataFrame, approximate: DataFrame, query: str, item: str) -> DataFrame:
    """Share of the exact hits an approximate search found, per query."""
    found = approximate.select(query, item, F.lit(1).alias("_found"))
    joined = exact.select(query, item).join(found, [query, item], "left")
    return joined.groupBy(query).agg((F.count("_found") / F.count("*")).alias("recall"))
