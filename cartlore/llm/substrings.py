"""Removal of long repeated passages by a compacted, sparse de Bruijn graph over words.

Every window of 50 words names its least k-mer (k = 10) by hash; a k-mer that some window names is an edge of the graph. Equal windows
name the same edge, so edges found in one document only need no further look. A join brings each repeated edge
its number of occurrences, its first document and whether the same words always lead to the next edge. Where that is so
and both ends occur equally often, the path does not branch; such runs are one path, which stands in the same
documents as a whole, and windows inside it are settled by the path. Windows that reach beyond a path's ends are verified at
their source coordinates: digests of their words are compared over all documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, maybe_in, mix, over_texts, seeds, stored, text_parts, whole

WINDOW = 50  # words
K = 10
_SPAN = WINDOW - K + 1  # k-mers of a window
_BASES = [int(b) for b in seeds(31, 2)]
_INVERSES = [pow(b, -1, 1 << 64) for b in _BASES]
KEY = ["doc_id", "crc"]  # rows that repeat a doc_id with another text stay apart


class Runs:
    """Hashes of word runs of one document from prefix sums."""

    def __init__(self, words: np.ndarray):
        self.sums, self.back = [], []
        with np.errstate(over="ignore"):
            for base, inverse in zip(_BASES, _INVERSES):
                power = np.full(len(words) + 1, np.uint64(base))
                power[0] = 1
                np.multiply.accumulate(power, out=power)
                back = np.full(len(words) + 1, np.uint64(inverse))
                back[0] = 1
                self.back.append(np.multiply.accumulate(back))
                self.sums.append(np.concatenate([[np.uint64(0)], np.cumsum(words * power[:-1])]))

    def hash(self, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        with np.errstate(over="ignore"):
            sums = self.sums[which]
            return mix((sums[end] - sums[start]) * self.back[which][start] + (end - start).astype(np.uint64))


def window_edges(runs: Runs, n: int) -> np.ndarray:
    """For each window of a document of n words, the place of its least k-mer, the leftmost of equals."""
    at = np.arange(n - K + 1)
    least = runs.hash(at, at + K)
    width = 1
    while width < _SPAN:
        step = min(width, _SPAN - width)
        right = least[step:] < least[:-step]
        at = np.where(right, at[step:], at[:-step])
        least = np.where(right, least[step:], least[:-step])
        width += step
    return at


def edges(docs: DataFrame) -> DataFrame:
    """Edges of every document: edge (hash), doc_id, crc, nth (edge of the document), onward (hash of the words up to and
    with the next edge; of the last edge a value of its own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch):
                words = Words(part.column("text"))
                ids, crcs = part.column("doc_id").to_numpy(), part.column("crc").to_numpy()
                found = []
                for i in np.flatnonzero(words.counts >= WINDOW):
                    runs = Runs(words.hash[words.first[i] : words.first[i + 1]])
                    places = np.unique(window_edges(runs, words.counts[i]))
                    onward = np.empty(len(places), np.uint64)
                    onward[:-1] = runs.hash(places[:-1], places[1:] + K)
                    own = np.array([ids[i], places[-1]]).astype(np.uint64)
                    onward[-1:] = mix(mix(own[:1]) + own[1:])
                    n = len(places)
                    found.append((runs.hash(places, places + K), np.full(n, ids[i]), np.full(n, crcs[i]), np.arange(n), onward))
                if found:
                    edge, doc, crc, nth, onward = (np.concatenate(c) for c in zip(*found))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(edge.view(np.int64)), pa.array(doc), pa.array(crc.astype(np.int32)),
                         pa.array(nth.astype(np.int32)), pa.array(onward.view(np.int64))],
                        ["edge", "doc_id", "crc", "nth", "onward"],
                    )

    return over_texts(docs.select("doc_id", "crc", "text"), run, "edge long, doc_id long, crc int, nth int, onward long")


def repeated_edges(found: DataFrame) -> DataFrame:
    """Edges of more than one document: edge, n (occurrences), first_doc, straight (always leads to the same next edge)."""
    total = found.groupBy("edge").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("_last"),
        F.min("onward").alias("_a"), F.max("onward").alias("_b"),
    )
    total = total.filter("first_doc < _last")
    return total.select("edge", "n", "first_doc", (F.col("_a") == F.col("_b")).alias("straight"))


def _ranges(flags: np.ndarray) -> tuple[list[int], list[int]]:
    change = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist()


def judge(texts: DataFrame) -> DataFrame:
    """Settle the windows of documents with repeated edges.

    ``texts``: doc_id, crc, text, marks (structs nth, n, first_doc, straight). Returns doc_id, crc, the word ranges
    ``start``/``end`` that windows inside paths remove, and the windows still to verify: ``place`` and two hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch):
                words = Words(part.column("text"))
                rows = []
                for i, (doc, crc) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("crc").to_pylist())):
                    marks = part.column("marks")[i].values
                    mark = {c: marks.field(c).to_numpy(zero_copy_only=False) for c in ("nth", "n", "first_doc", "straight")}
                    n = int(words.counts[i])
                    runs = Runs(words.hash[words.first[i] : words.first[i + 1]])
                    named = window_edges(runs, n)
                    places, of = np.unique(named, return_inverse=True)
                    size, first = np.zeros(len(places), np.int64), np.full(len(places), doc)
                    straight = np.zeros(len(places), bool)
                    size[mark["nth"]], first[mark["nth"]], straight[mark["nth"]] = mark["n"], mark["first_doc"], mark["straight"]
                    joined = straight[:-1] & (size[:-1] == size[1:]) & (size[:-1] > 0)
                    path = np.concatenate([[0], np.cumsum(~joined)])
                    heads = np.flatnonzero(np.concatenate([[True], ~joined]))
                    tails = np.concatenate([heads[1:], [len(places)]]) - 1
                    start, end = places[heads][path][of], places[tails][path][of] + K
                    window = np.arange(len(named))
                    inside = (window >= start) & (window + WINDOW <= end)
                    repeated = size[of] > 0
                    covered = np.zeros(n + 1, np.int64)
                    lost = window[inside & repeated & (first[of] < doc)]
                    np.add.at(covered, lost, 1)
                    np.add.at(covered, lost + WINDOW, -1)
                    open_ = window[repeated & ~inside]
                    digest = [runs.hash(open_, open_ + WINDOW, k).view(np.int64) for k in (0, 1)]
                    rows.append((doc, crc, *_ranges(np.cumsum(covered)[:-1] > 0), open_, *digest))
                names = ["doc_id", "crc", "start", "end", "place", "one", "two"]
                kinds = [pa.int64(), pa.int32(), *[pa.list_(pa.int32())] * 3, *[pa.list_(pa.int64())] * 2]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    schema = "doc_id long, crc int, start array<int>, end array<int>, place array<int>, one array<long>, two array<long>"
    return over_texts(texts.select(*KEY, "text", "marks"), run, schema)


def cut(texts: DataFrame) -> DataFrame:
    """Remove word ranges: doc_id, crc, text, start, end (arrays) in; doc_id, crc, n_removed, kept (words joined by a space) out.

    Ranges may overlap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch):
                kept, lost = [], []
                for text, starts, ends in zip(*(part.column(c).to_pylist() for c in ("text", "start", "end"))):
                    words = text.encode().split()
                    flags = np.zeros(len(words) + 1, np.int64)
                    np.add.at(flags, np.array(starts, np.int64), 1)
                    np.add.at(flags, np.array(ends, np.int64), -1)
                    gone = np.cumsum(flags)[:-1] > 0
                    kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode())
                    lost.append(int(gone.sum()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("crc"), pa.array(lost, pa.int64()), pa.array(kept, pa.string())],
                    ["doc_id", "crc", "n_removed", "kept"],
                )

    return over_texts(texts.select(*KEY, "text", "start", "end"), run, "doc_id long, crc int, n_removed long, kept string")


def keyed(docs: DataFrame) -> DataFrame:
    text = whole()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.crc32(text.cast("binary")) - 2**31).cast("int").alias("crc"), text.alias("text"))


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """Word ranges to remove: doc_id, crc, start, end (arrays, may overlap), one row per document that loses words.

    A window of 50 words is removed if its words also start in a document with a smaller doc_id. Repeats within a
    document, or under one doc_id, do not count. A row without doc_id neither loses words nor is a source. Null, empty and
    short texts have no windows. Other columns are not read.
    """
    rows = keyed(docs).filter(F.col("doc_id").isNotNull())
    found = stored(edges(rows), "sub-edges")
    repeated = stored(repeated_edges(found), "sub-repeated")
    mark = F.struct("nth", "n", "first_doc", "straight")
    marks = found.join(repeated, "edge").groupBy(*KEY).agg(F.collect_set(mark).alias("marks"))
    marks = stored(marks, "sub-marks")
    texts = maybe_in(rows, "doc_id", marks.select("doc_id"), marks.count())
    judged = stored(judge(texts.join(marks, KEY)), "sub-judged").dropDuplicates(KEY)

    open_ = judged.select(*KEY, F.explode(F.arrays_zip("place", "one", "two")).alias("w")).select(*KEY, "w.*")
    sources = open_.groupBy("one", "two").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("_last"))
    sources = stored(sources.filter("first_doc < _last").drop("_last"), "sub-sources")
    verified = open_.join(sources, ["one", "two"]).filter("doc_id > first_doc").groupBy(*KEY).agg(F.collect_list("place").alias("place"))
    settled = judged.filter(F.size("start") > 0).select(*KEY, "start", "end")
    checked = verified.select(*KEY, F.col("place").alias("start"), F.transform("place", lambda p: p + WINDOW).alias("end"))
    both = settled.unionByName(checked).groupBy(*KEY)
    return both.agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("start", "end")))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document that loses words: doc_id, crc, n_removed, kept (the text that is left)."""
    ranges = stored(repeated_ranges(docs), "sub-ranges")
    texts = maybe_in(keyed(docs).filter(F.col("doc_id").isNotNull()), "doc_id", ranges.select("doc_id"), ranges.count())
    return cut(texts.join(ranges, KEY))


def _whole_digests(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [t.encode().split() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("crc"), pa.array([len(w) for w in words], pa.int64()),
                    pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words], pa.string()),
                ],
                ["doc_id", "crc", "n_words", "whole_sha256"],
            )

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(part for batch in batches for part in text_parts(batch))

    return over_texts(rows, parts, "doc_id long, crc int, n_words long, whole_sha256 string")


def digests(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (of the words that stay, joined by one space)."""
    shorter = remove_repeats(docs).select(*KEY, "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("cut_sha256"))
    shorter = stored(shorter, "sub-cut").dropDuplicates(KEY)
    rows = _whole_digests(keyed(docs)).join(shorter, KEY, "left")
    return rows.select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("cut_sha256", "whole_sha256").alias("kept_sha256"),
    )


ORACLE = r"""
    WITH w AS (
      SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    v AS (
      SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
    lost AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS f FROM v) WHERE f < doc_id),
    gone AS (SELECT doc_id, list(DISTINCT i + j) AS g FROM lost, range(0, 50) r(j) GROUP BY doc_id)
    SELECT w.doc_id, len(ws) AS n_words, coalesce(len(g), 0) AS n_removed,
           sha256(array_to_string(CASE WHEN g IS NULL THEN ws
                  ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(g, i)), lambda i: ws[i]) END, ' ')) AS kept_sha256
    FROM w LEFT JOIN gone USING (doc_id)"""
