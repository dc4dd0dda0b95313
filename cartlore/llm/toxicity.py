"""Toxicity by compression distance.

Two zstandard dictionaries are trained, on ordinary text and on toxic text. Each window of words is compressed once after the
ordinary dictionary alone and once after both; what the second saves is what only toxic text explains. How many
windows save how much is calibrated to a probability on labelled documents.

Insults are few words in long texts, so a dictionary of whole toxic documents would mostly hold ordinary words. It is
trained on what sets them apart: the words of toxic documents with letter runs that are frequent there and rare elsewhere.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, mix, over_texts, shingle_sets, stored, text_parts, whole

SAMPLE = 8192  # labelled rows that the classifier is fitted on, at most, by hash order
THRESHOLD = 0.7
WINDOW = 12  # words
PART = 4  # words of the parts of a window; divides WINDOW
LEVEL = 9
RUN = 5  # letters, the space before a word included
ORDINARY_BYTES, TOXIC_BYTES = 32 * 1024, 8 * 1024  # of the dictionaries
TRAINED_WINDOWS = 32_768  # distinct windows of the sampled ordinary rows that the trainer sees, at most, by hash order
_STEPS = (2, 3, 5)  # bytes saved


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def words_of(text: str) -> list[str]:
    return text.lower().split()


def windows_of(words: list[str], size: int = WINDOW) -> list[bytes]:
    return [f" {' '.join(words[i : i + size])} ".encode() for i in range(0, len(words), size)]


def runs_of(word: str) -> set[str]:
    word = " " + word
    return {word[i : i + RUN] for i in range(max(1, len(word) - RUN + 1))}


def telling(counts: list[tuple[str, int, int]], n_toxic: int, n_ordinary: int, times: float) -> set[str]:
    """Items of clearly more toxic documents than ordinary ones: ``times`` the share, 4.5 standard errors, 2 % of the toxic."""
    found = set()
    for item, toxic, ordinary in counts:
        a, b = toxic / max(n_toxic, 1), (ordinary + 0.5) / max(n_ordinary, 1)
        p = min((toxic + ordinary + 0.5) / max(n_toxic + n_ordinary, 1), 0.999)
        error = math.sqrt(p * (1 - p) * (1 / max(n_toxic, 1) + 1 / max(n_ordinary, 1)))
        if toxic >= max(3, n_toxic // 50) and a > times * b and a - b > 4.5 * error:
            found.add(item)
    return found


def train_dictionary(samples: Iterable[bytes], size: int) -> bytes:
    """What stands in front of a text for the compressor: the samples themselves where all of them fit, else a zstandard dictionary trained on them.

    The trainer fills the dictionary stretch by stretch, so like samples must not lie together: they come in hash order.
    """
    samples = sorted(samples, key=lambda s: (zlib.crc32(s), s))
    alone = b"".join(dict.fromkeys(samples))
    return alone if len(alone) <= size else zstandard.train_dictionary(size, samples, k=16, d=6).as_bytes()


def _summary(saved: np.ndarray, n: int) -> list[float]:
    """Windows by bytes saved (counts, shares of all n), the largest savings, the mean, and the length."""
    n = max(n, 1)
    top = np.sort(np.append(saved, [0, 0, 0]))[::-1][:3]
    gain = np.maximum(saved, 0).sum()
    counts = [(saved >= s).sum() for s in _STEPS]
    return [*(math.log1p(c) for c in counts), *(c / n for c in counts), top.sum() / 3, top[0], gain / n, math.log(n), math.log1p(gain)]


@dataclass
class Model:
    """Both dictionaries and the calibration; a few tens of KB, sent to the tasks."""

    ordinary: bytes
    toxic: bytes
    weights: np.ndarray | None = None
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None

    def __post_init__(self):
        settings = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS
        )
        # next to the text stands the toxic part or as many blanks, so distances into the ordinary part, and with
        # them the lengths of ordinary matches, are the same, and toxic matches are near
        found = []
        for nearer in (b"\0" * len(self.toxic), self.toxic):
            content = (self.ordinary + nearer).ljust(8, b"\0")
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=settings)
            found.append(zstandard.ZstdCompressor(compression_params=settings, dict_data=held).compress)
        self._plain, self._toxic = found

    def __reduce__(self):
        return Model, (self.ordinary, self.toxic, self.weights, self.centre, self.scale)

    def saved(self, windows: list[bytes]) -> np.ndarray:
        """Bytes by which the toxic dictionary shortens each window."""
        return np.array([len(self._plain(w)) - len(self._toxic(w)) for w in windows], np.int64)

    def features(self, text: str) -> list[float]:
        """Of all windows, and of the parts of all: see ``_summary``.

        A window that saves nothing can have parts that do, as a dearer parse elsewhere in it may cancel their saving.
        """
        words = words_of(text)
        whole, parts = (self.saved(windows_of(words, size)) for size in (WINDOW, PART))
        return _summary(whole, len(whole)) + _summary(parts, len(parts))

    def score(self, text: str) -> float:
        x = (np.array(self.features(text)) - self.centre) / self.scale
        return float(1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30))))

    def calibrated(self, features: np.ndarray, labels: np.ndarray) -> Model:
        """Logistic regression of the labels on the features, with a small ridge, by Newton's steps."""
        centre, scale = features.mean(0), features.std(0) + 1e-9
        x = np.column_stack([np.ones(len(features)), (features - centre) / scale])
        w = np.zeros(x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.eye(len(w))
            w += np.linalg.solve(curve, x.T @ (labels - p) - w)
        return Model(self.ordinary, self.toxic, w, centre, scale)


def _sample(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """At most ``size`` labelled documents, those of one label with equal shingle sets only once: doc_id, toxic, text."""
    marked = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    texts = docs.select("doc_id", whole().alias("text")).join(F.broadcast(marked), "doc_id")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch):
                sets = shingle_sets(Words(part.column("text"), lower=True))
                with np.errstate(over="ignore"):
                    sums = [(s.sum(dtype=np.uint64), mix(s + np.uint64(1)).sum(dtype=np.uint64)) for s in sets]
                digest = [b"%016x%016x%08x" % (a, b, len(s)) for s, (a, b) in zip(sets, sums)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(digest, pa.binary())], names)

    names = ["doc_id", "toxic", "text", "digest"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = over_texts(texts.select(names[:3]), keyed, f"doc_id {kind}, toxic int, text string, digest binary")
    alone = found.groupBy("toxic", "digest").agg(F.min(F.struct("doc_id", "text")).alias("row")).select("row.doc_id", "toxic", "row.text")
    return stored(alone, "toxic-sample")


def _counts(sample: DataFrame, items) -> DataFrame:
    """Documents with each item, by label: item, toxic, ordinary. ``items`` gives the distinct items of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                counts[toxic].update(items(text))
        for toxic, found in counts.items():
            n = list(found.values())
            zero = [0] * len(n)
            columns = [list(found), n if toxic else zero, zero if toxic else n]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], names)

    names = ["item", "toxic", "ordinary"]
    partial = over_texts(sample.select("toxic", "text"), run, "item string, toxic long, ordinary long")
    return partial.groupBy("item").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def train(
    docs: DataFrame, labels: DataFrame, sample_size: int = SAMPLE, windows: int = TRAINED_WINDOWS
) -> Model:
    """Fit the model to documents that ``labels`` (doc_id, toxic) marks, held-out ones excepted.

    Counting runs on Spark; the driver gets letter runs, words and windows of the bounded sample, and one row of
    features per sampled document. The ordinary dictionary is trained on ``windows`` distinct windows of least hash, taken from all windows of the
    whole texts of all sampled ordinary documents alike (all windows, if there are no more).
    Of contradicting labels of a document the toxic one counts. Without labelled documents
    all scores are 0.
    """
    sample = _sample(docs, labels, sample_size)
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_ordinary = sizes.get(1, 0), sizes.get(0, 0)
    least = max(3, n_toxic // 50)

    def runs(text: str) -> set[str]:
        return set().union(*map(runs_of, set(words_of(text)))) if text else set()

    rows = [tuple(r) for r in _counts(sample, runs).filter(F.col("toxic") >= least).collect()]
    sure, fair = (telling(rows, n_toxic, n_ordinary, times) for times in (20, 4))

    def suspects(text: str) -> list[str]:
        return [w for w in set(words_of(text)) if runs_of(w) & fair]

    candidates = [tuple(r) for r in _counts(sample, suspects).filter("toxic > 0").collect()]
    ratio = n_ordinary / max(n_toxic, 1)
    marks = {
        w for w, a, b in candidates
        if (runs_of(w) & sure and a * ratio > 20 * b) or (a >= 3 and a * ratio > 20 * (b + 0.1))
    }

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a toxic document its marked words, of an ordinary one its windows."""
        for batch in batches:
            toxic, text = [], []
            for label, t in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                if label:
                    own = [w for w in words_of(t) if w in marks]
                    some = [f" {' '.join(own)} ".encode()] if own else []
                else:
                    some = windows_of(words_of(t))
                toxic += [label] * len(some)
                text += some
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(text, pa.binary())], ["toxic", "line"])

    every = over_texts(sample.select("toxic", "text"), lines, "toxic int, line binary")
    toxic = [bytes(r["line"]) for r in every.filter("toxic = 1").collect()]
    least_hash = every.filter("toxic = 0").select("line").distinct().orderBy(F.xxhash64("line"), "line").limit(windows)
    ordinary = [bytes(r["line"]) for r in least_hash.collect()]
    model = Model(train_dictionary(ordinary, ORDINARY_BYTES), train_dictionary(toxic, TOXIC_BYTES))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [model.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    rows = over_texts(sample.select("toxic", "text"), measured, "toxic int, x array<double>").collect()
    if not rows:
        n = len(model.features(""))
        return Model(model.ordinary, model.toxic, np.concatenate([[-30.0], np.zeros(n)]), np.zeros(n), np.ones(n))
    rows = sorted((r["toxic"], r["x"]) for r in rows)
    return model.calibrated(np.array([x for _, x in rows]), np.array([y for y, _ in rows], float))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted; whole texts, null as empty, no shuffle.

    Only the text enters a score, so rows with equal texts have equal scores. Empty texts get the score of a document without
    suspicious windows. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch):
                scores = pa.array([model.score(t) for t in part.column("text").to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), scores], ["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), whole().alias("text"))
    scored = over_texts(rows, run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns; filtered where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch):
                kept = [model.score(t or "") < threshold for t in part.column("text").to_pylist()]
                yield part.filter(pa.array(kept, pa.bool_()))

    return over_texts(docs, run, docs.schema)


def labels(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
