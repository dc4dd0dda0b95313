"""Shared pieces of the training-data operators: tables, words, word hashes, bounded filters, scratch tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, shuffle_partitions, stored

SPACES = " \t\n\x0b\x0c\r"  # [\x20\x09-\x0D]; everything else belongs to a word
CHUNK_BYTES = 1 << 19  # of text worked on at a time inside a task


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole(text: str = "text") -> Column:
    """A text, null read as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with so many underscores in front that no column of ``df`` has one of them in any case."""
    taken, front = {c.lower() for c in df.columns}, "_"
    while any(front + n in taken for n in names):
        front += "_"
    return [front + n for n in names]


_BATCH_BYTES = 4 << 20


def give_back() -> None:
    """Return freed memory of Arrow and of the C library, where it can, to the operating system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def over_texts(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` for rows with whole texts: batches of some 4 MB instead of 64 (a longer text is a batch of its own).

    The session's limit is lowered for good, as batches are cut when the result is computed. A Python worker outlives its task, so
    what the task has freed goes back to the system at its end.
    """

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(name, "67108864b").rstrip("b")) > _BATCH_BYTES:
        conf.set(name, f"{_BATCH_BYTES}b")
    return df.mapInArrow(tidy, schema)


# --- a filter of bounded size -------------------------------------------------------------------

_BITMAP_BITS = 32_768  # of Spark's bitmap functions
FILTER_BITS = 1 << 26  # at most; 8 MB


def maybe_in(df: DataFrame, key: str, ids: DataFrame, n_ids: int, max_bits: int = FILTER_BITS) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be among ``ids`` (one column): all that are, and a few more.

    One bit per hashed id. The bitmap has 16 bits per id up to ``max_bits`` (8 MB), so it can always be broadcast;
    beyond that more rows pass, none is lost, and the exact join that follows does more of the work.
    """
    bits = _BITMAP_BITS
    while bits < min(16 * n_ids, max_bits):
        bits *= 2
    name = ids.columns[0]

    def place(col: str) -> Column:
        return F.pmod(F.xxhash64(F.col(col)), F.lit(bits)) + 1

    bitmap = (
        ids.select(place(name).alias("_bit"))
        .groupBy(F.bitmap_bucket_number("_bit").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_bits"))
    )
    at = F.bitmap_bit_position("_bit").cast("int")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = df.withColumn("_bit", place(key)).withColumn("_bucket", F.bitmap_bucket_number("_bit"))
    kept = marked.join(F.broadcast(bitmap), "_bucket").filter(F.getbit(byte, (at % 8).cast("int")) == 1)
    return kept.drop("_bucket", "_bits", "_bit")


# --- words of Arrow text columns, as numbers ----------------------------------------------------

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES.encode())] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def seeds(seed: int, n: int) -> np.ndarray:
    """``n`` repeatable odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_BYTE = seeds(11, 256)
_BASE = int(seeds(12, 1)[0])
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; kept per Python worker for texts up to the usual chunk."""
    found = _powers.get(base)
    if found is None or len(found) < n:
        size = max(n, 2 * CHUNK_BYTES)
        found = np.full(size, np.uint64(base))
        found[0] = 1
        np.multiply.accumulate(found, out=found)
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = found
    return found[:n]


def text_parts(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in slices of about ``limit`` bytes of text, one text at least."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths.astype(np.int64))
    at, n = 0, len(lengths)
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


class Words:
    """The words of several texts: ``doc`` numbers each word's text, ``hash`` is a 64-bit hash of its bytes.

    A hash is a polynomial over the whole word taken from prefix sums, so a chunk costs a few passes over its bytes
    and no Python per word. ``first[i]:first[i + 1]`` are the words of text i.
    """

    def __init__(self, texts: list[bytes] | pa.Array, lower: bool = False, hashes: bool = True):
        if isinstance(texts, (pa.Array, pa.ChunkedArray)):
            texts = [b"" if t is None else t for t in texts.cast(pa.large_binary()).to_pylist()]
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)  # a space ends every text
        if lower:
            self.data = _LOWER[self.data]
        word = np.empty(len(self.data) + 1, np.int8)
        word[0] = 0
        word[1:] = ~_IS_SPACE[self.data]
        change = np.diff(word)
        self.start = np.flatnonzero(change == 1)
        self.end = np.flatnonzero(change == -1)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        self.first = np.searchsorted(self.start, bounds)
        self.counts = np.diff(self.first)
        if hashes:
            with np.errstate(over="ignore"):
                n = len(self.data)
                total = np.zeros(n + 1, np.uint64)
                np.cumsum(_BYTE[self.data] * _power(_BASE, n), out=total[1:])
                span = (total[self.end] - total[self.start]) * _power(_BASE_INVERSE, n + 1)[self.start]
                self.hash = mix(span + (self.end - self.start).astype(np.uint64))

    def text(self, i: int, j: int) -> bytes:
        """Bytes from the start of word i to the end of word j - 1."""
        return self.data[self.start[i] : self.end[j - 1]].tobytes()


_STEP = seeds(13, 64)


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all runs of ``size`` words, and bounds per text; a shorter text is one run, one without words none."""
    counts = words.counts
    n_runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(n_runs)])
    with np.errstate(over="ignore"):
        padded = np.concatenate([words.hash, np.zeros(size, np.uint64)])
        at = np.repeat(words.first[:-1] - bounds[:-1], n_runs) + np.arange(bounds[-1])
        total = np.zeros(bounds[-1], np.uint64)
        for j in range(size):
            total += padded[at + j] * _STEP[j]
        short = np.flatnonzero((counts > 0) & (counts < size))
        for i in short:
            own = words.hash[words.first[i] : words.first[i + 1]]
            total[bounds[i]] = (own * _STEP[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    return mix(total), bounds


def shingle_sets(words: Words, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    runs, bounds = shingles(words, size)
    return [np.unique(runs[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


__all__ = [
    "SPACES", "documents", "whole", "stored", "maybe_in", "mix", "seeds", "text_parts", "Words", "shingles",
    "shingle_sets", "scratch_path", "shuffle_partitions", "over_texts", "unused",
]
