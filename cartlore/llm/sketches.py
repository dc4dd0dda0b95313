"""Document fingerprints that keep every shingle hash below a fixed fraction of the hash range.

All documents share the threshold, so a fingerprint of n shingles has about n * FRACTION hashes. Two fingerprints
merge by union, and the share of the smaller one that the larger one has estimates containment, however unequal the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, Words, over_texts, shingle_sets, shuffle_partitions, whole

FRACTION = 1 / 8
SHINGLE = 5  # words


def sketch(hashes: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The sorted hashes (their first 32 bits) below the threshold; the least one alone when none is.

    Texts without words give an empty sketch.
    """
    kept = hashes[hashes < np.uint64(int(fraction * 2**64))] if len(hashes) else hashes
    if not len(kept):
        kept = hashes[:1]
    return np.unique((kept >> np.uint64(32)).astype(np.uint32))


def merged(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """Sketch of the union of two shingle sets."""
    both = np.union1d(a, b)
    below = both[both < int(fraction * 2**32)]
    return below if len(below) else both[:1]


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the smaller shingle set that the other one has; 1 for two empty sketches, 0 for one."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def to_text(found: np.ndarray) -> str:
    """Eight hexadecimal digits per hash, ascending."""
    return found.astype(">u4").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def likeness(fingerprint: str, other: str) -> float:
    """Containment of two texts by their fingerprints alone.

    A text without a shingle hash below the threshold has its least hash only, which lies above the threshold, where other fingerprints
    have none: it is like texts with the same least hash, and unlike all others, even a longer one that holds it whole.
    """
    return containment(from_text(fingerprint), from_text(other))


def sketches(texts: list[bytes], fraction: float = FRACTION) -> list[np.ndarray]:
    return [sketch(s, fraction) for s in shingle_sets(Words(texts, lower=True), SHINGLE)]


def fingerprints(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """doc_id and fingerprint of every whole text; no shuffle. Null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .common import text_parts

        for batch in batches:
            for part in text_parts(batch):
                found = [to_text(s) for s in sketches([t.encode() for t in part.column("text").to_pylist()], fraction)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return over_texts(docs.select("doc_id", whole().alias("text")), run, f"doc_id {kind}, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last half of a text (rounded down, in code points) replaced by as many first ones of another, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _bounds(docs: DataFrame, parts: int) -> tuple[list[int], int | None]:
    """Existing doc_ids that cut the table into at most ``parts`` ranges of like size, and the least doc_id."""
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)]) if parts > 1 else F.array(F.lit(0.5))
    cuts, least = docs.agg(F.percentile_approx("doc_id", shares, F.lit(10 * parts)), F.min("doc_id")).first()
    return sorted({c for c in cuts or [] if c > least}), least


def compare_with_next(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """Fingerprints of every text, of its edited form and of the next document, with their likeness.

    The next document is the next row by (doc_id, text), null doc_ids last; after the last comes the first. Ranges of doc_ids go to
    one task each in one shuffle, and the first row of each range goes along to the range before, so every row
    meets its next one without a second pass. Null texts are empty. Rows that repeat a doc_id follow each other. Other
    columns are not read. A table of one row is its own next; an empty table gives an empty result. Likeness is ``likeness`` of the
    fingerprints, whatever the texts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    cuts, least = _bounds(rows, shuffle_partitions(spark))
    bounds, last = np.array(cuts, np.int64), len(cuts)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            part = np.where(null, last, np.searchsorted(bounds, ids, "right"))
            again = np.flatnonzero(~null & np.isin(ids, bounds))  # firsts of a range, for the range before
            around = np.flatnonzero((null & (least is None)) | (~null & (ids == (least or 0))))  # the first, for the last
            for at, to, extra in (
                (np.arange(len(ids)), part, 0), (again, part[again] - 1, 1), (around, np.full(len(around), last), 1)
            ):
                picked = batch.take(pa.array(at)) if extra else batch
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(to.astype(np.int32)), pa.array(np.full(len(at), extra, np.int32)), *picked.columns],
                        ["part", "extra", "doc_id", "text"],
                    )

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        texts: list[str] = []
        size, done = 0, False
        for batch in batches:
            for doc_id, text, extra in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "extra"))):
                if done:
                    break
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
                done = extra == 1
                if done or (size > CHUNK_BYTES // 2 and len(texts) > 1):
                    yield from compare(ids, texts)
                    ids, texts, size = ids[-1:], texts[-1:], len(text)

    def compare(ids: list[int | None], texts: list[str]) -> Iterator[pa.RecordBatch]:
        changed = [edited(a, b).encode() for a, b in zip(texts, texts[1:])]
        own, new = sketches([t.encode() for t in texts], fraction), sketches(changed, fraction)
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array(ids[:-1], pa.int64()),
                "n_chars": pa.array([len(t) for t in texts[:-1]], pa.int64()),
                "edited_sha256": [hashlib.sha256(t).hexdigest() for t in changed],
                "fingerprint": [to_text(s) for s in own[:-1]],
                "edited_fingerprint": [to_text(s) for s in new],
                "near_edited": [containment(a, b) for a, b in zip(own, new)],
                "near_next": [containment(a, b) for a, b in zip(own, own[1:])],
            }
        )

    routed = over_texts(rows, route, "part int, extra int, doc_id long, text string")
    ordered = routed.repartitionById(last + 1, F.col("part")).sortWithinPartitions(
        "extra", F.col("doc_id").asc_nulls_last(), "text"
    )
    return over_texts(ordered.select("extra", "doc_id", "text"), results, RESULT)
