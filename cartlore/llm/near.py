"""Near duplicates: MinHash bands propose pairs, odd sketches sift them, full shingle sets confirm them.

Each distinct shingle set is one class, whatever the number of its copies. A class has MinHash samples of its set; runs
of samples make band keys, and all samples together fold into an odd sketch: a bitmap in which every sample flips one bit. The XOR of two
sketches counts the samples that differ, from which high similarities follow closely, by a few words per class.

Within a band bucket nobody is paired with everybody. First every member is compared with the least one; members
that are then in one component need no more. Only members of different components are compared further, in blocks of bounded
size inside a task, by finer sketches; a task gives back the pairs whose sketches are near.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, maybe_in, mix, over_texts, seeds, shingle_sets, stored, text_parts, unused, whole

SHINGLE = 5  # words
LINK = Fraction(85, 100)  # op1's: linked if 100 * intersection >= 85 * union
ROWS, BANDS = 5, 24  # samples of a band at the most, and bands at the least; a pair of similarity 0.85 shares none once in 1.3 million times
_MISSED = 1e-6  # at the most, of the pairs that are just similar enough
_MANY_BANDS = 64  # more only if bands of one sample need them
COARSE = (ROWS * BANDS, 512)  # samples and bits of the sketch that every class has; lower similarities take more samples
FINE = (2048, 8192)  # of the classes that stay in doubt
_SIGMAS = 5.0
BLOCK = 256  # classes of a bucket compared with as many others at once


def minhash(sets: list[np.ndarray], samples: int = COARSE[0]) -> np.ndarray:
    """Least values of each set (the largest number for an empty set), by as many multiplicative hashes."""
    found = np.full((len(sets), samples), np.iinfo(np.uint64).max, np.uint64)
    factor, offset = seeds(21, samples)[:, None], seeds(22, samples)[:, None]
    step = 65_536 // samples + 1
    with np.errstate(over="ignore"):
        for i, own in enumerate(sets):
            for at in range(0, len(own), step):
                least = ((own[at : at + step] ^ offset) * factor).min(1)
                found[i] = np.minimum(found[i], least)
    return found


def band_keys(samples: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One key per band of ``rows`` samples: a hash of its samples and its number."""
    bands = samples.shape[1] // rows
    with np.errstate(over="ignore"):
        runs = mix(samples).reshape(len(samples), bands, rows)
        keys = (runs * seeds(23, rows)).sum(2, dtype=np.uint64) + seeds(24, bands)
        return mix(keys).view(np.int64)


def odd_sketches(samples: np.ndarray, bits: int = COARSE[1]) -> np.ndarray:
    """Parity bitmaps: the bit of (number, value) of each sample is flipped. Rows of 64-bit words."""
    with np.errstate(over="ignore"):
        places = (mix(samples + seeds(25, samples.shape[1])) % np.uint64(bits)).astype(np.int64)
    flat = places + np.arange(len(samples))[:, None] * bits
    parity = (np.bincount(flat.ravel(), minlength=len(samples) * bits) & 1).astype(np.uint8)
    return np.packbits(parity.reshape(len(samples), bits), axis=1).view(np.int64)


def similarity_estimate(differing: np.ndarray | float, kind: tuple[int, int] = COARSE) -> np.ndarray | float:
    """Similarity for which two odd sketches are expected to differ in so many bits."""
    samples, bits = kind
    share = np.minimum(2 * np.asarray(differing) / bits, 1 - 1e-9)
    return 1 + bits / (4 * samples) * np.log(1 - share)


def most_differing_bits(similarity: float, kind: tuple[int, int] = COARSE, sigmas: float = _SIGMAS) -> int:
    """Bits that a pair of this similarity differs in, at the most: the mean and ``sigmas`` standard deviations.

    Two errors add: the samples that differ (binomial, two flips each), and flips that meet on a bit.
    """
    samples, n = kind
    flips = 2 * samples * (1 - similarity)
    mean = n / 2 * (1 - math.exp(-2 * flips / n))
    drawn = 2 * math.sqrt(samples * similarity * (1 - similarity)) * math.exp(-2 * flips / n)
    folded = math.sqrt(n / 4 * (1 - math.exp(-4 * flips / n)))
    return math.ceil(mean + sigmas * math.hypot(drawn, folded))


@dataclass(frozen=True)
class Limits:
    """What follows from the least similarity of a linked pair: bands, and the bits its sketches differ in at the most."""

    least: Fraction
    rows: int
    bands: int

    @staticmethod
    def of(similarity: float | Fraction) -> Limits:
        least = Fraction(similarity).limit_denominator(10_000)  # 0.8 is 4/5
        if not 0 < least <= 1:
            raise ValueError(f"similarity must be above 0 and at most 1, not {similarity}")
        for rows in range(ROWS, 0, -1):
            unshared = 1 - float(least) ** rows
            bands = max(BANDS, math.ceil(math.log(_MISSED) / math.log(unshared)) if unshared else 1)
            if bands <= _MANY_BANDS:
                break
        return Limits(least, rows, bands)

    @property
    def coarse(self) -> tuple[int, int]:
        return self.rows * self.bands, COARSE[1]

    @property
    def most_bits(self) -> int:
        return most_differing_bits(float(self.least), self.coarse)

    @property
    def most_fine_bits(self) -> int:
        return most_differing_bits(float(self.least), FINE)


FEATURES = "doc_id long, n_shingles long, digest binary, bands array<long>, sketch array<long>"


def features(docs: DataFrame, limits: Limits) -> DataFrame:
    """Per row: set size, digest of the set (null if empty), band keys, odd sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch):
                sets = shingle_sets(Words(part.column("text"), lower=True), SHINGLE)
                samples = minhash(sets, limits.coarse[0])
                with np.errstate(over="ignore"):
                    sums = [(s.sum(dtype=np.uint64), (mix(s + np.uint64(1))).sum(dtype=np.uint64)) for s in sets]
                some = [len(s) > 0 for s in sets]
                digest = [b"%016x%016x%08x" % (a, b, len(s)) if len(s) else None for s, (a, b) in zip(sets, sums)]
                keys, sketch = band_keys(samples, limits.rows).tolist(), odd_sketches(samples).tolist()
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id"),
                        "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                        "digest": pa.array(digest, pa.binary()),
                        "bands": pa.array([k if x else [] for k, x in zip(keys, some)], pa.list_(pa.int64())),
                        "sketch": pa.array(sketch, pa.list_(pa.int64())),
                    }
                )

    return over_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text")), run, FEATURES)


def differing_bits(a: Column, b: Column) -> Column:
    """Population count of the XOR of two sketches."""
    counts = [F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(COARSE[1] // 64)]
    return sum(counts[1:], counts[0])


def _texts(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """doc_id and text of the documents that may be among the n ``ids``."""
    return maybe_in(docs.filter(F.col("doc_id").isNotNull()).select("doc_id", whole().alias("text")), "doc_id", ids, n)


def fine_sketches(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Large odd sketches of the documents in ``ids`` (one column, id): rows (id, sketch)."""
    ids = stored(ids, "near-in-doubt")
    texts = _texts(docs, ids, ids.count()).join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch, limit=1 << 18):
                samples = minhash(shingle_sets(Words(part.column("text"), lower=True), SHINGLE), FINE[0])
                sketch = pa.array(odd_sketches(samples, FINE[1]).tolist(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), sketch], ["id", "sketch"])

    return over_texts(texts, run, "id long, sketch array<long>").dropDuplicates(["id"])


def confirm(pairs: DataFrame, docs: DataFrame, least: Fraction) -> DataFrame:
    """The pairs (a, b) of doc_ids whose full shingle sets have at least the similarity ``least``."""
    over, under = least.numerator, least.denominator
    pairs = stored(pairs.select("a", "b"), "near-pairs")
    n = pairs.count()
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    texts = _texts(docs, ids, 2 * n)
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch, "text_a"):
                one, other = (shingle_sets(Words(part.column(c), lower=True), SHINGLE) for c in ("text_a", "text_b"))
                linked = []
                for x, y in zip(one, other):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(under * common >= over * (len(x) + len(y) - common) and common > 0)
                kept = part.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))
                yield kept

    return over_texts(both.select("a", "b", "text_a", "text_b"), run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id that each end of an edge (a, b) can reach.

    Every node takes the least label among its neighbours and then its label's label, until nothing changes. Labels are
    written each round; the driver sees one count.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-edges")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "near-labels")
    while True:
        of = labels.withColumnRenamed("id", "b").withColumnRenamed("component", "_near")
        near = both.join(of, "b").groupBy(F.col("a").alias("id")).agg(F.min("_near").alias("_near"))
        moved = labels.join(near, "id").select("id", F.col("component").alias("_old"), F.least("component", "_near").alias("component"))
        moved = stored(moved, "near-moved")
        # the label's own label; a label is always a node
        further = moved.select(F.col("id").alias("component"), F.col("component").alias("_next"))
        jumped = stored(moved.join(further, "component").select("id", "_old", F.col("_next").alias("component")), "near-jumped")
        labels = jumped.drop("_old")
        if not jumped.filter(F.col("component") != F.col("_old")).head(1):
            return labels


def _block_pairs(members: DataFrame, most_bits: int) -> DataFrame:
    """Pairs of members of one bucket, in different components, with sketches near by ``most_bits``; the least member is left out.

    ``members``: key, n (members of the bucket), id, component, sketch, and bands: the keys of all buckets that the id is compared in, by
    band, null for the others. A bucket is cut into blocks by a hash of the id; a member goes once to each pair of blocks that has its own. A
    pair that meets in several buckets comes out of the first one only, so every pair comes out once.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    dealt = (
        members.withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(
            "key", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"),
            F.col("_own").alias("own"), "id", "component", "sketch", "bands",
        )
    )

    def compare(group: tuple, ids: np.ndarray, comps: np.ndarray, own: np.ndarray, sketch: np.ndarray, bands: np.ndarray, used: np.ndarray):
        key, i, j = group
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        for at in range(0, len(left), 16):
            rows = left[at : at + 16]
            bits = np.bitwise_count(sketch[rows][:, None, :] ^ sketch[right][None, :, :]).sum(2, dtype=np.int64)
            near = (bits <= most_bits) & (comps[rows][:, None] != comps[right][None, :])
            if i == j:
                near &= ids[rows][:, None] < ids[right][None, :]
            x, y = np.nonzero(near)
            x, y = rows[x], right[y]
            shared = (bands[x] == bands[y]) & used[x] & used[y]
            first = bands[x, shared.argmax(axis=1)] == key
            yield ids[x[first]], ids[y[first]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            yield from groups(rest, False)
            rest = held[0]
        if rest is not None:
            yield from groups(rest, True)

    held: list[pa.Table | None] = [None]

    def groups(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        """Whole groups of the sorted rows; the last, perhaps unfinished one is held back."""
        n = table.num_rows
        names = np.stack([table.column(c).to_numpy() for c in ("key", "i", "j")], 1)
        starts = np.concatenate([[0], np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1, [n]]) if n else np.array([0])
        stop = len(starts) - 1 if last else len(starts) - 2
        held[0] = table.slice(int(starts[max(stop, 0)])) if not last else None
        if stop <= 0:
            return
        ids, comps, own = (table.column(c).to_numpy() for c in ("id", "component", "own"))
        sketch = table.column("sketch").combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(n, -1)
        keys = table.column("bands").combine_chunks().flatten()
        bands, used = keys.fill_null(0).to_numpy().reshape(n, -1), keys.is_valid().to_numpy(zero_copy_only=False).reshape(n, -1)
        found = [
            pair
            for a, b in zip(starts[:stop], starts[1 : stop + 1])
            for pair in compare(tuple(names[a]), ids[a:b], comps[a:b], own[a:b], sketch[a:b], bands[a:b], used[a:b])
        ]
        a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return over_texts(dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"), run, "a long, b long")


def near_duplicates(docs: DataFrame, similarity: float | Fraction = LINK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, class_id.

    Words are the runs of characters other than ``[\\x20\\x09-\\x0D]``, A-Z lower-cased; a document is the set of its
    five-word runs, or one run of all words if it has fewer. Documents whose sets meet in the share
    ``similarity`` of their union or more are linked; component_id is the least doc_id that links lead to. class_id is the least doc_id with the same set.

    Null, empty and blank texts have no shingles and stay alone. Rows with equal texts share a class, rows that repeat a doc_id share
    its component. A row without doc_id is kept and takes no part. Other columns are not read. An empty table
    gives an empty result.
    """
    limits = Limits.of(similarity)
    own = stored(features(docs, limits), "near-features")
    some = own.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    classes = stored(some.groupBy("digest").agg(F.min("doc_id").alias("class_id")), "near-classes")
    # joined by digest and id, so that the copies of one text spread
    first = some.join(classes.withColumnRenamed("class_id", "doc_id"), ["digest", "doc_id"]).select(
        F.col("doc_id").alias("id"), "bands", "sketch"
    )
    first = stored(first.dropDuplicates(["id"]), "near-first")
    banded = first.select("id", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least")).filter("n > 1")
    members = stored(banded.join(buckets, "key"), "near-members")

    sketches = first.select("id", "sketch")
    star = members.filter("id != least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    star = star.join(sketches.toDF("a", "_sa"), "a").join(sketches.toDF("b", "_sb"), "b")
    star = star.filter(differing_bits(F.col("_sa"), F.col("_sb")) <= limits.most_bits)
    edges = stored(confirm(star, docs, limits.least), "near-links")
    labels = components(edges)

    labelled = members.filter("n > 2").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    labelled = stored(labelled, "near-labelled")
    open_ = labelled.groupBy("key").agg(F.min("component").alias("_x"), F.max("component").alias("_y")).filter("_x != _y")
    left = stored(labelled.filter("id != least").join(open_.select("key"), "key", "left_semi"), "near-left")
    compared = left.groupBy("id").agg(F.collect_set("key").alias("_keys"))  # a key per band at the most
    bands = first.select("id", "bands").join(compared, "id")
    bands = bands.select("id", F.transform("bands", lambda k: F.when(F.array_contains("_keys", k), k)).alias("bands"))
    left = left.join(bands, "id").join(stored(fine_sketches(docs, left.select("id").distinct()), "near-fine"), "id")
    more = stored(confirm(_block_pairs(left, limits.most_fine_bits), docs, limits.least), "near-more")
    if more.head(1):
        labels = components(edges.unionByName(more))

    placed = own.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left")
    placed = placed.join(labels.withColumnRenamed("id", "class_id"), "class_id", "left")
    component = F.coalesce("component", "class_id", "doc_id")
    return placed.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
    )


def drop_near_duplicates(docs: DataFrame, similarity: float | Fraction = LINK) -> DataFrame:
    """The rows of ``docs`` that stay, one document per component (all rows that repeat its doc_id), with all their columns."""
    (name,) = unused(docs, "lost")
    lost = near_duplicates(docs, similarity).filter(~F.col("kept")).select(F.col("doc_id").alias(name))
    return docs.join(lost, F.col("doc_id") == F.col(name), "left_anti")


ORACLE = r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    s AS (
      SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
             ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    link AS (SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * common >= 85 * (x.n + y.n - common)),
    reach AS (SELECT doc_id, doc_id AS r FROM w UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON reach.r = link.a)
    SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, w.doc_id = m.component_id AS kept
    FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) m USING (doc_id)"""
