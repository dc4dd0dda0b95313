"""Spelling variants by Bloom-guided neighbourhoods.

Two words are near if one inserted, deleted or replaced code point turns one into the other. Each word's edits are generated as
hashes and probed against Bloom filters of the whole vocabulary, one per word length, cut into blocks of 512 bits so that a probe
touches one cache line. Only edits that the filters let through become rows; an exact join with the vocabulary
removes the false ones. An insertion is the deletion of its longer word, and a replacement is generated from the word with the smaller
code point only, so every near pair is found once and then turned around.

The filters hold ``BITS_PER_WORD`` bits a word and together at most ``FILTER_BITS`` bits (64 MB). A larger vocabulary
is dealt into as many parts by hash as that needs, and each part has its own broadcast and its own round of probes: broadcasts stay bounded,
the share of false positives stays the same, nothing is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, seeds, stored, whole

LEAST_LENGTH = 6  # code points of a word
LEAST_N = 5  # occurrences of a word
FACTOR = 5  # a form occurs at least so many times as often

BITS_PER_WORD = 16
FILTER_BITS = 1 << 29  # of all filters of a part
PROBES = 6  # bits a word sets in its block
_BLOCK = 512  # bits
_LANES = _BLOCK // 64
_LONG = 48  # code points; longer words share one filter
_AT_ONCE = 1 << 17  # hashes worked on at a time

_BASE = int(seeds(31, 1)[0])
_INVERSE = pow(_BASE, -1, 1 << 64)
_SALT = np.uint64(seeds(32, 1)[0])


# --- hashes of words and of their edits ---------------------------------------------------------


def _values(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(np.uint64) + _SALT)


def _powers(base: int, n: int) -> np.ndarray:
    found = np.full(n, np.uint64(base))
    found[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(found)


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in the list and code points (a row per word) of words of one length, some at a time."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        step = max(1, _AT_ONCE // max(1, int(length)))
        for i in range(0, len(at), step):
            part = at[i : i + step]
            text = "".join(words[j] for j in part)
            yield part, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), length)


def hashes(codes: np.ndarray) -> np.ndarray:
    """Hash of each row: a polynomial of its code points modulo 2 ** 64, so that edits of it are cheap."""
    with np.errstate(over="ignore"):
        return (_values(codes) * _powers(_BASE, codes.shape[1])).sum(1, dtype=np.uint64)


def deletions(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, hash) of each row without one code point; of a run of equal ones only the first is left out."""
    n = codes.shape[1]
    with np.errstate(over="ignore"):
        terms = _values(codes) * _powers(_BASE, n)
        sums = np.cumsum(terms, axis=1)
        found = (sums - terms) + (sums[:, -1:] - sums) * np.uint64(_INVERSE)
    new = np.ones(codes.shape, bool)
    new[:, 1:] = codes[:, 1:] != codes[:, :-1]
    row, place = np.nonzero(new)
    return row, place, found[row, place]


def replacements(codes: np.ndarray, letter: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, hash) of each row with a smaller code point replaced by ``letter``."""
    row, place = np.nonzero(codes < letter)
    with np.errstate(over="ignore"):
        values = _values(codes)
        powers = _powers(_BASE, codes.shape[1])
        whole_word = (values * powers).sum(1, dtype=np.uint64)
        change = (_values(np.array([letter])) - values[row, place]) * powers[place]
        return row, place, whole_word[row] + change


# --- blocked Bloom filters ----------------------------------------------------------------------


def shard(length: int) -> int:
    return min(length, _LONG)


def _in_block(found: np.ndarray, blocks: int) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """The block of each hash, and its bits there as (lane, mask), one after another."""
    first = mix(found)
    second = mix(first + _SALT)
    block = ((first >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)

    def bits() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in range(PROBES):
            bit = (second >> np.uint64(9 * i)) & np.uint64(_BLOCK - 1)
            yield (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63))

    return block.astype(np.int64), bits()


class Filters:
    """One blocked Bloom filter per word length, one behind another in one array. ``counts``: words by shard."""

    def __init__(self, counts: dict[int, int], parts: int):
        self.blocks = {s: max(1, math.ceil(n * BITS_PER_WORD / _BLOCK / parts)) for s, n in sorted(counts.items())}
        self.first = dict(zip(self.blocks, np.concatenate([[0], np.cumsum(list(self.blocks.values()))[:-1]]).tolist()))
        self.size = sum(self.blocks.values())
        self.words = np.zeros(0, np.uint64)

    def places(self, found: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Block numbers of hashes of words of a length, and the bits they set there, a row of words each."""
        s = shard(length)
        block, bits = _in_block(found, self.blocks[s])
        lanes = np.zeros((len(found), _LANES), np.uint64)
        for lane, mask in bits:
            lanes[np.arange(len(found)), lane] |= mask
        return block + self.first[s], lanes

    def fill(self, blocks: np.ndarray, lanes: np.ndarray) -> None:
        self.words = np.zeros((self.size, _LANES), np.uint64)
        self.words[blocks] = lanes

    def may_have(self, found: np.ndarray, length: int) -> np.ndarray:
        """Places of the hashes that may belong to a word of this length."""
        s = shard(length)
        if s not in self.blocks:
            return np.zeros(0, np.int64)
        block, bits = _in_block(found, self.blocks[s])
        block += self.first[s]
        at = np.arange(len(found))
        for lane, mask in bits:
            at = at[self.words[block[at], lane[at]] & mask[at] != 0]
        return at


def part_of(found: np.ndarray, parts: int) -> np.ndarray:
    return mix(found ^ _SALT) % np.uint64(parts)


def _filters(words: DataFrame, counts: dict[int, int], part: int, parts: int) -> Filters:
    """The filters of one part of the vocabulary: bits are set in tasks, joined by block, and collected (64 MB at the most)."""
    empty = Filters(counts, parts)
    lanes = [f"b{i}" for i in range(_LANES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, codes in by_length(batch.column(0).to_pylist()):
                found = hashes(codes)
                found = found[part_of(found, parts) == part]
                block, bits = empty.places(found, codes.shape[1])
                columns = [block, *np.ascontiguousarray(bits.T).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", *lanes])

    marks = words.select("word").mapInArrow(run, ", ".join(f"{c} long" for c in ["block", *lanes]))
    found = marks.groupBy("block").agg(*(F.bit_or(c).alias(c) for c in lanes)).toArrow()
    columns = [found.column(c).to_numpy() for c in ["block", *lanes]]
    empty.fill(columns[0], np.stack(columns[1:], axis=1).view(np.uint64) if len(columns[0]) else np.zeros((0, _LANES), np.uint64))
    return empty


def _positives(words: DataFrame, filters: Filters, letters: np.ndarray, part: int, parts: int) -> DataFrame:
    """(word, n, edit) for each edit of a word that the filters of a part let through."""
    sent = words.sparkSession.sparkContext.broadcast((filters, letters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, alphabet = sent.value
        for batch in batches:
            words, ns = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, codes in by_length(words):
                length = codes.shape[1]
                tries = [("", length - 1, deletions(codes))] if shard(length - 1) in own.blocks else []
                more = ((chr(c), length, replacements(codes, c)) for c in alphabet)
                out: tuple[list, list, list] = ([], [], [])
                for letter, to, (row, place, found) in (x for source in (tries, more) for x in source):
                    kept = own.may_have(found, to)
                    kept = kept[part_of(found[kept], parts) == part]
                    for r, i in zip(at[row[kept]].tolist(), place[kept].tolist()):
                        word = words[r]
                        out[0].append(word)
                        out[1].append(ns[r])
                        out[2].append(word[:i] + letter + word[i + 1 :])
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1], pa.int64()), pa.array(out[2])], ["word", "n", "edit"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, edit string")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all ordered pairs of near words of a stored vocabulary (word, n; words not null and distinct)."""
    length = F.least(F.char_length("word"), F.lit(_LONG))
    counts = {r[0]: r[1] for r in words.groupBy(length.alias("shard")).count().collect()}  # at most 48 rows
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).filter("letter != ''").distinct()
    alphabet = np.sort([ord(r[0]) for r in letters.collect()]).astype(np.int64)  # as many as there are code points at the most
    parts = max(1, math.ceil(sum(counts.values()) * BITS_PER_WORD / FILTER_BITS))
    known = words.select(F.col("word").alias("edit"), F.col("n").alias("edit_n"))

    def pairs(part: int) -> DataFrame:
        positives = _positives(words, _filters(words, counts, part, parts), alphabet, part, parts)
        return stored(positives.join(known, "edit").select("word", "n", "edit", "edit_n"), "variant-pairs")

    found = reduce(DataFrame.unionByName, map(pairs, range(parts)))
    both = F.array(
        F.struct("word", "n", F.col("edit").alias("near"), F.col("edit_n").alias("near_n")),
        F.struct(F.col("edit").alias("word"), F.col("edit_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")),
    )
    return found.select(F.inline(both))


# --- groups -------------------------------------------------------------------------------------


def roots(links: DataFrame) -> DataFrame:
    """(word, root) for stored links (word, form) without cycles: where following forms ends. Each round doubles the steps taken."""
    now = stored(links.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stored(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "variant-roots")
        if not moved.filter("moved").head(1):
            return moved.select("word", "root")
        now = moved.select("word", "root")


def variant_groups(words: DataFrame, least_length: int = LEAST_LENGTH, least_n: int = LEAST_N, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of at least ``least_length`` code points and ``least_n`` occurrences.

    ``words`` has (word, n); the n of repeated words add up, null words and null counts play no part, other columns are not
    read. n_near counts the near words in the vocabulary. form is the near word of largest n, of equal ones the first in code-point order, if
    that n is at least ``factor`` (above 1) times the word's, else null, and form_n its n. root is where following forms ends, the word itself
    without a form: n grows by the factor with each step, so there are no cycles and a few rounds of joins reach the end. Words may
    be of any length. An empty table gives an empty result.
    """
    if factor <= 1:
        raise ValueError(f"factor must be above 1, not {factor}")
    counted = words.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    known = stored(counted.filter((F.char_length("word") >= least_length) & (F.col("n") >= least_n)), "variant-words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_pairs(known).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    has_form = -F.col("best.less") >= F.col("n") * F.lit(factor)
    found = known.join(near, "word", "left").select(
        "word",
        F.when(has_form, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(has_form, -F.col("best.less")).alias("form_n"),
    )
    found = stored(found, "variant-forms")
    ends = roots(found.filter("form IS NOT NULL").select("word", "form"))
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


# --- the words of documents, with slips put in ---------------------------------------------------

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SLIPS = 199  # one in so many (document, word) loses a code point


def words_with_slips(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n) once per occurrence: runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lower-cased, some without one code point.

    The run loses code point h % length if 199 divides h, the CRC-32 of ``<doc_id>:<run>`` (a null doc_id is empty there). Runs
    shorter than ``least_length`` are left out, as a slip makes none longer. Null texts have no words.
    """
    runs = F.regexp_extract_all(F.translate(whole(), _UPPER, _LOWER), F.lit(f"[a-zÀ-ÿ]{{{least_length},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    marked = rows.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    return marked.select(_slipped().alias("word"), F.lit(1).cast("long").alias("n"))


def _slipped() -> Column:
    at = (F.col("h") % F.char_length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    return F.when(F.col("h") % _SLIPS == 0, short).otherwise(F.col("run"))


#: CRC-32 by its definition, as a DuckDB macro cannot be registered: the reflected polynomial 0xEDB88320, a byte at a time.
CRC_TABLE = """
    SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k:
            CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))"""


def crc_sql(text: str) -> str:
    """DuckDB SQL for the CRC-32 of a text, with the table ``crc`` of ``CRC_TABLE`` joined."""
    data = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i::INT + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {data}), lambda c, b: xor(c >> 8, crc.t[xor(c, b) % 256 + 1])), 4294967295)"


ORACLE = f"""
    WITH RECURSIVE crc AS ({CRC_TABLE}),
    runs AS (SELECT doc_id, r, count(*) AS k FROM (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-zÀ-ÿ]{{6,}}')) AS r
        FROM documents) GROUP BY ALL),
    hashed AS (SELECT r, k, {crc_sql("(doc_id || ':' || r)")} AS h FROM runs, crc),
    slips AS (SELECT CASE WHEN h % 199 = 0 THEN left(r, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS word, k
        FROM hashed),
    words AS (SELECT word, sum(k)::BIGINT AS n FROM slips GROUP BY word HAVING length(word) >= 6 AND sum(k) >= 5),
    cuts AS (SELECT word, n, i, left(word, i::INT - 1) || substr(word, i::INT + 1) AS cut, word[i::INT] AS letter
        FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
    pairs AS (
        SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.cut = b.cut AND a.letter <> b.letter
        UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.cut = w.word
        UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.cut = w.word),
    near AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
    forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form,
        CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN near USING (word)),
    steps AS (SELECT word, word AS here, 0 AS d FROM forms
        UNION ALL SELECT s.word, f.form, d + 1 FROM steps s JOIN forms f ON s.here = f.word WHERE f.form IS NOT NULL)
    SELECT f.word, form, root, n, n_near, form_n FROM forms f
    JOIN (SELECT word, arg_max(here, d) AS root FROM steps GROUP BY word) USING (word)"""
