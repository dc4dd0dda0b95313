"""Byte-pair encoding with contiguous rank arrays.

A word is held as its parts and the merge ranks of neighbouring parts, both contiguous. The least rank is found by a
scan, the boundary under it deleted, and the ranks on both sides looked up anew, until no neighbours merge. Words of up to 32 bytes are
worked on many at a time, a row of a matrix each; each distinct word of a task is encoded once.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_texts, text_parts, whole

# Fixed value: the pattern that splits text before the merges of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NEVER = np.int32(2**31 - 1)
_SHORT = 32  # bytes of a word that is worked on in a matrix
_MEMORY = 150_000  # distinct words kept by a task, some 50 MB


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next free one from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def is_byte_level(path: str) -> bool:
    """Whether a tokenizers file is of the kind that ``Vocabulary`` encodes: byte-level pieces, plain merges, nothing normalised."""
    content = json.loads(Path(path).read_text("utf-8"))
    model, split = content["model"], content.get("pre_tokenizer") or {}
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    whole = all(not t[k] for t in content["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    byte_level = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    return model.get("type") == "BPE" and plain and whole and byte_level and content.get("normalizer") is None


class Vocabulary:
    """A byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        import regex

        content = json.loads(Path(path).read_text("utf-8"))
        ids, merges = content["model"]["vocab"], content["model"]["merges"]
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.n = max([*ids.values(), *self.special.values()]) + 1
        self.token_bytes = [b""] * self.n
        for token, i in ids.items():
            self.token_bytes[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.lengths = np.array([*map(len, self.token_bytes), 0], np.int64)  # the last stands for unknown ids
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self.first = np.array([ids[letter] for letter in byte_letters()], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in reversed(list(enumerate(pairs)))}
        table = sorted((a * self.n + b, rank, into) for (a, b), (rank, into) in self.merges.items())
        self.keys = np.array([t[0] for t in table] + [np.iinfo(np.int64).max], np.int64)
        self.ranks = np.array([t[1] for t in table] + [_NEVER], np.int32)
        self.into = np.zeros(len(pairs), np.int32)  # by rank
        for _, rank, into in table:
            self.into[rank] = into
        self.words = regex.compile(PATTERN)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.memory: dict[str, tuple[int, ...]] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank at which neighbours merge, elementwise."""
        keys = left.astype(np.int64) * self.n + right
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.ranks[at], _NEVER)

    def encode_short(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Words of similar length, at most ``_SHORT`` bytes, in one matrix."""
        n, width = len(words), max(map(len, words))
        lengths = np.fromiter(map(len, words), np.int64, n)
        rows = np.frombuffer(b"".join([w.ljust(width + 1, b"\0") for w in words]), np.uint8).reshape(n, width + 1)
        parts = self.first[rows]
        places = np.arange(width + 1)
        ranks = np.full((n, width + 1), _NEVER, np.int32)
        if width > 1:
            ranks[:, : width - 1] = self.rank(parts[:, : width - 1], parts[:, 1:width])
            ranks[places >= (lengths - 1)[:, None]] = _NEVER
        done: list[list[int]] = [[]] * n
        which, row = np.arange(n), np.arange(n)
        while len(which):
            at = ranks.argmin(1)
            least = ranks[row, at]
            merging = least != _NEVER
            if not merging.all():
                ended = ~merging
                for i, k, own in zip(which[ended].tolist(), lengths[ended].tolist(), parts[ended].tolist()):
                    done[i] = own[:k]
                parts, ranks, lengths, which = parts[merging], ranks[merging], lengths[merging], which[merging]
                at, least, row = at[merging], least[merging], row[: len(which)]
            # delete the boundary behind part ``at``: everything behind moves up by one
            behind = places[:-1] > at[:, None]
            parts[:, :-1] = np.where(behind, parts[:, 1:], parts[:, :-1])
            behind[row, at] = True
            ranks[:, :-1] = np.where(behind, ranks[:, 1:], ranks[:, :-1])
            lengths -= 1
            parts[row, at] = merged = self.into[least]
            has_next = at + 1 < lengths
            ranks[row, at] = np.where(has_next, self.rank(merged, parts[row, at + 1]), _NEVER)
            left = np.flatnonzero(at)
            i = at[left] - 1
            ranks[left, i] = self.rank(parts[left, i], merged[left])
        return [tuple(own) for own in done]

    def encode_long(self, word: bytes) -> tuple[int, ...]:
        """One long word: the same merges, least rank from a heap, neighbours by links."""
        parts = self.first[np.frombuffer(word, np.uint8)].tolist()
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.merges[p][0], i, *p) for i, p in enumerate(zip(parts, parts[1:])) if p in self.merges]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i] if parts[i] == left else n
            if j >= n or parts[j] != right:
                continue  # one of the two has merged since
            parts[i], parts[j] = int(self.into[rank]), -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n and (found := self.merges.get((parts[a], parts[b]))):
                    heapq.heappush(heap, (found[0], a, parts[a], parts[b]))
        return tuple(p for p in parts if p >= 0)

    def learn(self, words: set[str]) -> None:
        """Encode the words that are not remembered yet."""
        if len(self.memory) > _MEMORY:
            self.memory.clear()
        new = [w for w in words if w not in self.memory]
        data = [w.encode() for w in new]
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        order = np.argsort(lengths, kind="stable")
        n_short = int(np.searchsorted(lengths[order], _SHORT, "right"))
        for at in range(0, n_short, 2048):
            some = order[at : min(at + 2048, n_short)].tolist()
            self.memory.update(zip([new[i] for i in some], self.encode_short([data[i] for i in some])))
        for i in order[n_short:].tolist():
            self.memory[new[i]] = self.encode_long(data[i])

    def split(self, text: str) -> list[str]:
        """Pieces of a text: words, and special tokens as they are."""
        if not self.specials or not self.specials.search(text):
            return self.words.findall(text)
        pieces, at = [], 0
        for found in self.specials.finditer(text):
            pieces += self.words.findall(text[at : found.start()])
            pieces.append(found.group())
            at = found.end()
        return pieces + self.words.findall(text[at:])

    def _pieces(self, texts: list[str]) -> list[list[str]]:
        """Pieces of each text, all of them remembered."""
        pieces = [self.split(t) for t in texts]
        self.learn(set().union(*pieces))
        for token, i in self.special.items():
            self.memory[token] = (i,)
        return pieces

    def count(self, texts: list[str]) -> list[int]:
        """Number of tokens of each text."""
        return [sum(map(len, map(self.memory.__getitem__, p))) for p in self._pieces(texts)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        pieces = self._pieces(texts)
        return [list(chain.from_iterable(map(self.memory.__getitem__, p))) for p in pieces]

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Texts of the tokens' bytes; bytes that are not UTF-8 become replacement characters, unknown and null ids nothing."""
        tokens = ids.flatten().fill_null(self.n).to_numpy(zero_copy_only=False)
        tokens = np.where((tokens < 0) | (tokens >= self.n), self.n, tokens)
        counts = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        lengths = self.lengths[tokens]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        data = self.flat[np.repeat(self.starts[tokens] - ends[:-1], lengths) + np.arange(ends[-1])]
        bounds = ends[np.concatenate([[0], np.cumsum(counts)])]
        parts = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(counts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)]
        )
        try:
            return parts.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([t.decode("utf-8", "replace") for t in parts.to_pylist()], pa.string())


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary_of(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (array of int). Null and empty texts have no ids.

    The vocabulary file is read where the tasks run, so its path must hold on every executor. Special tokens
    inside a text are one id each, as the library's default takes them. Other columns are not read. Any text length
    is taken whole; a word of n bytes takes n log n steps. Repeated rows are encoded as often as they come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary_of(vocabulary)
        words.memory.clear()  # of the task before, if this worker had one
        for batch in batches:
            for part in text_parts(batch):
                ids = pa.array(words.encode(part.column("text").to_pylist()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])
        words.memory.clear()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return over_texts(docs.select("doc_id", whole().alias("text")), run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """Rows (doc_id, ids) with the text that the ids stand for; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary_of(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, words.decode(part.column("ids"))], ["doc_id", "ids", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return over_texts(encoded.select("doc_id", "ids"), run, f"doc_id {kind}, ids array<int>, text string")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``encode`` and ``decode`` in one pass: doc_id, ids, and the text decoded from the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary_of(vocabulary)
        words.memory.clear()
        for batch in batches:
            for part in text_parts(batch):
                ids = pa.array(words.encode(part.column("text").to_pylist()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, words.decode(ids)], ["doc_id", "ids", "text"])
        words.memory.clear()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return over_texts(docs.select("doc_id", whole().alias("text")), run, f"doc_id {kind}, ids array<int>, text string")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    coded = round_trip(docs, vocabulary)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
