"""Byte-level BPE: encoding by length-bucketed numpy matrices, and decoding.

Every distinct pre-token becomes a row of a padded matrix of its length bucket. Each round looks
all adjacent pairs up in a hash table, merges in every row the leftmost pair of least rank, closes
the gap, and takes rows without a known pair out. Rows of over LONG bytes would need as many rounds as
bytes; they merge all places of that pair in one round, with the same lookup and the same result.
Texts are handled whole, row by row, so no shuffle is needed and memory is bounded by the batch and by
the cache of pre-tokens.

null text: as the empty text (no ids). null doc_id: stays null. Repeated rows: each is encoded.
Extra columns are not read and not returned. Empty tables give empty results.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinflow.llm.common import small_batches


NONE = np.int32(2**31 - 1)
#: Bytes up to which rows merge one pair a round; longer ones merge all places of their best pair.
LONG = 256
#: Cells of one matrix.
CELLS = 1 << 20
#: Pre-tokens that a Python worker keeps with their ids, and characters of these, in each of two generations.
CACHE, CACHE_CHARS = 300_000, 16 << 20


class WordCache(dict):
    """Ids of pre-tokens, as bytes. When a generation is full it becomes the old one; what is used again
    moves back to the young one, so frequent pre-tokens stay and memory is bounded, however many or
    long they are."""

    def __init__(self, most: int = CACHE, most_chars: int = CACHE_CHARS):
        self.most, self.most_chars, self.chars, self.old, self.new = most, most_chars, 0, {}, []

    def __missing__(self, word: str) -> bytes | None:
        known = self[word] = self.old.get(word)
        self.chars += len(word)
        if known is None:
            self.new.append(word)
        return known

    def coded(self, split: list[list[str]], encode: Callable[[list[str]], Iterable[bytes]]) -> list[bytes]:
        """Each text's ids, where encode gives those of new pre-tokens."""
        if len(self) > self.most or self.chars > self.most_chars:
            self.old = dict(self)
            self.clear()
            self.chars = 0
        words = list(chain.from_iterable(split))
        ids = list(map(self.__getitem__, words))  # None where a pre-token is new
        new, self.new = self.new, []
        try:
            self.update(zip(new, encode(new)))
        except BaseException:
            for word in new:
                self.pop(word, None)
            raise
        at = -1
        with suppress(ValueError):
            while True:
                at = ids.index(None, at + 1)
                ids[at] = self[words[at]]
        ends = list(accumulate(map(len, split)))
        return [b"".join(ids[i:j]) for i, j in zip([0, *ends], ends)]


class PairTable:
    """Open-addressing hash table from a pair of ids to the id of their concatenation."""

    EMPTY = np.uint64(2**64 - 1)

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        bits = max(8, int(4 * len(left)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, self.EMPTY), np.full(1 << bits, NONE, np.int32)
        key = self.key(left, right)
        slot, rest = self.slot(key), np.arange(len(key))
        while len(rest):
            free = rest[self.keys[slot[rest]] == self.EMPTY]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = key[put], merged[put]
            rest = rest[self.keys[slot[rest]] != key[rest]]
            slot[rest] = (slot[rest] + 1) & self.mask

    @staticmethod
    def key(left, right):
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    def slot(self, key):
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = self.key(left, right)
        slot = self.slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], NONE)
        rest = np.flatnonzero((found != key) & (found != self.EMPTY))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & self.mask
            found = self.keys[slot[rest]]
            hit = found == key[rest]
            out[rest[hit]] = self.values[slot[rest[hit]]]
            rest = rest[~hit & (found != self.EMPTY)]
        return out


@lru_cache(maxsize=4)
def split_patterns(pattern: str):
    """The pattern for any text; for texts of the first 65,536 characters and for ASCII ones, the known
    pattern with its classes written out, in Python's re, which is faster (the letters' branch comes
    first: no other one can begin like it); and what finds other characters. Other patterns: only the
    first."""
    import regex

    slow = regex.compile(pattern)
    known = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    if pattern != known:
        return slow, None, None, None

    def faster(last: int):
        text = "".join(map(chr, range(last + 1)))
        letter, number, space = ("".join(map(spans, regex.findall(c, text))) for c in (r"\p{L}+", r"\p{N}+", r"\s+"))
        return re.compile(f" ?[{letter}]+| ?[{number}]+|'(?:[stmd]|re|ve|ll)| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")

    def spans(run: str) -> str:
        """A run of characters that follow each other, as a range of a class."""
        return f"{re.escape(run[0])}-{re.escape(run[-1])}"

    return slow, faster(0xFFFF), faster(0x7F), re.compile("[\U00010000-\U0010ffff]")


def pre_tokens(text: str, pattern: str) -> list[str]:
    slow, usual, plain, other = split_patterns(pattern)
    if usual is None or not text.isascii() and other.search(text):
        return slow.findall(text)
    return (plain if text.isascii() else usual).findall(text)


class ByteBPE:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(self.ranks[t[:k]], self.ranks[t[k:]], i) for t, i in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        self.pairs = PairTable(*np.array(pairs, np.int32).reshape(-1, 3).T)
        self.cache = WordCache()

    def matrix(self, words: list[bytes], out: list, where: np.ndarray, width: int) -> None:
        """Encode the words (each of 1 to width bytes) into out[where]."""
        lengths = np.array([len(w) for w in words])
        a = np.full((len(words), width), -1, np.int32)
        a[np.arange(width) < lengths[:, None]] = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        rank = np.full((len(words), max(width - 1, 1)), NONE, np.int32)
        if width > 1:
            known = a[:, 1:] >= 0
            rank[known] = self.pairs.get(a[:, :-1][known], a[:, 1:][known])
        while len(a):
            best = rank.argmin(1)
            rows = np.arange(len(a))
            low = rank[rows, best]
            done = low == NONE
            for i in np.flatnonzero(done):
                out[where[i]] = a[i, : lengths[i]].copy()
            go = ~done
            if not go.any():
                return
            a, rank, where, lengths, best, low = a[go], rank[go], where[go], lengths[go] - 1, best[go], low[go]
            rows = np.arange(len(a))
            a[rows, best] = low
            keep = np.ones(a.shape, bool)
            keep[rows, best + 1] = False
            a = a[keep].reshape(len(a), -1)
            if a.shape[1] == 1:
                rank = np.full((len(a), 1), NONE, np.int32)
                continue
            keep = np.ones(rank.shape, bool)
            keep[rows, best] = False
            rank = rank[keep].reshape(len(a), -1)
            for at in (best - 1, best):
                fix = np.flatnonzero((at >= 0) & (at < rank.shape[1]))
                at = at[fix]
                right = a[fix, at + 1]
                rank[fix, at] = np.where(right >= 0, self.pairs.get(a[fix, at], np.maximum(right, 0)), NONE)

    def long_row(self, word: bytes) -> np.ndarray:
        """One long row. All places of its pair of least rank merge in a round, from the left. That is
        the same as one after another as long as no merge makes a pair of a lower rank, with what stands
        around it then; if one would, only the leftmost place merges."""
        a = self.byte[np.frombuffer(word, np.uint8)]
        rank = self.pairs.get(a[:-1], a[1:])
        while len(rank) and (low := rank.min()) != NONE:
            at = np.flatnonzero(rank == low)
            if len(at) > 1:  # of places that overlap, every other one from the left
                run = np.concatenate([[0], np.flatnonzero(np.diff(at) > 1) + 1])
                at = at[(np.arange(len(at)) - np.repeat(run, np.diff([*run, len(at)]))) % 2 == 0]
            if len(at) > 1:
                behind, before = at[at + 2 < len(a)] + 2, at[at > 0]
                first = np.where(np.isin(before - 2, at), low, a[before - 1])
                if min(self.pairs.get(np.full(len(behind), low), a[behind]).min(initial=NONE), self.pairs.get(first, np.full(len(before), low)).min(initial=NONE)) < low:
                    at = at[:1]
            a, rank = self.merged(a, rank, at, low)
        return a

    def merged(self, a: np.ndarray, rank: np.ndarray, at: np.ndarray, low: np.int32) -> tuple[np.ndarray, np.ndarray]:
        """The row and its ranks after the pairs at these places have become `low`."""
        new = a.copy()
        new[at] = low
        keep = np.ones(len(a), bool)
        keep[at + 1] = False
        new = new[keep]
        kept = rank[keep[1:]] if len(new) > 1 else rank[:0]
        where = at - np.arange(len(at))  # places of the new ids
        for k in (where - 1, where):
            k = k[(k >= 0) & (k < len(new) - 1)]
            kept[k] = self.pairs.get(new[k], new[k + 1])
        return new, kept

    def words(self, words: Iterable[str]) -> list[np.ndarray]:
        coded = [w.encode("utf-8", "surrogatepass") for w in words]
        out: list = [None] * len(coded)
        lengths = np.array([len(w) for w in coded], np.int64)
        for i in np.flatnonzero(lengths > LONG):
            out[i] = self.long_row(coded[i])
        edges = [0, 1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 24, 32, 64, 128, LONG]
        for low, high in zip(edges, edges[1:]):
            rows = np.flatnonzero((lengths > low) & (lengths <= high))
            step = max(1, CELLS // high)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                self.matrix([coded[i] for i in part], out, part, high)
        return out

    def encode_batch(self, texts: Iterable[str | None], pattern: str) -> Iterator[np.ndarray]:
        split = [pre_tokens(t or "", pattern) for t in texts]
        for ids in self.cache.coded(split, lambda new: (x.tobytes() for x in self.words(new))):
            yield np.frombuffer(ids, np.int32)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def loaded(path: str) -> ByteBPE:
    return ByteBPE(path)


def text_slices(texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, list]]:
    """Runs of rows of at most so many characters (one row at least)."""
    out, size, at = [], 0, 0
    for i, t in enumerate(texts):
        t = t.as_py()
        if out and size + len(t or "") > most:
            yield at, out
            out, size, at = [], 0, i
        out.append(t)
        size += len(t or "")
    if out:
        yield at, out


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text: columns doc_id and ids (array of int), without special tokens."""
    small_batches(docs.sparkSession)

    def run(batches):
        model = loaded(path)
        for batch in batches:
            for at, texts in text_slices(batch.column(1)):
                ids = list(model.encode_batch(texts, pattern))
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                values = pa.array(np.concatenate(ids).astype(np.int32, copy=False))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """The bytes of every row's ids: columns doc_id, ids and decoded (binary). An id outside the
    vocabulary raises KeyError; null ids decode to no bytes."""
    small_batches(coded.sparkSession)

    def run(batches):
        model = loaded(path)
        for batch in batches:
            ids = batch.column(1)
            out = [model.decode(x.values.to_pylist()) if x.is_valid else b"" for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """Counts and hashes of decode()'s rows, by Spark's own functions."""
    return decoded.select(
        "doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
