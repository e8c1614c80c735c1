"""Alignment of two tokenizers' tokens of the same text, and how often their ids meet in a corpus.

Both tokenizers give every text a list of byte offsets at which tokens end. The shorter list drives an
exponential, then binary search into the longer one, starting where the last search ended. What it finds
gives all else: offsets in both lists cut the tokens into groups, and the ranks on both sides of a
token are the range of the other side's tokens that it overlaps. Groups and ranges are rows of arrays; the
counts of id pairs are grouped by Spark.

Both tokenizers end a token in front of a space or line end that follows another character than white
space, whatever stands around, so no group and no range reaches across. Texts are cut there. A task aligns
each distinct part once, many new ones laid end to end as one text, and keeps what it found; a text's
rows are those of its parts in order. Models or patterns that do not end tokens there get each text as one part.

null and empty texts, and texts whose tokens' bytes are not a space and the text (which the second tokenizer
cannot write), have no tokens. Rows count for themselves: a repeated row is counted again, a null doc_id
stays null. Extra columns are neither read nor returned. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinflow.llm.bpe import split_patterns, text_slices
from basinflow.llm.common import cut, new_folder, small_batches

#: A pair of ids in this share of all rows or more is looked up in a broadcast table. There are at most so
#: many such pairs (about 50 MB), and no other pair is frequent enough to fill a task.
HOT_PAIRS = 1_000_000
#: Distinct parts of texts that a task keeps with their alignment, and their characters; when there are more, those
#: not used again are forgotten. Characters of the texts that it aligns together.
KEPT, KEPT_CHARS, SLICE = 500_000, 16 << 20, 1 << 18
#: Parts that are encoded and aligned as one text.
JOINED = 4000
SIDES = ("a_ids", "b_ids", "a_sizes", "b_sizes", "first", "last")
ALIGNED = "doc_id long, " + ", ".join(f"{c} array<int>" for c in SIDES)
COUNTED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<struct<pair: long, n: int>>"


def byte_of_char() -> dict[str, int]:
    """Bytes behind the characters of a byte-level vocabulary: printable ones of Latin-1 stand for
    themselves, the others for the code points from 256, in their order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteTokens:
    """Ids of a byte-level tokenizer, and the bytes of each; literals of special tokens are plain text."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        byte, tokens = byte_of_char(), self.model.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            self.bytes[i] = bytes(map(byte.__getitem__, token))
        self.length = np.array([len(x) for x in self.bytes], np.int64)
        #: Whether tokens end in front of white space behind other characters.
        self.cuts = split_patterns(pattern)[1] is not None

    def ids(self, text: str) -> list[int]:
        return self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids


class PieceTokens:
    """Ids of a sentencepiece model, and the bytes of each."""

    MARK = "▁"

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [self.piece_bytes(p) for p in pieces]
        self.length = np.array([len(x) for x in self.bytes], np.int64)
        #: Whether tokens end in front of every run of spaces, and of every line end: no piece has one behind
        #: another character.
        self.cuts = not any(self.MARK in p.lstrip(self.MARK) for p in pieces) and self.model.encode(" a  b ", out_type=str) == self.model.encode(" a", out_type=str) + self.model.encode(" b", out_type=str) + [self.MARK]
        self.cuts_lines = not any("\n" in p[1:] for p in pieces)

    def piece_bytes(self, piece: str) -> bytes:
        if re.fullmatch("<0x[0-9A-F]{2}>", piece):
            return bytes([int(piece[3:5], 16)])
        return piece.replace(self.MARK, " ").encode()

    def ids(self, text: str) -> list[int]:
        """Ids of a text that begins with the space that the model puts in front."""
        return self.model.encode(text[1:])


def gallop(short: list[int], long: list[int]) -> list[int]:
    """For each of the ascending values of short: how many values of long (ascending) are smaller."""
    out, at, n, long = [], 0, len(long), [*long, math.inf]
    for e in short:
        if long[at] < e:
            if long[at + 1] >= e:
                at += 1
            else:
                step = 2
                while at + step < n and long[at + step] < e:
                    step <<= 1
                at = bisect_left(long, e, at + (step >> 1) + 1, min(at + step, n))
        out.append(at)
    return out


def matched(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From the ends of A's and B's tokens (with the same last end): tokens of A and of B in each group, and
    the first and last token of B that each token of A overlaps."""
    if len(a) > len(b):
        b_sizes, a_sizes, low, high = matched(b, a)
        at = np.arange(len(a))
        return a_sizes, b_sizes, np.searchsorted(high, at, "left"), np.searchsorted(low, at, "right") - 1
    if not len(a):
        return (np.zeros(0, np.int64),) * 4
    rank = np.array(gallop(a.tolist(), b.tolist()))
    common = b[rank] == a
    ends = np.flatnonzero(common)
    first = np.concatenate([[0], (rank + common)[:-1]])
    return np.diff(ends, prepend=-1), np.diff(rank[ends], prepend=-1), first, rank


class Rows:
    """Rows of numbers, one list or several of the same length in each, appended at the end."""

    def __init__(self, lists: int):
        self.values, self.ends, self.n = np.zeros((lists, 1 << 12), np.int32), np.zeros(1 << 12, np.int64), 0

    def append(self, sizes: np.ndarray, *values: np.ndarray) -> None:
        at, n = self.ends[self.n], len(values[0])
        if at + n > self.values.shape[1]:
            self.values = np.concatenate([self.values, np.zeros((len(values), at + n), np.int32)], 1)
        if self.n + len(sizes) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(self.n + len(sizes), np.int64)])
        self.values[:, at : at + n] = values
        self.ends[self.n + 1 : self.n + len(sizes) + 1] = at + np.cumsum(sizes)
        self.n += len(sizes)

    def sizes(self, rows: np.ndarray) -> np.ndarray:
        return self.ends[rows + 1] - self.ends[rows]

    def take(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return np.take(self.values, ranges(self.ends[rows], sizes), 1)

    def only(self, rows: np.ndarray) -> Rows:
        out, sizes = Rows(len(self.values)), self.sizes(rows)
        out.append(sizes, *self.take(rows, sizes))
        return out


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, as many as its size."""
    before = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(starts - before, sizes)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the values between bounds that follow each other."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[bounds])


class Aligner(dict):
    """Numbers of the parts that are known; their rows are in by_a (ids of A, first and last), by_b (ids of
    B) and by_group (sizes in A and B). Parts that their tokens do not spell have no tokens."""

    def __init__(self, a_path: str, pattern: str, b_path: str):
        self.a, self.b = ByteTokens(a_path, pattern), PieceTokens(b_path)
        self.whole = not (self.a.cuts and self.b.cuts)
        #: What begins the text of new parts, so that each part stands behind a character.
        self.front = "" if self.whole else " a"
        line = "\\n" if self.b.cuts_lines else ""
        self.parts = re.compile(".+" if self.whole else rf"\s++\S*+(?:[^\S {line}]\s*+\S*+)*+", re.DOTALL)
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new, self.chars, self.uses, self.by_a, self.by_b, self.by_group = [], 0, np.zeros(0, np.int64), Rows(3), Rows(1), Rows(2)

    def trim(self) -> None:
        """Forget parts that were not used again since the last time; all, if that leaves more than half."""
        again, parts = np.flatnonzero(self.uses > 1), list(self)
        kept = [parts[i] for i in again.tolist()]
        rows, chars = (self.by_a, self.by_b, self.by_group), sum(map(len, kept))
        self.forget()
        if len(kept) <= KEPT // 2 and chars <= KEPT_CHARS // 2:
            self.update(zip(kept, range(len(kept))))
            self.chars, self.uses = chars, np.ones(len(kept), np.int64)
            self.by_a, self.by_b, self.by_group = (r.only(again) for r in rows)

    def __missing__(self, part: str) -> int:
        n = self[part] = len(self)
        self.new.append(part)
        return n

    def numbers(self, parts: list[str]) -> np.ndarray:
        try:
            if len(self) > KEPT or self.chars > KEPT_CHARS:
                self.trim()
            found = np.fromiter(map(self.__getitem__, parts), np.int64, len(parts))
            new, self.new, at = self.new, [], 0
            for k, part in enumerate(new, 1):
                # Behind white space at its end, a part would not be cut from the next one.
                if self.whole or part[-1].isspace() or k - at == JOINED or k == len(new):
                    self.learn(new[at:k])
                    at = k
            self.chars += sum(map(len, new))
            self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
            np.add.at(self.uses, found, 1)
        except BaseException:
            self.forget()
            raise
        return found

    def learn(self, parts: list[str]) -> None:
        """Encode and align parts as one text. If its tokens do not spell it, halves of it are tried."""
        text = self.front + "".join(parts)
        sides, ends = [], np.cumsum([len(self.front), *(len(p) if p.isascii() else len(p.encode()) for p in parts)])
        for side in (self.a, self.b):
            ids = side.ids(text)
            good = b"".join(map(side.bytes.__getitem__, ids)) == text.encode()
            ids = np.array(ids, np.int32)
            reach = np.cumsum(side.length[ids])
            cuts = np.searchsorted(reach, ends[1:] if self.whole else ends) if good else None
            if not good or (reach[cuts] != ends[-len(cuts) :]).any():
                if len(parts) > 1:
                    self.learn(parts[: len(parts) // 2])
                    self.learn(parts[len(parts) // 2 :])
                else:
                    for rows in (self.by_a, self.by_b, self.by_group):
                        rows.append(np.zeros(1, np.int64), *rows.values[:, :0])
                return
            sides.append((ids, reach, np.concatenate([[0], cuts + 1]) if self.whole else cuts + 1))
        (a_ids, a_reach, a_cuts), (b_ids, b_reach, b_cuts) = sides
        a_sizes, b_sizes, first, last = matched(a_reach, b_reach)
        groups = np.searchsorted(a_reach[np.cumsum(a_sizes) - 1], ends, "right")
        a, b, g = slice(a_cuts[0], None), slice(b_cuts[0], None), slice(groups[0], None)
        n = np.diff(a_cuts)
        start = np.repeat(b_cuts[:-1], n)
        self.by_a.append(n, a_ids[a], first[a] - start, last[a] - start)
        self.by_b.append(np.diff(b_cuts), b_ids[b])
        self.by_group.append(np.diff(groups), a_sizes[g], b_sizes[g])

    def batch(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The arrays of SIDES, each of all texts end to end, with the bounds of each text."""
        split = [self.parts.findall(" " + t) if t else [] for t in texts]
        rows, bounds = self.numbers(list(chain.from_iterable(split))), np.cumsum([0, *map(len, split)])
        n = self.by_a.sizes(rows)
        if len(n) and not n.all():
            good = np.repeat(sums(n == 0, bounds) == 0, np.diff(bounds))
            bounds = np.concatenate([[0], np.cumsum(good)])[bounds]
            rows, n = rows[good], n[good]
        n_b, n_groups = self.by_b.sizes(rows), self.by_group.sizes(rows)
        a_ends, b_ends, group_ends = (np.concatenate([[0], np.cumsum(x)])[bounds] for x in (n, n_b, n_groups))
        start = np.cumsum(n_b) - n_b
        start -= np.repeat(b_ends[:-1], np.diff(bounds))
        (a_ids, first, last), (b_ids,), (a_sizes, b_sizes) = self.by_a.take(rows, n), self.by_b.take(rows, n_b), self.by_group.take(rows, n_groups)
        start = np.repeat(start, n)
        return [(a_ids, a_ends), (b_ids, b_ends), (a_sizes, group_ends), (b_sizes, group_ends), (first + start, a_ends), (last + start, a_ends)]


@lru_cache(maxsize=2)
def aligner(a_path: str, pattern: str, b_path: str) -> Aligner:
    return Aligner(a_path, pattern, b_path)


def lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int32, copy=False)))


def align(docs: DataFrame, a_path: str, pattern: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's tokens of both tokenizers and how they lie to each other: doc_id, a_ids, b_ids;
    a_sizes and b_sizes, the tokens of each group; first and last, per token of A the places (from 0) of the
    first and last token of B that it overlaps."""
    small_batches(docs.sparkSession)
    return texts_of(docs, id_col, text_col).mapInArrow(aligned_batches(a_path, pattern, b_path), ALIGNED)


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def aligned_batches(a_path: str, pattern: str, b_path: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        model = aligner(a_path, pattern, b_path)
        for batch in batches:
            for at, texts in text_slices(batch.column(1), SLICE):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *(lists(*side) for side in model.batch(texts))], names=["doc_id", *SIDES])

    return run


def overlaps(a_ids: np.ndarray, b_ids: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of both ends of every link."""
    n = last - first + 1
    return np.repeat(a_ids, n), b_ids[ranges(first, n)]


class GroupText:
    """Groups as text: `a1,a2|b1;a3|b2,b3;`."""

    def __init__(self):
        self.parts: list[str] = []

    def pieces(self, a_ids, b_ids, a_sizes, b_sizes) -> list[str]:
        """The text of all groups, in one piece for each token."""
        known = len(self.parts) // 3
        for i in range(known, int(max(a_ids.max(initial=-1), b_ids.max(initial=-1))) + 1):
            self.parts += (f"{i},", f"{i}|", f"{i};")
        a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
        code = np.empty(len(a_ids) + len(b_ids), np.int64)
        a, b = a_ids.astype(np.int64) * 3, b_ids.astype(np.int64) * 3
        a[a_ends - 1] += 1
        b[b_ends - 1] += 2
        code[np.arange(len(a)) + np.repeat(b_ends - b_sizes, a_sizes)] = a
        code[np.arange(len(b)) + np.repeat(a_ends, b_sizes)] = b
        return list(map(self.parts.__getitem__, code.tolist()))


def counted_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts = GroupText()
    for batch in batches:
        (a_ids, a_ends), (b_ids, b_ends), (a_sizes, group_ends), (b_sizes, _), (first, _), (last, _) = ((c.flatten().to_numpy(), c.offsets.to_numpy() - c.offsets[0].as_py()) for c in batch.columns[1:])
        start = np.repeat(b_ends[:-1], np.diff(a_ends))
        a, b = overlaps(a_ids, b_ids, first + start, last + start)
        links, ends = sums(last - first + 1, a_ends), a_ends + b_ends
        pair, pieces = a.astype(np.int64) << 32 | b, texts.pieces(a_ids, b_ids, a_sizes, b_sizes)
        found = [np.unique(x, return_counts=True) for x in np.split(pair, np.cumsum(links)[:-1])] if batch.num_rows else []
        hashes = [hashlib.sha256("".join(pieces[i:j])[:-1].encode()).hexdigest() if i < j else "" for i, j in zip(ends.tolist(), ends[1:].tolist())]
        pairs, counts = (np.concatenate([pair[:0], *(x[k] for x in found)]) for k in (0, 1))
        sizes = [pa.array(np.diff(x).astype(np.int64)) for x in (a_ends, b_ends, group_ends)]
        offsets = np.cumsum([0, *(len(x[0]) for x in found)]).astype(np.int32)
        each = pa.StructArray.from_arrays([pa.array(pairs), pa.array(counts.astype(np.int32))], names=["pair", "n"])
        yield pa.RecordBatch.from_arrays([batch.column(0), *sizes, pa.array(links.astype(np.int64)), pa.array(hashes, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), each)], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])


def counted(aligned: DataFrame) -> DataFrame:
    """Of the rows of align(): numbers of tokens, groups and links, the hash of the groups' text (empty
    without tokens), and the document's distinct linked pairs of ids (A's id times 2 ** 32 and B's) with
    their number of links."""
    small_batches(aligned.sparkSession)
    return aligned.select("doc_id", *SIDES).mapInArrow(counted_batches, COUNTED)


def align_counted(docs: DataFrame, a_path: str, pattern: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """counted(align()), where the rows of the one go to the other inside the task."""
    small_batches(docs.sparkSession)
    align_batches = aligned_batches(a_path, pattern, b_path)
    return texts_of(docs, id_col, text_col).mapInArrow(lambda batches: counted_batches(align_batches(batches)), COUNTED)


def b_of(pair: Column) -> Column:
    return pair.bitwiseAND(F.lit(0xFFFFFFFF))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """Of rows (pair, n): pair, rows, count (its links in the whole corpus) and best (no other pair with
    its id of B has more)."""
    counts = cut(pairs.groupBy("pair").agg(F.count("*").alias("rows"), F.sum("n").cast("long").alias("count")))
    top = counts.groupBy(b_of(F.col("pair")).alias("b")).agg(F.max("count").alias("top"))
    return cut(counts.withColumn("b", b_of(F.col("pair"))).join(top, "b").select("pair", "rows", "count", (F.col("count") == F.col("top")).alias("best")))


def scored(counts: DataFrame) -> DataFrame:
    """The rows of counted() with n_best (links whose pair is the most frequent of its id of B in the
    corpus, ties included) and count_sum (the sum over its links of their pairs' numbers of links).

    Frequent pairs are looked up in a broadcast table of at most HOT_PAIRS rows, the others, each in few
    rows, by a shuffle."""
    spark, folder = counts.sparkSession, new_folder(counts.sparkSession, "alignment")
    counts.withColumn("_row", F.monotonically_increasing_id()).write.parquet(folder)
    docs = spark.read.parquet(folder)
    pairs = docs.select("_row", F.inline("pairs"))
    known = pair_counts(pairs)
    total = known.agg(F.sum("rows")).first()[0] or 0
    often = F.col("rows") * F.lit(HOT_PAIRS) >= F.lit(total)
    hot, rest = F.broadcast(known.where(often)), known.where(~often)
    met = pairs.join(hot, "pair").unionByName(pairs.join(hot.select("pair"), "pair", "left_anti").join(rest, "pair"))
    sums = met.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return docs.join(sums, "_row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", none("n_best"), none("count_sum"), "groups_sha256")
