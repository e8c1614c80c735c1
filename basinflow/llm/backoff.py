"""Scoring by an n-gram model in the form of a weighted backoff automaton.

Texts are cut into blocks, each with a dictionary of its own. A block's distinct n-grams, as 64-bit keys with
their counts, are dealt by key into parts of bounded size, added up there over all blocks, and each block gets
back the totals of its own n-grams, in their order. With these a task builds the part of the automaton that its
block can reach: a state for each known context, an arc for each known n-gram with its smoothed log
probability, and a failure arc from each context to the one without its first word, with the log of the
mass left for it. One traversal per text from left to right carries the state and adds up.

Smoothing: p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)), which leaves the mass of one more word for all unknown
ones, and p(w | h) = (c(hw) + prior p(w | h')) / (c(h) + prior), where h' is h without its first word. So all
probabilities after a context add up to 1. Tokens: words of [^\\x20\\x09-\\x0D]+ with A-Z in lower case, then one
end; the context of the first one is a begin mark.

null texts are empty ones (a single end); a null doc_id is the empty text where it decides about training, and
stays null. Rows count for themselves: repeated rows are learned from and scored as often as they stand there.
Extra columns are neither read nor returned. Without a text to learn from, every token has probability 1.
Words and n-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinflow.llm.common import new_folder, small_batches

#: Bytes of the texts of a block (one text at least), and n-grams of a part on average.
BLOCK_BYTES, PART_KEYS = 3 << 20, 2_000_000
BLOCKS = "doc_ids array<long>, held_out array<boolean>, lengths array<int>, words binary, codes binary"
PIECES = "part long, block long, n_words long, keys binary, counts binary"
TOTALS = "block long, part long, totals binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 in the fewest bytes each (the first byte says how many), compressed."""
    import zstandard

    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(numbers.max(initial=0)) < 1 << 8 * w)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(numbers.astype(f"<u{width}").tobytes())


def unpacked(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), f"<u{data[0]}").astype(np.int64)


def tokenized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of documents: their identifiers and numbers of words, the hashes of the block's distinct words,
    and all words as places in that list."""
    import xxhash

    small_batches(docs.sparkSession)

    def block(ids: list, split: list[list[bytes]]) -> pa.RecordBatch:
        words = pa.array(chain.from_iterable(split), pa.binary()).dictionary_encode()
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in words.dictionary.to_pylist()], np.uint64)
        return pa.RecordBatch.from_pydict({
            "doc_ids": pa.array([ids], pa.list_(pa.int64())), "held_out": pa.array([list(map(is_held_out, ids))], pa.list_(pa.bool_())), "lengths": pa.array([list(map(len, split))], pa.list_(pa.int32())),
            "words": pa.array([hashes.tobytes()], pa.binary()), "codes": pa.array([packed(words.indices.to_numpy())], pa.binary()),
        })

    def run(batches):
        ids, split, size = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = (text.as_py() or "").encode()
                if ids and size + len(text) > block_bytes:
                    yield block(ids, split)
                    ids, split, size = [], [], 0
                ids.append(i)
                split.append(text.lower().split())
                size += len(text)
        if ids:
            yield block(ids, split)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, BLOCKS)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Grams:
    """The n-grams of a block, by order from 1: of each distinct one its key, its last word, the n-gram
    before that (both of one order less), the n-gram without its first word, and its count in the texts to
    learn from; and which n-gram ends at each place of the block's sequence."""

    def __init__(self, lengths: Iterable[int], held: Iterable[bool], words: bytes, codes: bytes, order: int):
        import xxhash

        lengths, hashes = np.asarray(lengths, np.int64), np.frombuffer(words, np.uint64)
        self.end, self.begin, self.width = len(hashes), len(hashes) + 1, len(hashes) + 2
        hashes = np.concatenate([hashes, np.array([xxhash.xxh64_intdigest(b"\n"), xxhash.xxh64_intdigest(b"\t")], np.uint64)])
        size = lengths + 2
        self.ends = np.cumsum(size) - 1
        self.starts = self.ends - size + 1
        self.sequence = np.full(size.sum(), -1, np.int64)
        self.sequence[self.ends], self.sequence[self.starts] = self.end, self.begin
        self.sequence[self.sequence < 0] = unpacked(codes)
        depth = np.arange(len(self.sequence)) - np.repeat(self.starts, size)
        learn = np.repeat(~np.asarray(held, bool), size)
        self.at, self.keys, self.last, self.before, self.rest = [self.sequence], [mixed(hashes)], [np.arange(self.width)], [None], [None]
        self.counts = [np.bincount(self.sequence[learn], minlength=self.width)]
        for k in range(1, order):
            where = np.flatnonzero(depth >= k)
            pair = self.at[-1][where - 1] * self.width + self.sequence[where]
            distinct, first, ids = np.unique(pair, return_index=True, return_inverse=True)
            before, last = distinct // self.width, distinct % self.width
            at = np.full(len(self.sequence), -1, np.int64)
            at[where] = ids
            self.before.append(before)
            self.last.append(last)
            self.rest.append(self.at[-1][where[first]])
            self.keys.append(mixed(self.keys[-1][before] * np.uint64(0x9E3779B97F4A7C15) + hashes[last]))
            self.counts.append(np.bincount(ids[learn[where]], minlength=len(distinct)))
            self.at.append(at)

    def dealt(self, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All keys, the order that sorts them by part (words before the begin mark and longer n-grams), and
        where each part begins in it."""
        keys = np.concatenate(self.keys)
        part = (keys % np.uint64(parts)).astype(np.int64)
        by_part = np.argsort(part, kind="stable")
        return keys, by_part, np.searchsorted(part[by_part], np.arange(parts + 1))


def pieces(blocks: DataFrame, order: int, parts: int) -> DataFrame:
    """A row for each block and part that share n-grams: keys and counts, words (with the end) first."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                grams = Grams(row["lengths"], row["held_out"], row["words"], row["codes"], order)
                keys, by_part, starts = grams.dealt(parts)
                counts = np.concatenate(grams.counts).astype(np.int64)[by_part]
                keys, is_word = keys[by_part], np.concatenate([[0], np.cumsum(by_part <= grams.end)])
                rows = [(p, row["block"], int(is_word[j] - is_word[i]), keys[i:j].tobytes(), packed(counts[i:j])) for p, (i, j) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())) if i < j]
                for k in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[k : k + 1000])], names=["part", "block", "n_words", "keys", "counts"])

    return blocks.select("block", "held_out", "lengths", "words", "codes").mapInArrow(run, PIECES)


def part_totals(rows: pd.DataFrame) -> pd.DataFrame:
    """Totals of one part's n-grams, for each block in its own order; in a row without a block: how many
    different words have been learned, and how many in all."""
    keys = np.frombuffer(b"".join(rows["keys"]), np.uint64)
    sizes = np.array([len(k) // 8 for k in rows["keys"]])
    distinct, ids = np.unique(keys, return_inverse=True)
    totals = np.bincount(ids, np.concatenate([unpacked(c) for c in rows["counts"]]), len(distinct)).astype(np.int64)
    ends = np.cumsum(sizes)
    place = np.arange(len(keys)) - np.repeat(ends - sizes, sizes)
    is_word = np.zeros(len(distinct), bool)
    is_word[ids[place < np.repeat(rows["n_words"].to_numpy(), sizes)]] = True
    learned = np.array([np.count_nonzero(totals[is_word]), totals[is_word].sum()], np.int64)
    own = [packed(totals[ids[e - n : e]]) for n, e in zip(sizes.tolist(), ends.tolist())]
    return pd.DataFrame({"block": pd.array([*rows["block"], None], "Int64"), "part": int(rows["part"].iloc[0]), "totals": [*own, learned.tobytes()]})


class Automaton:
    """The part of the model that a block can reach. States are numbered by order and n-gram, the last one
    is the root. arc[state * width + word] is the place of weight and goal; fail and back are the failure
    arcs."""

    def __init__(self, grams: Grams, totals: list[np.ndarray], n: int, v: int, prior: float):
        order, root = len(totals), sum(map(len, totals[:-1]))
        first = np.cumsum([0, *map(len, totals)])
        p = (totals[0] + 0.5) / (n + 0.5 * (v + 1))
        self.base = np.log10(p)
        state = lambda k, ids: np.where(totals[k][ids] > 0, first[k] + ids, root)
        words = np.arange(grams.width)
        keys, weights = [root * grams.width + words], [self.base]
        goals = [state(0, words) if order > 1 else np.full(grams.width, root)]
        fail, back = np.zeros(root + 1), np.full(root + 1, root)
        for k in range(1, order):
            before, last, rest, known = grams.before[k], grams.last[k], grams.rest[k], totals[k] > 0
            context = totals[k - 1]
            p = (totals[k] + prior * p[rest]) / (context[before] + prior)
            keys.append(((first[k - 1] + before) * grams.width + last)[known])
            weights.append(np.log10(p[known]))
            goals.append((first[k] + np.arange(len(known)) if k < order - 1 else state(k - 1, rest))[known])
            fail[first[k - 1] : first[k]] = np.log10(prior / (context + prior))
            if k > 1:
                back[first[k - 1] : first[k]] = state(k - 2, grams.rest[k - 1])
        self.width, self.fail, self.back = grams.width, fail.tolist(), back.tolist()
        self.arc = {key: i for i, key in enumerate(np.concatenate(keys).tolist())}
        self.weight, self.goal = array("d", np.concatenate(weights)), array("q", np.concatenate(goals).astype(np.int64))
        self.start = int(state(0, grams.begin)) if order > 1 else root

    def score(self, words: list[int]) -> float:
        """Log probability of the words, by one traversal."""
        state, out, arc, width = self.start, 0.0, self.arc, self.width
        for w in words:
            while (a := arc.get(state * width + w)) is None:
                out += self.fail[state]
                state = self.back[state]
            out += self.weight[a]
            state = self.goal[a]
        return out


def scored(blocks: DataFrame, n: int, v: int, order: int, parts: int, prior: float) -> DataFrame:
    """Scores of the documents of blocks with the column parted: each part's totals."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for row in batch.to_pylist():
                grams = Grams(row["lengths"], row["held_out"], row["words"], row["codes"], order)
                keys, by_part, _ = grams.dealt(parts)
                found = np.empty(len(keys), np.int64)
                found[by_part] = np.concatenate([unpacked(x["totals"]) for x in sorted(row["parted"], key=lambda x: x["part"])])
                totals = np.split(found, np.cumsum([len(k) for k in grams.keys])[:-1])
                model = Automaton(grams, totals, n, v, prior)
                known = np.concatenate([[0], np.cumsum(totals[0][grams.sequence] > 0)])
                bounds = list(zip((grams.starts + 1).tolist(), (grams.ends + 1).tolist()))
                spans = [grams.sequence[i:j] for i, j in bounds]
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()), pa.array(row["held_out"], pa.bool_()), pa.array([j - i for i, j in bounds], pa.int64()), pa.array([int(known[j] - known[i]) for i, j in bounds], pa.int64()),
                    pa.array([n] * len(spans), pa.int64()), pa.array([float(model.base[s].sum()) for s in spans], pa.float64()), pa.array([model.score(s.tolist()) for s in spans], pa.float64()),
                ], names=[x.split()[0] for x in SCORES.split(", ")])

    return blocks.mapInArrow(run, SCORES)


def score(docs: DataFrame, order: int = 2, prior: float = 500.0, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, part_keys: int = PART_KEYS) -> DataFrame:
    """Per document: held_out (not learned from), n_tokens, n_known (tokens that were learned), train_tokens
    (all that were learned from), base_score (by single tokens) and score (by the automaton), both in
    log10. order: words of the longest n-gram."""
    spark, folder = docs.sparkSession, new_folder(docs.sparkSession, "blocks")
    tokenized(docs, id_col, text_col, block_bytes).withColumn("block", F.monotonically_increasing_id()).write.parquet(f"{folder}/blocks")
    blocks = spark.read.parquet(f"{folder}/blocks")
    places = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda x, y: x + y + 2)
    size = blocks.agg(F.sum(places(F.col("lengths")))).first()[0] or 0
    parts = max(1, -(-size * order // part_keys))
    pieces(blocks, order, parts).groupBy("part").applyInPandas(part_totals, TOTALS).write.parquet(f"{folder}/totals")
    totals = spark.read.parquet(f"{folder}/totals")
    v, n = learned(totals)
    parted = totals.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("part", "totals")).alias("parted"))
    return scored(blocks.join(parted, "block"), n, v, order, parts, prior)


def learned(totals: DataFrame) -> tuple[int, int]:
    """Different words and all words learned from: sums over the parts."""
    own = totals.where("block is null")
    row = own.agg(F.sum(little(F.substring("totals", 1, 8))), F.sum(little(F.substring("totals", 9, 8)))).first()
    return row[0] or 0, row[1] or 0


def little(number: Column) -> Column:
    """An unsigned little-endian number of 8 bytes, below 2 ** 63, as a long."""
    digits = F.hex(number)
    return F.conv(F.concat(*(F.substring(digits, 15 - 2 * k, 2) for k in range(8))), 16, 10).cast("long")
