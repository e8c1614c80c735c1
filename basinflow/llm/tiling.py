"""Benchmark decontamination by greedy string tiling.

The benchmark's runs of MATCH words are hashed (Karp-Rabin) into a sorted seed table that is sent to
the tasks; documents stream past it, whole, and are never shuffled. A larger benchmark is taken in
blocks of bounded size, one after another: what a block finds is written, and its table is given up,
before the next one is built. A document's rolling hashes meet the seeds; equal runs are joined along
their diagonals to the longest matches, and per pair of document and item the longest match whose words
are all free is marked again and again, cut where others overlap it, until none of MATCH words is left.
Since matches may stand in any order, an item whose passages were moved around is still covered. A pair
counts if the marked words are at least `coverage` of the item's words.

Words are runs of letters, digits and underscores, lower case. An item shorter than MATCH words has
one seed of its own length. Items without words, null items and null texts match nothing; equal items
are each reported; null ids stay null; repeated rows are each reported. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinflow.llm.bpe import text_slices
from basinflow.llm.common import ROW, cut, small_batches, with_rows

#: Least words of a match, share of an item's words that must be covered, words of one seed table.
MATCH, COVERAGE, BLOCK_WORDS = 5, 0.7, 2_000_000
WORD = re.compile(r"\w+")
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
FILTER_BITS = 20
#: Meetings of a text's runs with seeds that are looked at together.
MEETINGS = 1 << 19


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of `width` numbers, modulo 2 ** 64."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * BASE + x[k : k + n]
    return out ^ (out >> np.uint64(29))


class Seeds:
    """The seed table of a block of items: hash of a run -> places (item, position)."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.vocabulary: dict[str, int] = {}
        self.items = []
        for item, text in items:
            words = words_of(text)
            if words:
                self.items.append((item, np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int64)))
        sizes = [len(w) for _, w in self.items]
        self.flat = np.concatenate([np.zeros(0, np.int64), *(w for _, w in self.items)])
        self.first = np.cumsum([0, *sizes])
        self.tables = {}
        widths = {min(MATCH, len(w)) for _, w in self.items}
        for width in widths:
            hashes, item, at = [], [], []
            for k, (_, w) in enumerate(self.items):
                if min(MATCH, len(w)) == width:
                    h = rolling(w, width)
                    hashes.append(h)
                    item.append(np.full(len(h), k))
                    at.append(np.arange(len(h)))
            hashes, item, at = map(np.concatenate, (hashes, item, at))
            order = np.argsort(hashes, kind="stable")
            sieve = np.zeros(1 << FILTER_BITS, bool)
            sieve[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.tables[width] = hashes[order], item[order], at[order], sieve

    def meet(self, text: str | None) -> Iterator[tuple[int, int, np.ndarray]]:
        """(item, width, runs) for every item that shares a run of words with the text; see joined()."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words_of(text)), np.int64)
        known = ids >= 0
        for width, (hashes, item, at, sieve) in self.tables.items():
            full = np.convolve(known, np.ones(width, np.int64), "valid") == width if len(ids) >= width else np.zeros(0, bool)
            if not full.any():
                continue
            h = rolling(ids, width)
            where = np.flatnonzero(full)
            where = where[sieve[(h[where] >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]]
            low = np.searchsorted(hashes, h[where], "left")
            n = np.searchsorted(hashes, h[where], "right") - low
            where, low, n = where[n > 0], low[n > 0], n[n > 0]
            parts = []
            for k in slabs(n, MEETINGS):
                p = np.repeat(where[k], n[k])
                s = np.arange(len(p)) - np.repeat(np.cumsum(n[k]) - n[k], n[k]) + np.repeat(low[k], n[k])
                i, q = item[s], at[s]
                same = np.ones(len(p), bool)
                for j in range(width):
                    same &= ids[p + j] == self.flat[self.first[i] + q + j]
                parts.append(joined(np.stack([i, p, q, np.full(len(p), width)], 1)[same]))
            found = joined(np.concatenate(parts)) if parts else np.zeros((0, 4), np.int64)
            edges = np.flatnonzero(np.diff(found[:, 0], prepend=-1, append=-1))
            for a, b in zip(edges, edges[1:]):
                yield int(found[a, 0]), width, found[a:b, 1:]


def slabs(n: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of which each holds about so many meetings."""
    cuts = np.flatnonzero(np.diff(np.cumsum(n) // most)) + 1 if len(n) else []
    for a, b in zip([0, *cuts], [*cuts, len(n)]):
        if b > a:
            yield slice(a, b)


def joined(runs: np.ndarray) -> np.ndarray:
    """Rows (item, place in text, place in item, words), where rows that touch on one diagonal of one item
    have become one, in the order of items, diagonals and places."""
    order = np.lexsort((runs[:, 2], runs[:, 1] - runs[:, 2], runs[:, 0]))
    runs = runs[order]
    end = runs[:, 2] + runs[:, 3]
    group = np.flatnonzero((np.diff(runs[:, 0], prepend=-1) != 0) | (np.diff(runs[:, 1] - runs[:, 2], prepend=np.iinfo(np.int64).min // 4) != 0))
    # Largest end so far on the same diagonal: ends are shifted by a step for each group.
    step = np.zeros(len(runs), np.int64)
    step[group] = 1
    shift = np.cumsum(step) * (int(end.max()) + 1 if len(end) else 1)
    reach = np.maximum.accumulate(end + shift) - shift if len(end) else end
    new = (step > 0) | (runs[:, 2] > np.concatenate([[0], reach[:-1]])[: len(runs)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(runs)) - 1
    return np.column_stack([runs[first, :3], reach[last] - runs[first, 2]]) if len(runs) else runs


def tiles(runs: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of one pair: longest free match first (earliest in the item, then in the text,
    on ties), no word of either side marked twice, none of fewer than `width` words. runs: rows (place in
    text, place in item, words). Gives such rows."""
    heap = [(-n, q, p) for p, q, n in runs.tolist()]
    heapify(heap)
    in_text, in_item = (np.zeros(int((runs[:, i] + runs[:, 2]).max()), bool) for i in (0, 1))
    out, left = [], len(in_item)
    while heap and left >= width:
        n, q, p = heappop(heap)
        taken = in_text[p : p - n] | in_item[q : q - n]
        if not taken.any():
            out.append((p, q, -n))
            in_text[p : p - n] = in_item[q : q - n] = True
            left += n
            continue
        edges = np.flatnonzero(np.diff(taken, prepend=True, append=True)).tolist()
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a >= width:
                heappush(heap, (a - b, q + a, p + a))
    return sorted(out)


def covered(text: str | None, seeds: Seeds, coverage: float) -> Iterator[tuple[int | None, int, int, float]]:
    """(item, words covered, tiles, share) of every item that the text covers enough."""
    for k, width, runs in sorted(seeds.meet(text), key=lambda x: x[0]):
        item, words = seeds.items[k]
        change = np.bincount(runs[:, 1], minlength=len(words) + 1) - np.bincount(runs[:, 1] + runs[:, 2], minlength=len(words) + 1)
        if np.count_nonzero(np.cumsum(change)) < coverage * len(words):
            continue  # more than these words cannot be covered
        found = tiles(runs, width)
        n = sum(w for _, _, w in found)
        if n >= coverage * len(words):
            yield item, n, len(found), n / len(words)


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The benchmark in blocks of at most BLOCK_WORDS words (one item at least)."""
    out, size = [], 0
    for r in benchmark.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).toLocalIterator():
        n = len(words_of(r[1]))
        if out and size + n > BLOCK_WORDS:
            yield out
            out, size = [], 0
        out.append((r[0], r[1]))
        size += n
    yield out


def contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and item that it covers: doc_id, item_id, words, tiles, coverage."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, words int, tiles int, coverage double"
    done, table = None, None
    for block in blocks(benchmark, item_col, item_text_col):
        if table is not None:  # a further block: the rows of the one before are written, its table goes
            done = cut(part if done is None else done.unionByName(part))
            table.destroy()
        table = spark.sparkContext.broadcast(Seeds(block))

        def run(batches, table=table):
            for batch in batches:
                for at, texts in text_slices(batch.column(1)):
                    ids = batch.column(0).slice(at, len(texts)).to_pylist()
                    found = [(d, *x) for d, t in zip(ids, texts) for x in covered(t, table.value, coverage)]
                    columns = list(zip(*found)) or [()] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()))], names=["doc_id", "item_id", "words", "tiles", "coverage"])

        part = rows.mapInArrow(run, schema)
    return part if done is None else done.unionByName(part)


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that cover no item of the benchmark enough."""
    small_batches(docs.sparkSession)
    every = blocks(benchmark, item_col, item_text_col)
    first, more = next(every), next(every, None)
    if more is not None:
        rows = with_rows(docs, text_col=text_col)
        lost = contamination(rows, benchmark, coverage, ROW, text_col, item_col, item_text_col)
        return rows.join(lost.select(F.col("doc_id").alias(ROW)).distinct(), ROW, "left_anti").select(docs.columns)
    table = docs.sparkSession.sparkContext.broadcast(Seeds(first))

    @F.pandas_udf("boolean")
    def free(texts: pd.Series) -> pd.Series:
        return pd.Series([next(covered(t, table.value, coverage), None) is None for t in texts], dtype=bool)

    return docs.where(free(F.col(text_col).cast("string")))
