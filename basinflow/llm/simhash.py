"""SimHash fingerprints and their links by pivot distance tables.

fingerprints() counts, over all shingles of a whole text, the set bits of their 64-bit hashes.

links() works on distinct fingerprints, so exact copies and equal texts cost one row. Each has its
pivot table: the Hamming distances to 16 reference fingerprints, packed in two longs. By the
triangle inequality two fingerprints within k bits differ by at most k in every coordinate, so a
larger difference discards a pair before its bits are compared. Which pairs are looked at at all
comes from an exact split: the 64 bits are cut into 5 blocks, and two fingerprints within 3 bits
agree on 2 blocks at least, so they meet under one of 10 keys of about 26 bits. (Distances to
references alone are no search key: over spread fingerprints nearly all lie within 32 +- 8.)

A key shared by few fingerprints is joined with itself. A key shared by many is cut into tiles of
bounded size; a tile compares its rows by numpy, first by pivot coordinates and then by bits, and
gives back only a spanning forest of its links, never all pairs. Components are then found over
these links by star contraction.

No words: fingerprint zero, linked like any other. null text: as the empty text. null doc_id: the
row keeps its fingerprint; component ids come from the other ids of its component (null if there
are none). Repeated rows stay repeated. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinflow.llm.bpe import text_slices
from basinflow.llm.common import connected_components, cut, small_batches

#: Start bit and width of the blocks.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
PAIRS = [(i, j) for i in range(5) for j in range(i + 1, 5)]
#: Fingerprints under one key that are still joined as rows; rows of one tile side.
FEW, TILE = 16, 2048
#: Reference fingerprints: any fixed spread values; these come from a fixed seed.
REFERENCES = [int(x) for x in np.random.default_rng(20240501).integers(-(2**63), 2**63 - 1, 16)]


def text_fingerprint(text: str | None, shingle: int) -> int:
    """Majority bits of the XXH64 (seed 42) of all shingles of ASCII-lower-cased words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    one, line = xxhash.xxh64_intdigest, b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, stops = [0, *ends[:-shingle].tolist()], (ends[shingle - 1 :] - 1).tolist()
    count, n = np.zeros(64, np.int64), len(starts)
    for k in range(0, n, 1 << 15):
        h = np.array([one(line[a:b], 42) for a, b in zip(starts[k : k + (1 << 15)], stops[k : k + (1 << 15)])], "<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every row."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for at, texts in text_slices(batch.column(1)):
                fp = np.array([text_fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def pivot_table(fp: Column) -> list[Column]:
    """Distances to the references, eight bits each, in the two longs p0 and p1."""
    out = []
    for half in range(2):
        packed = F.lit(0).cast("long")
        for i, r in enumerate(REFERENCES[8 * half : 8 * half + 8]):
            packed = packed.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(r))).cast("long"), 8 * i))
        out.append(packed.alias(f"p{half}"))
    return out


def keys(fp: Column) -> Column:
    """The ten keys: number of the block pair, and the bits of its blocks."""
    block = lambda k: F.shiftrightunsigned(fp, BLOCKS[k][0]).bitwiseAND(F.lit((1 << BLOCKS[k][1]) - 1))
    return F.array(*(F.lit(n << 32).bitwiseOR(F.shiftleft(block(i), 13)).bitwiseOR(block(j)) for n, (i, j) in enumerate(PAIRS)))


def near_coordinates(a: str, b: str, most: int) -> Column:
    out = F.lit(True)
    for half in range(2):
        for i in range(8):
            at = lambda side: F.shiftrightunsigned(F.col(f"{side}.p{half}"), 8 * i).bitwiseAND(F.lit(255))  # noqa: B023, E731
            out = out & (F.abs(at(a) - at(b)) <= most)
    return out


def forest(fp: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between places of fp."""
    root = {}

    def top(i):
        while (r := root.get(i, i)) != i:
            root[i] = root.get(r, r)
            i = r
        return i

    out = []
    for i, j in zip(left.tolist(), right.tolist()):
        a, b = top(i), top(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((int(fp[i]), int(fp[j])))
    return out


def tile_links(rows: pd.DataFrame, most: int, slab: int = 256) -> pd.DataFrame:
    """Spanning links of one tile: rows of side 0 against rows of side 1 (a tile on the diagonal
    has its rows once, against themselves)."""
    fp = rows["fp"].to_numpy(np.int64)
    pivots = rows[["p0", "p1"]].to_numpy(np.int64).copy().view(np.uint8).astype(np.int16)
    side = rows["side"].to_numpy()
    a, b = np.flatnonzero(side <= 1), np.flatnonzero(side != 1)
    b = b[np.argsort(pivots[b, 0], kind="stable")]
    first, out_l, out_r = pivots[b, 0], [], []
    for k in range(0, len(a), slab):
        part = a[k : k + slab]
        low, high = np.searchsorted(first, pivots[part, 0] - most, "left"), np.searchsorted(first, pivots[part, 0] + most, "right")
        n = high - low
        i = np.repeat(part, n)
        j = b[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
        for c in range(1, 16):
            near = np.abs(pivots[i, c] - pivots[j, c]) <= most
            i, j = i[near], j[near]
        near = np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= most
        out_l.append(i[near])
        out_r.append(j[near])
    found = forest(fp, np.concatenate(out_l or [a[:0]]), np.concatenate(out_r or [a[:0]]))
    return pd.DataFrame(found, columns=["src", "dst"], dtype="int64")


def links(marks: DataFrame, most: int = 3) -> DataFrame:
    """Links (src, dst) between the distinct values of the column fp that differ by at most `most`
    bits, enough of them to give the same components as all of them. most: 3 or less."""
    if not 0 <= most <= 3:
        raise ValueError("the blocks are exact for up to 3 bits")
    distinct = marks.select("fp").distinct()
    keyed = distinct.select("fp", *pivot_table(F.col("fp")), F.explode(keys(F.col("fp"))).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(keyed.join(shared, "key"))
    few = met.where(F.col("n") <= FEW)
    pairs = few.alias("a").join(few.alias("b"), F.col("a.key") == F.col("b.key")).where(F.col("a.fp") < F.col("b.fp")).where(near_coordinates("a", "b", most)).where(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= most)
    many = met.where(F.col("n") > FEW).withColumn("cuts", F.ceil(F.col("n") / TILE).cast("long")).withColumn("own", F.pmod(F.xxhash64("fp"), "cuts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("other")
    tiles = many.select("*", other).select("key", "fp", "p0", "p1", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"))
    tiled = tiles.groupBy("key", "i", "j").applyInPandas(lambda rows: tile_links(rows, most), "src long, dst long")
    return pairs.select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst")).unionByName(tiled).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, most: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) per row."""
    marks = cut(fingerprints(docs, shingle, id_col, text_col))
    parts = connected_components(links(marks, most))
    owners = marks.groupBy("fp").agg(F.min("doc_id").alias("first"))
    named = owners.join(parts, owners["fp"] == parts["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("part"))
    lowest = named.groupBy("part").agg(F.min("first").alias("component_id"))
    by_fp = named.join(lowest, "part").select(F.col("fp").alias("_fp"), "component_id")
    return marks.join(by_fp, marks["fp"] == by_fp["_fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
