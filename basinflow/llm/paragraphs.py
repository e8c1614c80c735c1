"""Substring dedup by MinHash banding of paragraphs.

Paragraphs are the lines of a text. Those of at least MIN_WORDS words are hashed (words lower-cased
in ASCII, white space as one space); equal ones become one row with 24 minima over their shingles of
five words. With 8 bands of 3 minima, a pair of Jaccard similarity 0.8 meets in a band with a
probability of 0.997. Paragraphs that share a band key with another one are candidates: their exact
shingle sets are taken from the texts, and pairs of a similarity of at least 0.8 are linked.
Components of links and of equal paragraphs are clusters; the first occurrence stays (smallest
document, then line), all others are removals.

A key shared by few paragraphs is joined with itself; one shared by many is cut into tiles of bounded
rows and shingles whose links come back as a spanning forest, never as all pairs. Equal paragraphs cost one row in
all of this, however often they occur.

Passages are found apart from lines, in the words of the whole text, so they may lie inside a longer line
or spread over short ones: among the hashes of all runs of PASSAGE words, the smallest of each WINDOW
following ones is taken. Texts that share PASSAGE + WINDOW - 1 = 50 words share one of them, wherever the
passage stands. The same hash at two places is a repeat; overlapping ones of a text are joined to spans. So
every repeated run of 50 words is found; of runs of PASSAGE to 49 words, those that were taken. The first and
last run of a span are then made longer word by word, up to WINDOW - 1 words, while the longer run is
still found at another place: spans end where the common runs end. Only places are counted and
joined: no pairs of texts.

null or empty texts have no paragraphs. null ids sort first, as in Spark. Every row counts for itself, also
where an identifier is null or repeats: the column copy tells such rows apart (see common.numbered), and
of equal rows only the first is kept. Lines of fewer words are removed as parts of passages only. Extra
columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basinflow.llm.bpe import text_slices
from basinflow.llm.common import COPY, connected_components, cut, numbered, own_name, small_batches

MIN_WORDS, SHINGLE, BANDS, ROWS = 20, 5, 8, 3
#: Words of a sampled run; following runs of which one is taken (together, runs of 50 words).
PASSAGE, WINDOW = 32, 19
#: Paragraphs under one key that are still joined as rows; rows and shingles (8 bytes each) of one tile side, on average.
FEW, TILE, TILE_SHINGLES = 16, 512, 1 << 20
SLICE = 1 << 20
KEYS = [f"k{i}" for i in range(BANDS)]
ODD = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(ODD), -1, 2**64))
DRAW = np.random.default_rng(20240502)
FACTORS = [np.uint64(int(x) | 1) for x in DRAW.integers(0, 2**63, BANDS * ROWS)]
ADDENDS = [np.uint64(int(x)) for x in DRAW.integers(0, 2**63, BANDS * ROWS)]


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def lines_of(text: str | None, least: int) -> list[tuple[int, int, bytes]]:
    """(line number, words, normal form) of the paragraphs of at least so many words."""
    out = []
    for i, line in enumerate((text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")):
        words = line.split()
        if words and len(words) >= least:
            out.append((i, len(words), b" ".join(words)))
    return out


def sums(x: np.ndarray) -> np.ndarray:
    """Sums of the values before each place, weighted by powers of ODD."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * powers(ODD, len(x)), dtype=np.uint64)])


def word_hashes(normal: list[bytes]) -> np.ndarray:
    """Hashes of the words of all these normal forms, one after the other."""
    data = np.frombuffer(b" ".join(normal) + b" ", np.uint8)
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    prefix = sums(data.astype(np.uint64) + np.uint64(1))
    return mix((prefix[ends] - prefix[starts]) * powers(INVERSE, len(data))[starts])


def sliding(take, x: np.ndarray, width: int) -> np.ndarray:
    """take (minimum or maximum) over every run of so many values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = take(x[:-step], x[step:])
        have += step
    return x


def taken_runs(normal: list[bytes], counts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first word and hash of the runs of PASSAGE words that are taken. Every text has
    at least PASSAGE + WINDOW - 1 words."""
    words = word_hashes(normal)
    n = np.array(counts)
    sizes = n - PASSAGE + 1
    text = np.repeat(np.arange(len(n)), sizes)
    word = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = word + np.repeat(np.cumsum(n) - n, sizes)
    prefix = sums(words)
    hashes = mix((prefix[at + PASSAGE] - prefix[at]) * powers(INVERSE, len(words))[at])
    low = sliding(np.minimum, hashes, WINDOW)
    low[text[: len(low)] != text[WINDOW - 1 :]] = 0  # no window over the end of a text
    edge = np.zeros(WINDOW - 1, np.uint64)
    mine = np.flatnonzero(sliding(np.maximum, np.concatenate([edge, low, edge]), WINDOW) == hashes)
    return text[mine], word[mine], hashes[mine]


def shingles(normal: list[bytes], counts: list[int], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles of the paragraphs, one after the other, and where each
    paragraph's begin. A paragraph of fewer words has one shingle, the whole."""
    words = word_hashes(normal)
    n = np.array(counts)
    first = np.cumsum(n) - n
    sizes = np.maximum(1, n - width + 1)
    begin = np.cumsum(sizes) - sizes
    at = np.repeat(first - begin, sizes) + np.arange(sizes.sum())
    last = np.repeat(first + n, sizes)
    out = np.zeros(len(at), np.uint64)
    for k in range(width):
        inside = at + k < last
        out = np.where(inside, out * ODD + words[np.minimum(at + k, len(words) - 1)], out)
    return mix(out), begin


def band_keys(hashes: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    out = []
    for band in range(BANDS):
        key = np.full(len(begin), np.uint64(band + 1))
        for k in range(ROWS * band, ROWS * band + ROWS):
            key = mix(key * ODD + np.minimum.reduceat((hashes * FACTORS[k] + ADDENDS[k]) >> np.uint64(24), begin))
        out.append(key.view(np.int64))
    return out


def occurrences(docs: DataFrame, least: int, id_col: str, text_col: str, banded: bool) -> DataFrame:
    """doc_id, copy, line, words, hash and, if wanted, band keys of every paragraph."""
    small_batches(docs.sparkSession)

    def run(batches):
        import xxhash

        for batch in batches:
            for at, texts in text_slices(batch.column(2), SLICE):
                own = (batch.column(i).slice(at, len(texts)).to_pylist() for i in (0, 1))
                found = [(d, c, *x) for d, c, t in zip(*own, texts) for x in lines_of(t, least)]
                if found:
                    ids, copy, line, words, normal = zip(*found)
                    keys = band_keys(*shingles(normal, words, SHINGLE)) if banded else []
                    mark = np.array([xxhash.xxh3_64_intdigest(x) for x in normal], np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(copy, pa.int64()), pa.array(line, pa.int32()), pa.array(words, pa.int32()), pa.array(mark), *map(pa.array, keys)], names=names)

    names = ["doc_id", "copy", "line", "words", "hash", *(KEYS if banded else [])]
    return rows_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, copy long, line int, words int, hash long" + "".join(f", {k} long" for k in names[5:]))


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(COPY).alias("copy"), F.col(text_col).cast("string").alias("text"))


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """hash and set (sorted shingle hashes) of the wanted paragraphs (doc_id, copy, line and hash)."""

    def run(batches):
        import xxhash

        for batch in batches:
            for at, texts in text_slices(batch.column(0), SLICE):
                marks, sets = [], []
                for text, lines in zip(texts, batch.column(1).slice(at, len(texts)).to_pylist()):
                    have = {i: (n, normal) for i, n, normal in lines_of(text, 1)}
                    for x in lines:
                        n, normal = have.get(x["line"], (0, b""))
                        if n and np.uint64(xxhash.xxh3_64_intdigest(normal)).astype(np.int64) == x["hash"]:
                            marks.append(x["hash"])
                            sets.append(np.unique(shingles([normal], [n], SHINGLE)[0]).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(marks, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["hash", "set"])

    asked = wanted.groupBy(F.col("doc_id").alias("_id"), F.col("copy").alias("_number")).agg(F.collect_list(F.struct("line", "hash")).alias("lines"))
    rows = rows_of(docs, id_col, text_col)
    return rows.join(asked, rows["doc_id"].eqNullSafe(asked["_id"]) & (rows["copy"] == asked["_number"])).select("text", "lines").mapInArrow(run, "hash long, set array<long>").dropDuplicates(["hash"])


def tile_links(rows: pd.DataFrame, least: float) -> pd.DataFrame:
    """Spanning links of a tile: side 0 against side 1 (on the diagonal against themselves). Pairs
    that are connected already are not compared again, which changes no component."""
    marks, side = rows["hash"].to_numpy(np.int64), rows["side"].to_numpy()
    sets = [np.asarray(x, np.int64).view(np.uint64) for x in rows["set"]]  # sorted, as they were made
    same = not (side > 0).any()
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    left, right = [i for i in order if same or side[i] == 1], [i for i in order if same or side[i] == 2]
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out, low = [], 0
    for i in left:
        size = len(sets[i])
        while low < len(right) and len(sets[right[low]]) < least * size:
            low += 1
        for j in right[low:]:
            if least * len(sets[j]) > size:
                break
            if i != j and top(i) != top(j):
                common = int((sets[j][np.minimum(np.searchsorted(sets[j], sets[i]), len(sets[j]) - 1)] == sets[i]).sum())
                if common >= least * (size + len(sets[j]) - common):
                    root[top(i)] = top(j)
                    out.append((marks[i], marks[j]))
    return pd.DataFrame(out, columns=["src", "dst"], dtype="int64")


def links(docs: DataFrame, distinct: DataFrame, least: float, id_col: str, text_col: str) -> DataFrame:
    """Links (src, dst) between hashes of similar paragraphs, enough for their components."""
    keyed = distinct.select("hash", F.explode(F.array(*KEYS)).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(keyed.join(shared, "key"))
    wanted = distinct.select("hash", "first.*").join(met.select("hash").distinct(), "hash")
    sets = cut(shingle_sets(docs, wanted, id_col, text_col))
    few = met.where(F.col("n") <= FEW)
    pairs = few.alias("a").join(few.alias("b"), F.col("a.key") == F.col("b.key")).where(F.col("a.hash") < F.col("b.hash")).select(F.col("a.hash").alias("src"), F.col("b.hash").alias("dst")).distinct()
    common = F.size(F.array_intersect("left", "right"))
    both = pairs.join(sets.select(F.col("hash").alias("src"), F.col("set").alias("left")), "src").join(sets.select(F.col("hash").alias("dst"), F.col("set").alias("right")), "dst")
    near = both.where(common >= F.lit(least) * (F.size("left") + F.size("right") - common)).select("src", "dst")
    crowded = met.where(F.col("n") > FEW)
    sizes = crowded.join(sets.select("hash", F.size("set").alias("size")), "hash").groupBy("key").agg(F.sum("size").alias("shingles"))
    cuts = F.ceil(F.greatest(F.col("n") / TILE, F.col("shingles") / TILE_SHINGLES)).cast("long")
    many = crowded.join(sizes, "key").withColumn("cuts", cuts).withColumn("own", F.pmod(F.xxhash64("hash"), "cuts"))
    tiles = many.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1))).select("key", "hash", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"))
    tiled = tiles.join(sets, "hash").groupBy("key", "i", "j").applyInPandas(lambda rows: tile_links(rows, least), "src long, dst long")
    return near.unionByName(tiled).distinct()


def repeated(docs: DataFrame, least: float = 0.8, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every paragraph that occurs more than once or has a near copy: doc_id, copy, line (from 0), words,
    component_id and component_line (the cluster's first occurrence), kept."""
    docs = numbered(docs, id_col, text_col)
    # Two scans, the second without keys, are cheaper than to store all paragraphs.
    banded, found = (occurrences(docs, max(1, min_words), id_col, text_col, b) for b in (True, False))
    place = F.struct("doc_id", "copy", "line")
    distinct = cut(banded.groupBy("hash").agg(*(F.first(k).alias(k) for k in KEYS), F.min(place).alias("first"), F.count("*").alias("n")))
    parts = connected_components(links(docs, distinct, least, id_col, text_col))
    named = distinct.select("hash", "first", "n").join(parts, distinct["hash"] == parts["node"], "left").withColumn("part", F.coalesce("component", "hash"))
    clusters = named.groupBy("part").agg(F.min("first").alias("head"), F.sum("n").alias("total")).where("total > 1")
    # Written, so that the join below deals both sides anew and can split a line that occurs very often.
    by_hash = cut(named.join(clusters, "part").select(F.col("hash").alias("_hash"), "head"))
    out = found.join(by_hash, found["hash"] == by_hash["_hash"])
    return out.select("doc_id", "copy", "line", "words", F.col("head.doc_id").alias("component_id"), F.col("head.line").alias("component_line"), is_head("line").alias("kept"))


def is_head(place: str) -> Column:
    """Whether a row is the occurrence that its struct `head` names."""
    return F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("copy") == F.col("head.copy")) & (F.col(place) == F.col(f"head.{place}"))


def runs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, copy, word and hash of every run that is taken."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for at, texts in text_slices(batch.column(2), SLICE):
                split = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
                rows = [i for i, w in enumerate(split) if len(w) >= PASSAGE + WINDOW - 1]
                if rows:
                    text, word, hashes = taken_runs([b" ".join(split[i]) for i in rows], [len(split[i]) for i in rows])
                    own = pa.array(np.array(rows)[text] + at)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(word.astype(np.int32)), pa.array(hashes.view(np.int64))], names=["doc_id", "copy", "word", "hash"])

    return rows_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, copy long, word int, hash long")


def longer_runs(docs: DataFrame, asked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The asked runs (doc_id, copy, word and side) with 1 to WINDOW - 1 words more before them (side 0) or
    after them (side 1), as far as the text goes: doc_id, copy, word, side, more and key, a hash of the
    longer run and the side."""
    small_batches(docs.sparkSession)
    more = np.arange(1, WINDOW)
    names = ["doc_id", "copy", "word", "side", "more", "key"]

    def run(batches):
        for batch in batches:
            for at, texts in text_slices(batch.column(2), SLICE):
                parts = []
                for i, (text, places) in enumerate(zip(texts, batch.column(3).slice(at, len(texts)).to_pylist())):
                    words = word_hashes([b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())])
                    prefix, back = sums(words), powers(INVERSE, len(words))
                    word, side = (np.array([p[name] for p in places])[:, None] for name in ("word", "side"))
                    start, end = word - more * (side == 0), word + PASSAGE + more * (side == 1)
                    row, n = np.nonzero((start >= 0) & (end <= len(words)))
                    start, end, side = start[row, n], end[row, n], side[row, 0]
                    keys = mix((prefix[end] - prefix[start]) * back[start]) * ODD + side.astype(np.uint64)
                    parts.append((np.full(len(row), i + at), word[row, 0], side, more[n], keys.view(np.int64)))
                own, word, side, n, keys = map(np.concatenate, zip(*parts))
                own = pa.array(own)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), *(pa.array(x.astype(np.int32)) for x in (word, side, n)), pa.array(keys)], names=names)

    places = asked.groupBy(F.col("doc_id").alias("_id"), F.col("copy").alias("_number")).agg(F.collect_list(F.struct("word", "side")).alias("places"))
    rows = rows_of(docs, id_col, text_col)
    met = rows.join(places, rows["doc_id"].eqNullSafe(places["_id"]) & (rows["copy"] == places["_number"])).select("doc_id", "copy", "text", "places")
    return met.mapInArrow(run, "doc_id long, copy long, word int, side int, more int, key long")


def extensions(docs: DataFrame, met: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """How far the ends of spans reach beyond their first and last runs: doc_id, copy, word, side, more (words
    that the run and those beside it have in common with the same run at any other place) and lost (with
    an earlier place). Every place of a run that ends a span somewhere is asked for its longer runs,
    and these are counted like runs: no pairs of places."""
    ends = spans.select(F.col("first.hash").alias("hash"), F.lit(0).alias("side")).unionByName(spans.select(F.col("last.hash").alias("hash"), F.lit(1).alias("side"))).distinct()
    keys = longer_runs(docs, met.join(ends, "hash").select("doc_id", "copy", "word", "side"), id_col, text_col)
    # Written, so that the join below can split a run that occurs very often.
    shared = cut(keys.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "copy", "word")).alias("head")).where("n > 1").drop("n"))
    again = keys.join(shared, keys["key"] == shared["_key"])
    return again.groupBy("doc_id", "copy", "word", "side").agg(F.max("more").alias("more"), F.max(F.when(~is_head("word"), F.col("more"))).alias("lost"))


def neighbours(docs: DataFrame, asked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The asked rows (doc_id, copy, word, side and head) with near: 32 bits of the hash of each of the WINDOW - 1
    words before (side 0) or after (side 1) the run at word, from the run outwards."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for at, texts in text_slices(batch.column(2), SLICE):
                rows = []
                ids, copies, places = (batch.column(i).slice(at, len(texts)).to_pylist() for i in (0, 1, 3))
                for i, c, text, own in zip(ids, copies, texts, places):
                    words = (word_hashes([b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    for p in own:
                        w = p["word"]
                        near = words[max(0, w - WINDOW + 1) : w][::-1] if p["side"] == 0 else words[w + PASSAGE : w + PASSAGE + WINDOW - 1]
                        rows.append((i, c, w, p["side"], p["head"], near))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), kind)], schema=kind)

    place = pa.struct([("doc_id", pa.int64()), ("copy", pa.int64()), ("word", pa.int32())])
    kind = pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("word", pa.int32()), ("side", pa.int32()), ("head", place), ("near", pa.list_(pa.int32()))])
    places = asked.groupBy(F.col("doc_id").alias("_id"), F.col("copy").alias("_number")).agg(F.collect_list(F.struct("word", "side", "head")).alias("places"))
    rows = rows_of(docs, id_col, text_col)
    met = rows.join(places, rows["doc_id"].eqNullSafe(places["_id"]) & (rows["copy"] == places["_number"])).select("doc_id", "copy", "text", "places")
    return met.mapInArrow(run, "doc_id long, copy long, word int, side int, head struct<doc_id: long, copy: long, word: int>, near array<int>")


def first_extensions(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """As extensions(), but the ends of a span are compared with the first place of their runs only, and the
    first place reaches as far as any of these ends does."""
    lost = spans.where(~F.col("kept"))
    ends = lost.select("doc_id", "copy", F.col("first.word").alias("word"), F.lit(0).alias("side"), F.col("first.head").alias("head"))
    ends = ends.unionByName(lost.select("doc_id", "copy", F.col("last.word").alias("word"), F.lit(1).alias("side"), F.col("last.head").alias("head")))
    heads = ends.select("head.*", "side", "head").distinct()
    own = neighbours(docs, ends, id_col, text_col)
    theirs = neighbours(docs, heads, id_col, text_col).select(F.col("doc_id").alias("_id"), F.col("copy").alias("_number"), F.col("word").alias("_word"), F.col("side").alias("_side"), F.col("near").alias("_near"))
    same = F.col("head.doc_id").eqNullSafe(F.col("_id")) & (F.col("head.copy") == F.col("_number")) & (F.col("head.word") == F.col("_word")) & (F.col("side") == F.col("_side"))
    other = F.array_position(F.zip_with("near", "_near", lambda a, b: a == b), False)
    reach = F.when(other > 0, other - 1).otherwise(F.least(F.size("near"), F.size("_near"))).cast("int")
    met = cut(own.join(theirs, same).select("doc_id", "copy", "word", "side", "head", reach.alias("more")))
    firsts = met.groupBy("head", "side").agg(F.max("more").alias("more")).select("head.*", "side", "more", F.lit(0).alias("lost"))
    return met.select("doc_id", "copy", "word", "side", "more", F.col("more").alias("lost")).unionByName(firsts)


def beside(spans: DataFrame, reach: DataFrame, side: int, end: str, names: tuple[str, str]) -> DataFrame:
    """spans with the reach of one end, 0 where nothing beside it is shared."""
    of = reach.where(F.col("side") == side).select(F.col("doc_id").alias("_id"), F.col("copy").alias("_number"), F.col("word").alias("_word"), F.col("more").alias("_more"), F.col("lost").alias("_lost"))
    met = spans.join(of, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_number")) & (F.col(end) == F.col("_word")), "left")
    return met.select(*spans.columns, *(F.coalesce(c, F.lit(0)).alias(n) for c, n in zip(("_more", "_lost"), names)))


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: bool = True) -> DataFrame:
    """Every span of words that occurs at another place too: doc_id, copy, word (from 0, in the whole text),
    words, component_id and component_word (first occurrence of its first sampled run), kept. A span begins
    and ends where the common run does, so all words of every common run of 50 words lie in spans. With every
    False, which costs much less, the ends of a span are held against the first place of their runs only: a
    common run of two later places may reach up to WINDOW - 1 words beyond, on either side. What occurs
    here first and what does not make spans of their own, which may overlap: words of a span that is
    not kept all stand at an earlier place too."""
    docs = numbered(docs, id_col, text_col)
    found = runs(docs, id_col, text_col)  # scanned twice: cheaper than to store all runs
    # Written, so that the join below can split a passage that occurs very often.
    again = cut(found.groupBy(F.col("hash").alias("_hash")).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "copy", "word")).alias("head")).where("n > 1").drop("n"))
    met = found.join(again, found["hash"] == again["_hash"]).select("doc_id", "copy", "word", "hash", "head", is_head("word").alias("kept"))
    met = cut(met) if every else met
    own = Window.partitionBy("doc_id", "copy", "kept").orderBy("word")
    new = F.coalesce(F.col("word") > F.lag("word").over(own) + PASSAGE, F.lit(True))
    touching = met.withColumn("new", new.cast("int")).withColumn("span", F.sum("new").over(own))
    spans = cut(touching.groupBy("doc_id", "copy", "kept", "span").agg(F.min(F.struct("word", "hash", "head")).alias("first"), F.max(F.struct("word", "hash", "head")).alias("last")))
    reach = cut(extensions(docs, met, spans, id_col, text_col) if every else first_extensions(docs, spans, id_col, text_col))
    wide = beside(beside(spans, reach, 0, "first.word", ("before", "lost_before")), reach, 1, "last.word", ("after", "lost_after"))
    first, end = F.col("first.word"), F.col("last.word") + PASSAGE
    piece = lambda kept, begin, stop, head: F.struct(F.lit(kept).alias("kept"), begin.alias("word"), stop.alias("end"), head.alias("head"))
    here = lambda word: F.struct("doc_id", "copy", word.cast("int").alias("word"))
    pieces = F.when(F.col("kept"), F.array(piece(True, first - F.col("before"), end + F.col("after"), F.col("first.head")))).otherwise(
        F.array(
            piece(False, first - F.col("lost_before"), end + F.col("lost_after"), F.col("first.head")),
            F.when(F.col("before") > F.col("lost_before"), piece(True, first - F.col("before"), first + PASSAGE, here(first))),
            F.when(F.col("after") > F.col("lost_after"), piece(True, F.col("last.word").cast("int"), end + F.col("after"), here(F.col("last.word")))),
        )
    )
    rows = wide.select("doc_id", "copy", F.explode(F.filter(pieces, lambda x: x.isNotNull())).alias("piece")).select("doc_id", "copy", "piece.*")
    own = Window.partitionBy("doc_id", "copy", "kept").orderBy("word", "end")
    before = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    joined = rows.withColumn("new", F.coalesce(F.col("word") > before, F.lit(True)).cast("int")).withColumn("span", F.sum("new").over(own))
    out = joined.groupBy("doc_id", "copy", "kept", "span").agg(F.min(F.struct("word", "head")).alias("first"), F.max("end").alias("end"))
    return out.select("doc_id", "copy", F.col("first.word").alias("word"), (F.col("end") - F.col("first.word")).alias("words"), F.col("first.head.doc_id").alias("component_id"), F.col("first.head.word").alias("component_word"), "kept")


def all_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: bool = True) -> DataFrame:
    """The rows of repeated() (word and component_word are null) and of passages() (line and
    component_line are null)."""
    docs = numbered(docs, id_col, text_col)
    return repeated(docs, id_col=id_col, text_col=text_col).unionByName(passages(docs, id_col, text_col, every), allowMissingColumns=True)


def without(text: str, lines: list[int] | None, spans: list | None) -> str:
    """text without these lines and without these spans (first word, words) of words."""
    data = bytearray(text.encode("utf-8", "surrogatepass"))
    gone = np.zeros(len(data), bool)
    if spans:
        words = [m.span() for m in re.finditer(rb"\S+", data)]
        for first, n in spans:
            gone[words[first][0] : words[first + n - 1][1]] = True
    out, at = [], 0
    for i, line in enumerate(bytes(data).split(b"\n")):
        here = gone[at : at + len(line)]
        rest = bytes(np.frombuffer(line, np.uint8)[~here]) if here.any() else line
        at += len(line) + 1
        if i not in (lines or ()) and (rest.strip() or not here.any()):
            out.append(rest)
    return b"\n".join(out).decode("utf-8", "surrogatepass")


def remove(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the paragraphs and passages (of repeated() or all_repeats()) that are not kept.
    Row count and columns stay."""
    told = numbered(docs, id_col, text_col)
    span = F.when(F.col("word").isNotNull(), F.struct("word", "words")) if "word" in found.columns else F.lit(None).cast("struct<word:int,words:int>")
    one, number, lines, spans = map(own_name, ("id", "number", "lines", "spans"))
    lost = found.where(~F.col("kept")).groupBy(F.col("doc_id").alias(one), F.col("copy").alias(number)).agg(F.collect_set("line").alias(lines), F.collect_set(span).alias(spans))
    rest = F.udf(lambda t, lines, spans: None if t is None else without(t, lines, spans), "string")
    met = told.join(lost, told[id_col].cast("long").eqNullSafe(lost[one]) & (told[COPY] == lost[number]), "left")
    return met.withColumn(text_col, F.when(F.col(lines).isNotNull(), rest(F.col(text_col), lines, spans)).otherwise(F.col(text_col))).select(docs.columns)
