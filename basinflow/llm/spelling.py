"""Spelling variants: words that differ by one inserted, deleted or replaced letter, by a dictionary of pairs
of trie nodes.

All words are sorted once as they are and once reversed, by range partitions. In each order the nodes of the
words' trie are numbered: a node's number is the place of its first letter chain's end in the sorted words, laid
end to end. A word without its i-th letter is then the pair of integers (node of the first i letters, node of
the reversed rest); so is a word that is cut open at i, where another may have one letter more. Words that share
such a pair are the exact neighbours; at most one word fits an opened pair, and those of a skipped pair
differ in that letter alone, so no group is larger than the alphabet.

null texts have no words. A null doc_id is the empty text in what is hashed. Repeated rows count again. Extra
columns are neither read nor returned. An empty table gives an empty result. Very long words are words like
others: work and memory grow with their length.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinflow.llm.common import cut
from basinflow.operators.graph import chase

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "A-Za-zÀ-ÿ"
#: Letters that a word has at least, occurrences that it has at least, and one run in so many loses a letter.
SHORTEST, FEWEST, THINNED = 7, 2, 31
#: How many times as frequent a word's form must be.
MORE = 10


def lost_letter(doc_id: Column, run: Column) -> Column:
    """The run, or, if the hash of identifier and run is divisible by THINNED, the run without the letter at
    that hash modulo its length."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run).cast("long")).cast("int")
    return F.when(h % THINNED == 0, F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, fewest: int = FEWEST) -> DataFrame:
    """word and n, its occurrences in all texts."""
    runs = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))).alias("run"))
    words = runs.select(lost_letter(F.col("doc_id"), F.translate("run", UPPER, LOWER)).alias("word"))
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= fewest)


def shared(a: str, b: str) -> int:
    """Letters that both begin with."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n - 1
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


class Numbering:
    """Node numbers along words in ascending order, from 1 with the first word's first letter."""

    def __init__(self):
        self.word, self.nodes, self.size = "", [], 0

    def next(self, word: str) -> list[int]:
        k = shared(self.word, word)
        self.nodes = self.nodes[:k] + list(range(self.size + k + 1, self.size + len(word) + 1))
        self.word, self.size = word, self.size + len(word)
        return self.nodes


def trie_nodes(words: DataFrame, key: str, name: str) -> DataFrame:
    """words with the column `name`: the numbers of the trie nodes along the column key, 0 (the root)
    first. The distinct keys are sorted by range; each partition numbers its own words. One row for each
    partition then says how far its first word goes along with the last one before, whose nodes
    it takes over."""
    placed = cut(words.repartitionByRange(key).sortWithinPartitions(key).withColumn("_part", F.spark_partition_id()))

    def ends(batches):
        numbering, first, part = Numbering(), None, None
        for batch in batches:
            for part, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                first = word if first is None else first
                numbering.next(word)
        if part is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "first": [first], "last": [numbering.word], "nodes": pa.array([numbering.nodes], pa.list_(pa.int64())), "size": pa.array([numbering.size], pa.int64())})

    known, last, nodes, start = {}, "", [], 0
    for row in sorted(placed.select("_part", key).mapInArrow(ends, "part int, first string, last string, nodes array<long>, size long").collect()):
        taken = nodes[: shared(last, row["first"])]
        known[row["part"]] = (start, taken)
        nodes = [taken[x - 1] if x <= len(taken) else start + x for x in row["nodes"]]
        last, start = row["last"], start + row["size"]

    def numbered(batches):
        numbering = Numbering()
        for batch in batches:
            out = []
            for part, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                start, taken = known[part]
                out.append([0, *(taken[x - 1] if x <= len(taken) else start + x for x in numbering.next(word))])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.list_(pa.int64()))], names=[key, name])

    return placed.select("_part", key).mapInArrow(numbered, f"{key} string, {name} array<long>")


def near_words(words: DataFrame) -> DataFrame:
    """Of words(word, id, f, r), f the nodes of its beginnings and r those of its ends: pairs (a, b) of the
    ids of near words, in both directions."""
    beginnings, rests = F.slice("f", 1, F.size("f") - 1), F.slice("r", 2, F.size("r") - 1)
    pair = lambda x, y: F.struct(x.alias("f"), y.alias("r"))
    skipped = words.select("id", F.inline(F.zip_with(beginnings, rests, pair))).select("f", "r", F.col("id").alias("short"), F.lit(None).cast("long").alias("open"))
    opened = words.select("id", F.inline(F.zip_with("f", "r", pair))).select("f", "r", F.lit(None).cast("long").alias("short"), F.col("id").alias("open"))
    met = skipped.unionByName(opened).groupBy("f", "r").agg(F.collect_set("short").alias("short"), F.max("open").alias("open"))
    all_of = F.when(F.col("open").isNull(), F.col("short")).otherwise(F.array_append("short", F.col("open")))
    wide = met.where((F.size("short") > 1) | (F.size("short") == 1) & F.col("open").isNotNull()).select(all_of.alias("ids"))
    return wide.select(F.explode("ids").alias("a"), "ids").select("a", F.explode("ids").alias("b")).where("a <> b").distinct()


def variants(counts: DataFrame, more: int = MORE) -> DataFrame:
    """For rows (word, n): n, n_near (near words), form (the most frequent near word, the first in the order
    of code points of those, if it is at least `more` times as frequent), form_n (its n) and root (where
    the forms end)."""
    words = cut(counts.select("word", "n", F.reverse("word").alias("back")))
    ahead, behind = trie_nodes(words.select("word"), "word", "f"), trie_nodes(words.select("back"), "back", "r")
    named = cut(words.join(ahead, "word").join(behind, "back").select("word", "n", F.element_at("f", -1).alias("id"), "f", F.reverse("r").alias("r")))
    names = named.select("id", "word", "n")
    near = near_words(named)
    other = names.select(F.col("id").alias("b"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    best = near.join(other, "b").groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("k"), "form", F.col("b").alias("to"))).alias("best"))
    found = cut(names.join(best, "id", "left").withColumn("best", F.when(-F.col("best.k") >= more * F.col("n"), F.col("best"))))
    tops = chase(found.select(F.col("id").alias("node"), F.col("best.to").alias("parent")), [])
    roots = tops.join(names.select(F.col("id").alias("top"), F.col("word").alias("root")), "top").select(F.col("node").alias("id"), "root")
    return found.join(roots, "id").select("word", F.col("best.form").alias("form"), "root", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-F.col("best.k")).alias("form_n"))
