"""Phylogenetic trees as canonical strings, and their nearest-neighbour interchanges.

A tree is rooted at leaf 1: ((1)(A)(B)), where A and B are a leaf number or (C)(D); of two subtrees,
the one with the smaller least leaf comes first.
"""

from __future__ import annotations

import re
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType


def parse(text: str):
    """Nested pairs of leaf numbers of what hangs on leaf 1."""
    tokens, at = re.findall(r"[()]|\d+", text), 0

    def group():
        nonlocal at
        at += 1
        parts = []
        while tokens[at] != ")":
            if tokens[at] == "(":
                parts.append(group())
            else:
                parts.append(int(tokens[at]))
                at += 1
        at += 1
        return parts[0] if len(parts) == 1 else tuple(parts)

    first, *rest = group()
    if first != 1 or len(rest) != 2:
        raise ValueError(f"not a tree rooted at leaf 1: {text}")
    return tuple(rest)


@cache
def least(t) -> int:
    return t if isinstance(t, int) else min(map(least, t))


def inner(t) -> str:
    return str(t) if isinstance(t, int) else "".join(f"({inner(x)})" for x in sorted(t, key=least))


def written(t) -> str:
    return f"((1){inner(t)})"


def interchanges(t):
    """All trees one interchange away: a subtree changes place with a child of its sibling."""
    for k in range(2):
        x, sibling = t[k], t[1 - k]
        if not isinstance(x, int):
            yield ((sibling, x[1]), x[0])
            yield ((x[0], sibling), x[1])
            for y in interchanges(x):
                yield (y, sibling)


@F.pandas_udf(ArrayType(StringType()))
def nni(trees: pd.Series) -> pd.Series:
    return trees.map(lambda s: None if s is None else [written(x) for x in interchanges(parse(s))])


def grown(t, leaf: int):
    """All trees with one more leaf on one of the edges."""
    yield (t, leaf)
    if not isinstance(t, int):
        for x in grown(t[0], leaf):
            yield (x, t[1])
        for x in grown(t[1], leaf):
            yield (t[0], x)


@F.pandas_udf(ArrayType(StringType()))
def with_leaf(trees: pd.Series, leaf: pd.Series) -> pd.Series:
    return pd.Series([[written(x) for x in grown(parse(s), int(n))] for s, n in zip(trees, leaf)])


def all_trees(spark, leaves: int):
    """Every binary tree with the given number of leaves (3 or more): column tree. Each round adds a
    leaf to every edge of every tree, as rows."""
    out = spark.range(1).select(F.lit("((1)(2)(3))").alias("tree"))
    for n in range(4, leaves + 1):
        out = out.select(F.explode(with_leaf("tree", F.lit(n))).alias("tree")).repartition("tree")
    return out


#: The tree of leaves 1 to 3, from which the others grow.
SEED = "((1)(2)(3))"


def edges(leaves: int) -> int:
    """Edges of a tree, which are the places of one more leaf."""
    return 2 * leaves - 3


def count_trees(leaves: int) -> int:
    """Number of binary trees with numbered leaves."""
    out = 1
    for n in range(4, leaves + 1):
        out *= edges(n - 1)
    return out


def planted(tree: str, leaf: int, place: int) -> str:
    """The tree with a leaf larger than all others on an edge: 0 is that of leaf 1, the others count the
    groups behind it in the order of the text."""
    if not 0 <= place < edges(leaf - 1):
        raise ValueError(f"no edge {place} for leaf {leaf}")
    if place == 0:
        return f"{tree[:4]}({tree[4:-1]})({leaf}))"
    at = 3
    for _ in range(place):
        at = tree.index("(", at + 1)
    end, depth = at, 0
    while True:
        depth += {"(": 1, ")": -1}.get(tree[end], 0)
        end += 1
        if not depth:
            return f"{tree[:at]}({tree[at:end]}({leaf})){tree[end:]}"


def uprooted(tree: str) -> list[int]:
    """The places at which the leaves 4, 5, ... have been planted: planted() taken back, the last first."""
    leaves, places = len(re.findall(r"\d+", tree)), []
    for leaf in range(leaves, 3, -1):
        end = tree.index(f"({leaf})")
        at, depth = end - 1, 0
        while True:
            depth += {")": 1, "(": -1}.get(tree[at], 0)
            if not depth:
                break
            at -= 1
        if at == 4 and end + len(str(leaf)) + 3 == len(tree):  # the leaf hangs beside all the rest
            tree, place = tree[:4] + tree[5 : end - 1] + ")", 0
        else:
            place = tree.count("(", 4, at)
            tree = tree[: at - 1] + tree[at:end] + tree[end + len(str(leaf)) + 3 :]
        places.append(place)
    return places[::-1]


@F.pandas_udf(StringType())
def from_places(places: pd.Series) -> pd.Series:
    """The tree that grows by planting leaves 4, 5, ... at these places; null stays null."""

    def grow(at):
        tree = SEED
        for k, place in enumerate(at):
            tree = planted(tree, k + 4, int(place))
        return tree

    return places.map(lambda at: None if at is None else grow(at))


@F.pandas_udf(ArrayType(IntegerType()))
def to_places(trees: pd.Series) -> pd.Series:
    return trees.map(lambda s: None if s is None else uprooted(s))


def rank_places(rank: Column, leaves: int) -> Column:
    """The digits of a tree's number from 0 to count_trees(leaves) - 1: the place of leaf 4 counts most. Any
    part of the numbers gives its trees without the others."""
    size, out = count_trees(leaves), []
    for n in range(4, leaves + 1):
        size //= edges(n - 1)
        out.append(F.floor(rank / size).cast("long") % edges(n - 1) if size > 1 else rank % edges(n - 1))
    return F.array(*(x.cast("int") for x in out)) if out else F.array().cast("array<int>")


def places_rank(places: Column, leaves: int) -> Column:
    out = F.lit(0).cast("long")
    for k, n in enumerate(range(4, leaves + 1)):
        out = out * edges(n - 1) + places[k]
    return out


def drawn_number(seed: int, key: Column, step: Column, below: Column) -> Column:
    """A number from 0 to below - 1 that depends on seed, key and step alone, not on partitions or order:
    the first 8 hex digits of the md5 of all three, modulo below."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), step.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % below).cast("int")


def random_places(key: Column, leaves: int, seed: int) -> Column:
    """Places of the leaves 4, 5, ... of a random tree for each key, each drawn from all edges."""
    if leaves < 4:
        return F.array().cast("array<int>")
    return F.transform(F.sequence(F.lit(4), F.lit(leaves)), lambda n: drawn_number(seed, key, n, 2 * n - 5))


def random_trees(rows: DataFrame, key: str, leaves: int, seed: int = 0) -> DataFrame:
    """rows with the column tree: for each key a tree, all trees with the leaves being equally likely."""
    return rows.withColumn("tree", from_places(random_places(F.col(key), leaves, seed)))


def interchange_walk(rows: DataFrame, key: str, steps: int, seed: int = 0) -> DataFrame:
    """rows(key, tree, ...) with each tree moved by so many random interchanges, all of a tree's being
    equally likely each time. A tree without one stays."""
    out = rows
    for step in range(1, steps + 1):
        found = out.withColumn("_near", nni("tree"))
        picked = F.element_at("_near", drawn_number(seed, F.col(key), F.lit(-step), F.size("_near")) + 1)
        out = found.withColumn("tree", F.when(F.size("_near") > 0, picked).otherwise(F.col("tree"))).drop("_near")
    return out


def skeleton(tree: Column) -> Column:
    """The brackets of a tree's inner nodes alone: leaves are left out."""
    return F.regexp_replace(tree, r"\(\d+\)", "")
