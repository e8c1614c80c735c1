"""Questions to forests of merges for many nodes at once: ancestors by doubling, the merge that joins two nodes,
sums over subtrees, and the forest itself from edges in an order.

A forest is a table (landscape_id, node, up, key): each node that is not a root has the node it was merged into
and the key of that merge; keys never fall on the way to the root. Doubled tables hold, for each node, the
ancestor 2 ** k above and the greatest key on the way there. All operators take many landscapes together; the
number of joins is the logarithm of the greatest depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinflow.operators.graph import chase, cut

ID = "landscape_id"


def doubled(forest: DataFrame, most_rounds: int = 60) -> list[DataFrame]:
    """Tables (landscape_id, node, up, key) of the ancestors 1, 2, 4, ... above, with the greatest key on the
    way; the last one is empty."""
    out = [cut(forest.select(ID, "node", "up", "key"))]
    while not out[-1].isEmpty():
        if len(out) > most_rounds:
            raise RuntimeError("merges form a cycle")
        now = out[-1]
        above = now.select(ID, F.col("node").alias("up"), F.col("up").alias("_up"), F.col("key").alias("_key"))
        out.append(cut(now.join(above, [ID, "up"]).select(ID, "node", F.col("_up").alias("up"), F.greatest("key", "_key").alias("key"))))
    return out


def climbed(rows: DataFrame, levels: list[DataFrame], at: str, goes: Column | None = None, steps: str | None = None) -> DataFrame:
    """rows with the node in the column `at` replaced by the furthest ancestor that all merges on the way
    allow: those for which goes holds, a condition on the merge's key (the column key) and the columns
    of rows; without one, the root. steps: a column with the number of merges on the way."""
    out = rows.withColumn(steps, F.lit(0).cast("long")) if steps else rows
    for k in reversed(range(len(levels) - 1)):
        hop = levels[k].select(ID, F.col("node").alias(at), F.col("up").alias("_up"), "key")
        out = out.join(hop, [ID, at], "left")
        moves = F.col("_up").isNotNull() & (goes if goes is not None else F.lit(True))
        if steps:
            out = out.withColumn(steps, F.col(steps) + F.when(moves, 2**k).otherwise(0))
        out = out.withColumn(at, F.when(moves, F.col("_up")).otherwise(F.col(at))).drop("_up", "key")
    return out


def depths(levels: list[DataFrame]) -> DataFrame:
    """Root and depth of every node of a forest: landscape_id, node, root, depth."""
    nodes = levels[0].select(ID, "node").unionByName(levels[0].select(ID, F.col("up").alias("node"))).distinct()
    return cut(climbed(nodes.withColumn("root", F.col("node")), levels, "root", steps="depth").select(ID, "node", "root", "depth"))


def joined_at(pairs: DataFrame, levels: list[DataFrame], deep: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """pairs (landscape_id, a, b, ...) with the greatest key on the way from a to b in the forest, as the column
    key, and on_a, whether it lies between a and where their ways meet: null if they have different roots or
    are the same node. deep: depths() of the forest.

    The deeper node is lifted by the difference of the depths, bit by bit; then both are lifted by 2 ** k as long
    as they do not meet, and by one at last."""
    none, out = F.lit(None).cast(levels[0].schema["key"].dataType), pairs
    for side in (a, b):
        out = out.join(deep.select(ID, F.col("node").alias(side), F.col("root").alias(f"_root_{side}"), F.col("depth").alias(f"_deep_{side}")), [ID, side], "left")
    live, first = (F.col(f"_root_{a}") == F.col(f"_root_{b}")) & (F.col(a) != F.col(b)), F.col(f"_deep_{a}") >= F.col(f"_deep_{b}")
    out = out.withColumn("_first", first).withColumn("_u", F.when(live, F.when(first, F.col(a)).otherwise(F.col(b)))).withColumn("_v", F.when(live, F.when(first, F.col(b)).otherwise(F.col(a))))
    out = out.withColumn("_lift", F.abs(F.col(f"_deep_{a}") - F.col(f"_deep_{b}"))).withColumn("_key_u", none).withColumn("_key_v", none).drop(*(f"_{x}_{side}" for x in ("root", "deep") for side in (a, b)))

    def hop(rows: DataFrame, k: int, moves: Column, sides: str) -> DataFrame:
        for x in sides:
            rows = rows.join(levels[k].select(ID, F.col("node").alias(f"_{x}"), F.col("up").alias(f"_up_{x}"), F.col("key").alias(f"_by_{x}")), [ID, f"_{x}"], "left")
        rows = rows.withColumn("_go", F.coalesce(moves, F.lit(False)))
        for x in sides:
            rows = rows.withColumn(f"_{x}", F.when(F.col("_go"), F.col(f"_up_{x}")).otherwise(F.col(f"_{x}"))).withColumn(f"_key_{x}", F.when(F.col("_go"), F.greatest(f"_key_{x}", f"_by_{x}")).otherwise(F.col(f"_key_{x}")))
        return rows.drop("_go", *(f"_{part}_{x}" for part in ("up", "by") for x in sides))

    last = len(levels) - 1
    for k in range(last):
        out = hop(out, k, F.shiftright("_lift", k).bitwiseAND(1) == 1, "u")
    for k in reversed(range(last)):
        out = hop(out, k, (F.col("_u") != F.col("_v")) & (F.col("_up_u") != F.col("_up_v")), "uv")
    if last:
        out = hop(out, 0, F.col("_u") != F.col("_v"), "uv")
    on_u = F.col("_key_v").isNull() | F.coalesce(F.col("_key_u") > F.col("_key_v"), F.lit(False))
    key = F.greatest("_key_u", "_key_v")
    return out.withColumn("key", key).withColumn("on_a", F.when(key.isNotNull(), on_u == F.col("_first"))).drop("_first", "_u", "_v", "_lift", "_key_u", "_key_v")


def subtree_sums(values: DataFrame, levels: list[DataFrame], *columns: str) -> DataFrame:
    """values (landscape_id, node and columns) with each column summed over the node and all below it. A
    round adds, to the sum over the nodes less than 2 ** k below, the sums of those 2 ** k below."""
    now = cut(values.select(ID, "node", *columns))
    for level in levels[:-1]:
        lower = now.join(level.select(ID, "node", "up"), [ID, "node"]).groupBy(ID, F.col("up").alias("node")).agg(*(F.sum(c).alias(f"_{c}") for c in columns))
        now = cut(now.join(lower, [ID, "node"], "left").select(ID, "node", *((F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in columns)))
    return now


def summed_up(rows: DataFrame, value: str, most_rounds: int = 60) -> DataFrame:
    """rows(landscape_id, node, up, value), up null for roots: the sum of the values of the node and of all its
    ancestors, by pointer doubling. landscape_id, node, value."""
    now = cut(rows.select(ID, "node", "up", value))
    for _ in range(most_rounds):
        if now.where("up is not null").isEmpty():
            return now.select(ID, "node", value)
        above = now.select(ID, F.col("node").alias("up"), F.col("up").alias("_up"), F.col(value).alias("_value"))
        now = cut(now.join(above, [ID, "up"], "left").select(ID, "node", F.col("_up").alias("up"), (F.col(value) + F.coalesce("_value", F.lit(0))).alias(value)))
    raise RuntimeError("merges form a cycle")


def elder_forest(edges: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """The forest of merges of edges (landscape_id, a, b, key) taken in ascending order of their keys, where
    the smallest node of what an edge joins stays its root: node, up (the root after all edges of that key)
    and key (of the edge by which the node ceased to be a root).

    A round looks, for every set of joined nodes, at its outgoing edges of the lowest key. If one leads to a
    set with a smaller root, that is where the set's own root ceases to be one, whatever happens elsewhere,
    and the set is added to the other. Otherwise it waits, as the other ends no later. The lowest edge of
    all is never waited for. At last each node's way through the sets is cut short to the first
    node that outlived it."""
    now = cut(edges.where("a <> b").groupBy(ID, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("key").alias("key")))
    gone: DataFrame | None = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(ID, F.col("b").alias("a"), F.col("a").alias("b"), "key"))
        low = both.groupBy(ID, "a").agg(F.min(F.struct("key", "b")).alias("m"))
        dying = cut(low.where("m.b < a").select(ID, F.col("a").alias("node"), F.col("m.b").alias("up"), F.col("m.key").alias("key")))
        if dying.isEmpty():
            break
        gone = dying if gone is None else gone.unionByName(dying)
        ends = dying.select(ID, F.col("up").alias("node")).distinct().join(dying, [ID, "node"], "left_anti").select(ID, "node", F.lit(None).cast("long").alias("parent"))
        tops = chase(dying.select(ID, "node", F.col("up").alias("parent")).unionByName(ends), [ID])
        for side in ("a", "b"):
            now = now.join(tops.select(ID, F.col("node").alias(side), F.col("top").alias("_top")), [ID, side], "left").withColumn(side, F.coalesce("_top", side)).drop("_top")
        now = cut(now.where("a <> b").groupBy(ID, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("key").alias("key")))
    if gone is None:
        return now.select(ID, F.col("a").alias("node"), F.col("b").alias("up"), "key").limit(0)
    return outlived(cut(gone))


def outlived(forest: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """The forest with each node's up replaced by its first ancestor with a greater key (or none)."""
    now = forest
    for _ in range(most_rounds):
        above = now.select(ID, F.col("node").alias("up"), F.col("up").alias("_up"), F.col("key").alias("_key"))
        step = cut(now.join(above, [ID, "up"], "left").withColumn("_go", F.coalesce(F.col("_key") <= F.col("key"), F.lit(False))).select(ID, "node", F.when(F.col("_go"), F.col("_up")).otherwise(F.col("up")).alias("up"), "key", "_go"))
        moved = not step.where("_go").isEmpty()
        now = step.drop("_go")
        if not moved:
            return now
    raise RuntimeError("merges form a cycle")
