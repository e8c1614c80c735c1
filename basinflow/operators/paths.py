"""Lowest paths between minima, and direct paths between two structures."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basinflow.operators.forest import depths, doubled, joined_at
from basinflow.operators.graph import cut
from basinflow.operators.landscape import ID


def descent(starts: DataFrame, stepped: DataFrame, most_rounds: int = 60) -> DataFrame:
    """All states on the way down from each start (landscape_id, limb, rank): limb, step, rank. Round k
    knows the state 2 ** k steps below each one, so the number of joins is the logarithm of the longest
    way, and all limbs go on together."""
    jump = cut(stepped.where("down is not null").select(ID, "rank", "down"))
    now = cut(starts.select(ID, "limb", "rank", F.lit(0).cast("long").alias("step")))
    for k in range(most_rounds):
        further = cut(now.join(jump, [ID, "rank"]).select(ID, "limb", F.col("down").alias("rank"), (F.col("step") + 2**k).alias("step")))
        if further.isEmpty():
            return now
        now = now.unionByName(further)
        jump = cut(jump.join(jump.select(ID, F.col("rank").alias("down"), F.col("down").alias("_next")), [ID, "down"]).select(ID, "rank", F.col("_next").alias("down")))
    raise RuntimeError("a descent does not end")


def way_down(stepped: DataFrame, most_rounds: int = 60) -> DataFrame:
    """For all states: the minimum below (its rank) and the steps to it, by pointer doubling: landscape_id,
    rank, basin, steps."""
    now = cut(stepped.select(ID, "rank", F.coalesce("down", "rank").alias("basin"), F.col("down").isNotNull().cast("long").alias("steps")))
    for _ in range(most_rounds):
        below = now.where("steps > 0").select(ID, F.col("rank").alias("basin"), F.col("basin").alias("_next"), F.col("steps").alias("_more"))
        met = cut(now.join(below, [ID, "basin"], "left"))
        now = met.select(ID, "rank", F.coalesce("_next", "basin").alias("basin"), (F.col("steps") + F.coalesce("_more", F.lit(0))).alias("steps"))
        if met.where("_next is not null").isEmpty():
            return now
    raise RuntimeError("a descent does not end")


def merges_of(tree: DataFrame) -> list[DataFrame]:
    """Doubled tables of a forest's merges, whose keys order them by energy and then by the number of the
    minimum, the largest first: (e, k) with k the negative number."""
    key = F.struct(F.col("e_saddle").alias("e"), (-F.col("lmin")).alias("k")).alias("key")
    return doubled(tree.where("father > 0").select(ID, F.col("lmin").alias("node"), F.col("father").alias("up"), key))


def saddles_between(pairs: DataFrame, tree: DataFrame) -> DataFrame:
    """For pairs(landscape_id, a, b, ...) of minima: the highest merge on the way from a to b in the tree, as
    merged (the minimum that it ends; of equal energies the one of smallest number), e_saddle, saddle,
    left_contact and right_contact. All null where there is no way, or a = b. All pairs are looked up at
    once, by ancestors 1, 2, 4, ... merges above."""
    levels = merges_of(tree)
    met = joined_at(pairs, levels, depths(levels)).withColumn("merged", -F.col("key.k")).drop("key", "on_a")
    return met.join(tree.select(ID, F.col("lmin").alias("merged"), "e_saddle", "saddle", "left_contact", "right_contact"), [ID, "merged"], "left")


def saddle_paths(pairs: DataFrame, tree: DataFrame, states: DataFrame, stepped: DataFrame, index: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """For pairs(landscape_id, a, b) of minima: all states of a way from a over the lowest saddles to b.
    Columns landscape_id, a, b, step (from 0), rank, structure, energy and mark (L and number for a minimum,
    S for a saddle, I between). Pairs without a way have no rows.

    A round takes all stretches between two minima that are still open, finds their highest merge, and puts
    in its place the descents from both sides of the saddle and the stretches left over to their minima.
    Places within the way are arrays of numbers, so that all pairs can go on apart and be put in order at
    the end. tree: minima with father, e_saddle, saddle, contacts and rank; index: landscape_id, rank, lmin
    (the minimum below each state)."""
    tree, below = cut(tree.select(ID, "lmin", "rank", "father", "e_saddle", "saddle", "left_contact", "right_contact")), cut(index.select(ID, "rank", "lmin"))
    levels, minima = merges_of(tree), tree.select(ID, F.col("lmin").alias("x"), F.col("rank").alias("at"))
    deep, sides = depths(levels), tree.select(ID, F.col("lmin").alias("merged"), "saddle", "left_contact", "right_contact")
    open_, done = cut(pairs.select(ID, "a", "b").distinct().withColumn("pos", F.array().cast("array<int>")).withColumn("x", F.col("a")).withColumn("y", F.col("b"))), []
    key = [ID, "a", "b"]

    def place(n: int):
        return F.concat("pos", F.array(F.lit(n))).alias("pos")

    for _ in range(most_rounds):
        point = open_.where("x = y").join(minima, [ID, "x"])
        done.append(point.select(*key, "pos", "at", F.lit("point").alias("kind")))
        met = joined_at(open_.where("x <> y"), levels, deep, "x", "y").where("key is not null").withColumn("merged", -F.col("key.k")).join(sides, [ID, "merged"])
        turned = F.col("on_a")  # x lies on the side that was merged
        met = met.select(*key, "pos", "x", "y", "saddle", F.when(turned, F.col("right_contact")).otherwise(F.col("left_contact")).alias("from"), F.when(turned, F.col("left_contact")).otherwise(F.col("right_contact")).alias("to"))
        met = met.join(below.select(ID, F.col("rank").alias("from"), F.col("lmin").alias("first")), [ID, "from"]).join(below.select(ID, F.col("rank").alias("to"), F.col("lmin").alias("last")), [ID, "to"])
        met = cut(met)
        if met.isEmpty():
            break
        done += [met.select(*key, place(1), F.col("from").alias("at"), F.lit("up").alias("kind")), met.select(*key, place(2), F.col("saddle").alias("at"), F.lit("point").alias("kind")), met.select(*key, place(3), F.col("to").alias("at"), F.lit("down").alias("kind"))]
        open_ = cut(met.select(*key, place(0), "x", F.col("first").alias("y")).unionByName(met.select(*key, place(4), F.col("last").alias("x"), "y")))
    else:
        raise RuntimeError("a way does not end")
    pieces = cut(reduce(DataFrame.unionByName, done))
    limbs = descent(pieces.where("kind <> 'point'").select(ID, F.col("at").alias("limb"), F.col("at").alias("rank")).distinct(), stepped)
    walked = pieces.where("kind <> 'point'").join(limbs.select(ID, F.col("limb").alias("at"), "rank", "step"), [ID, "at"]).select(*key, "pos", F.when(F.col("kind") == "up", -F.col("step")).otherwise(F.col("step")).alias("sub"), "rank")
    whole = walked.unionByName(pieces.where("kind = 'point'").select(*key, "pos", F.lit(0).cast("long").alias("sub"), F.col("at").alias("rank")))
    order = Window.partitionBy(*key).orderBy("pos", "sub")
    fresh = whole.withColumn("_before", F.lag("rank").over(order)).where("_before is null or _before <> rank").withColumn("step", F.row_number().over(order) - 1)
    saddles = tree.where("father > 0").select(ID, F.col("saddle").alias("rank")).distinct().withColumn("_is_saddle", F.lit(True))
    named = fresh.join(states.select(ID, "rank", "structure", "energy"), [ID, "rank"]).join(minima.select(ID, F.col("x").alias("_lmin"), F.col("at").alias("rank")), [ID, "rank"], "left").join(saddles, [ID, "rank"], "left")
    mark = F.when(F.col("_lmin").isNotNull(), F.format_string("L%04d", "_lmin")).when(F.col("_is_saddle"), "S").otherwise("I")
    return named.select(*key, "step", "rank", "structure", "energy", mark.alias("mark"))


def saddle_path(tree: DataFrame, states: DataFrame, stepped: DataFrame, index: DataFrame, landscape: str, a: int, b: int) -> DataFrame:
    """saddle_paths() of one pair, in order: step, rank, structure, energy and mark. An error if there is no
    way."""
    own = [x.where(F.col(ID) == landscape) for x in (tree, states, stepped, index)]
    pair = tree.sparkSession.createDataFrame([(landscape, a, b)], f"{ID} string, a long, b long")
    way = cut(saddle_paths(pair, *own))
    if way.isEmpty():
        raise ValueError(f"no path between minima {a} and {b}")
    return way.select("step", "rank", "structure", "energy", "mark").orderBy("step")


def direct_paths(queries: DataFrame, energy: Callable[[str, frozenset], float], most_kept: int = 20, ceiling: float = 99999.0) -> DataFrame:
    """For queries(sequence, start, target): the lowest barrier found among direct paths, on which
    every step removes a pair that only start has or adds one that only target has. A beam of 1, 2, 4,
    ... states is followed from alternating ends, each round below the best barrier so far.
    energy(sequence, pairs) is the caller's model. Columns sequence, start, target, saddle_energy,
    saddle."""
    from basinflow.functions.rna import drawn, pair_list

    def pairs(s: str) -> frozenset:
        return frozenset((i, j) for i, j in enumerate(pair_list(s)) if j > i)

    def picture(found: frozenset, n: int) -> str:
        table = [-1] * n
        for i, j in found:
            table[i], table[j] = j, i
        return drawn(table)

    def crossing(found: frozenset, pair: tuple) -> bool:
        i, j = pair
        return any(i <= k <= j < m or k < i <= m <= j or {i, j} & {k, m} for k, m in found)

    def search(q: str, a: frozenset, b: frozenset, width: int, limit: float):
        beam = [(energy(q, a), energy(q, a), a, a)]
        for _ in range(len(a ^ b)):
            grown = {}
            for top, _, peak, now in beam:
                for pair in (now - b) | (b - now):
                    if pair in now or not crossing(now, pair):
                        new = now ^ {pair}
                        e = energy(q, new)
                        if max(top, e) < limit and (new not in grown or max(top, e) < grown[new][0]):
                            grown[new] = (max(top, e), e, new if e > top else peak, new)
            beam = sorted(grown.values(), key=lambda x: (x[0], x[1], sorted(x[3])))[: width + 1]
            if not beam:
                return None
        return beam[0][0], beam[0][2]

    def run(rows):
        for t in rows:
            out = []
            for q, s, e in zip(t["sequence"], t["start"], t["target"]):
                a, b, best, width = pairs(s), pairs(e), (ceiling, None), 1
                turn = False
                while True:
                    found = search(q, *((b, a) if turn else (a, b)), width, best[0])
                    best = found or best
                    if width >= most_kept:
                        break
                    width, turn = min(2 * width, most_kept), not turn
                out.append((q, s, e, best[0] if best[1] is not None else None, None if best[1] is None else picture(best[1], len(s))))
            yield pd.DataFrame(out, columns=["sequence", "start", "target", "saddle_energy", "saddle"])

    return queries.select("sequence", "start", "target").mapInPandas(run, "sequence string, start string, target string, saddle_energy double, saddle string")


def direct_saddles(queries: DataFrame, energy: Callable[[Column, Column], Column], most_kept: int = 20, ceiling: float = 99999.0) -> DataFrame:
    """What direct_paths() looks for, by tables: for queries(sequence, start, target) the lowest barrier found,
    with columns sequence, start, target, saddle_energy, saddle. energy(sequence, structure) is a native
    expression.

    All queries go on together. A step takes every state of the beams, explodes the pairs that are still to
    be removed or added, keeps what stays a structure and below the query's best barrier so far, merges equal
    states into the one with the lower top, and keeps the best width + 1 of a query. Steps are made from
    alternating ends with beams of 1, 2, 4, ... up to most_kept. Where there are no more states between, the
    barrier is the lowest of all direct paths: such a query is done, and only those whose beam had to leave out
    states go on with a wider one. A state left out is told by a row without structure, which stays to the
    end of the round. Equal queries are one; null structures have no rows."""
    from basinflow.functions.rna import direct_moves, put_pair

    asked = queries.select("sequence", "start", "target").where("sequence is not null and start is not null and target is not null").distinct()
    asked = cut(asked.withColumn("forth", direct_moves(F.col("start"), F.col("target"))).withColumn("back", direct_moves(F.col("target"), F.col("start"))).withColumn("_q", F.monotonically_increasing_id()))
    longest = asked.agg(F.max(F.size("forth"))).first()[0] or 0
    best, open_ = asked.select("_q", F.lit(float(ceiling)).alias("limit"), F.lit(None).cast("string").alias("saddle")), asked
    width, turn = 1, False
    while True:
        begin, moves = ("target", "back") if turn else ("start", "forth")
        rows = open_.join(best.select("_q", "limit"), "_q").select("_q", "sequence", "limit", F.col(begin).alias("now"), F.col(moves).alias("left")).withColumn("top", energy(F.col("sequence"), F.col("now"))).withColumn("peak", F.col("now"))
        for k in range(longest):
            grown = rows.withColumn("m", F.explode_outer("left")).where(F.col("m").isNull() | ~F.col("m.adds") | ~F.arrays_overlap("m.after", F.transform("left", lambda x: x["id"])))
            grown = grown.select("_q", "sequence", "limit", F.when(F.col("m").isNull(), F.col("now")).otherwise(put_pair(F.col("now"), F.col("m.i"), F.col("m.j"), F.col("m.adds"))).alias("now"), F.when(F.col("m").isNull(), F.col("left")).otherwise(F.filter("left", lambda x: x["id"] != F.col("m.id"))).alias("left"), "top", "peak")
            merged = grown.repartition("_q").groupBy("_q", "now").agg(F.min(F.struct("top", "peak")).alias("b"), F.first("sequence").alias("sequence"), F.first("limit").alias("limit"), F.first("left").alias("left"))
            merged = merged.withColumn("e", energy(F.col("sequence"), F.col("now"))).select("_q", "sequence", "limit", "now", "e", "left", F.greatest("b.top", "e").alias("top"), F.when(F.col("e") > F.col("b.top"), F.col("now")).otherwise(F.col("b.peak")).alias("peak"))
            place = F.row_number().over(Window.partitionBy("_q").orderBy(F.col("now").isNull(), "top", "e", "now"))
            kept = merged.where(F.col("now").isNull() | (F.col("top") < F.col("limit"))).withColumn("_place", place).where(F.col("_place") <= width + 2)
            over = F.col("_place") == width + 2
            rows = kept.select("_q", "sequence", "limit", F.when(~over, F.col("now")).alias("now"), F.when(over, F.slice("left", 1, 0)).otherwise(F.col("left")).alias("left"), F.when(over, F.lit(float("inf"))).otherwise(F.col("top")).alias("top"), "peak")
            if k % 8 == 7:
                rows = cut(rows)
        rows = cut(rows)
        found = rows.where((F.size("left") == 0) & F.col("now").isNotNull() & (F.col("top") < F.col("limit"))).groupBy("_q").agg(F.min(F.struct("top", "peak")).alias("b"))
        best = cut(best.join(found, "_q", "left").select("_q", F.coalesce("b.top", "limit").alias("limit"), F.coalesce("b.peak", "saddle").alias("saddle")))
        open_ = cut(open_.join(rows.where("now is null").select("_q").distinct(), "_q", "left_semi"))
        if width >= most_kept or open_.isEmpty():
            return asked.join(best, "_q").select("sequence", "start", "target", F.when(F.col("saddle").isNotNull(), F.col("limit")).alias("saddle_energy"), "saddle")
        width, turn = min(2 * width, most_kept), not turn


def gradient_walk(queries: DataFrame, energy: Callable[[str, str], float]) -> DataFrame:
    """For queries(sequence, structure): the end of the steepest descent by insertions and deletions of
    pairs under the caller's energy(sequence, structure). Columns sequence, structure, minimum."""
    from basinflow.functions.rna import neighbours

    def down(q: str, s: str) -> str:
        e = energy(q, s)
        while True:
            low, best = min(((energy(q, x), x) for x, _ in neighbours(q, s, second=True)), default=(e, s))
            if low >= e:
                return s
            e, s = low, best

    def run(rows):
        for t in rows:
            yield t.assign(minimum=[None if q is None or s is None else down(q, s) for q, s in zip(t["sequence"], t["structure"])])

    return queries.select("sequence", "structure").mapInPandas(run, "sequence string, structure string, minimum string")


def joined_roots(minima: DataFrame, sequence: str, energy: Callable[[str, frozenset], float], most_kept: int = 20) -> DataFrame:
    """Minima of a tree of several roots with the roots joined by the lowest direct paths to minima of
    smaller number: landscape_id, lmin, father, e_saddle and saddle (of new merges). Paths are searched as
    rows; merges by the new and the old saddles then follow the elder rule. minima: landscape_id, lmin,
    structure, father, e_saddle, of a table cut to a number of minima."""
    seen = minima.select(ID, F.col("lmin").alias("low"), F.col("structure").alias("target"))
    pairs = minima.where("father = 0 and lmin > 1").select(ID, "lmin", F.col("structure").alias("start")).join(seen, ID).where("low < lmin").withColumn("sequence", F.lit(sequence))
    found = direct_paths(pairs.select("sequence", "start", "target").distinct(), energy, most_kept).where("saddle is not null")
    new = pairs.join(found, ["sequence", "start", "target"]).select(ID, "lmin", F.col("low").alias("other"), F.col("saddle_energy").alias("level"), "saddle")
    old = minima.where("father > 0").select(ID, "lmin", F.col("father").alias("other"), F.col("e_saddle").alias("level"), F.lit(None).cast("string").alias("saddle"))

    def merge(t: pd.DataFrame) -> pd.DataFrame:
        father, out = {}, []

        def root(i):
            while i in father:
                i = father[i]
            return i

        for r in t.sort_values(["level", "lmin", "other"], kind="stable").itertuples():
            a, b = sorted((root(r.lmin), root(r.other)))
            if a != b:
                father[b] = a
                out.append((getattr(r, ID), b, a, r.level, r.saddle))
        return pd.DataFrame(out, columns=[ID, "lmin", "father", "e_saddle", "saddle"])

    merged = new.unionByName(old).groupBy(ID).applyInPandas(merge, f"{ID} string, lmin long, father long, e_saddle double, saddle string")
    return minima.select(ID, "lmin", "structure", F.col("e_saddle").alias("_top")).join(merged, [ID, "lmin"], "left").select(ID, "lmin", "structure", F.coalesce("father", F.lit(0)).alias("father"), F.coalesce("e_saddle", "_top").alias("e_saddle"), "saddle")
