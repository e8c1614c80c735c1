"""Discrete energy landscapes as tables.

states: landscape_id, rank (dense from 1 in ascending energy), structure, energy and, for several
objectives, pov (array of numbers). edges: landscape_id, n, m, e_n, e_m with m < n; each undirected
edge once, seen from its later end. All operators work on many landscapes at once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basinflow.operators.forest import climbed, doubled, elder_forest, subtree_sums
from basinflow.operators.graph import chase, connected_components, cut, rank_within

ID = "landscape_id"
#: Gas constant in kcal/(mol K); zero of the Celsius scale.
GAS, ZERO = 0.00198717, 273.15


def kt(temperature: float | None = None, rna: bool = False) -> float:
    """RNA: R (T + 273.15) with 37 as default; other landscapes: T itself, 1 as default."""
    if rna:
        return GAS * (ZERO + (37.0 if temperature is None else temperature))
    return 1.0 if temperature is None else temperature


def ranked(states: DataFrame, *ties: str) -> DataFrame:
    """states with a dense rank by energy, then the given columns. A landscape is ranked by as many
    tasks as its rows need."""
    return rank_within(states, [ID], ["energy", *(ties or ("structure",))], "rank")


def validated(states: DataFrame) -> DataFrame:
    """states, with an error at run time for a rank against the energies or a structure that occurs
    twice. (A scan that finds the input unsorted cannot go on; nor can one whose keys are ambiguous.)
    Each state is compared with the one of the rank before, by a join."""
    before = states.select(ID, (F.col("rank") + 1).alias("rank"), F.col("energy").alias("_low"))
    doubled = states.groupBy(ID, "structure").agg(F.count("*").alias("_n")).where("_n > 1")
    checked = states.join(before, [ID, "rank"], "left").join(doubled, [ID, "structure"], "left")
    energy = F.when(F.col("_low") > F.col("energy"), F.raise_error(F.concat(F.lit("unsorted list at rank "), F.col("rank")))).when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate structure "), F.col("structure")))).otherwise(F.col("energy"))
    return checked.withColumn("energy", energy).select(states.columns)


def look_back_edges(states: DataFrame, moves: Callable[[Column], Column], poset: bool = False) -> DataFrame:
    """Edges to neighbours of smaller rank: the move set's strings joined to the stored ones.

    moves maps the structure column to an array of neighbouring structures. poset: keep an edge only
    if no objective of the lower end is worse (pov of m <= pov of n in each component).
    """
    extra = ["pov"] if poset else []
    probe = states.select(ID, F.col("rank").alias("n"), F.col("energy").alias("e_n"), *(F.col(c).alias("_pn") for c in extra), F.explode(moves(F.col("structure"))).alias("structure"))
    build = states.select(ID, "structure", F.col("rank").alias("m"), F.col("energy").alias("e_m"), *(F.col(c).alias("_pm") for c in extra))
    met = probe.join(build, [ID, "structure"]).where("m < n")
    if poset:
        met = met.where(F.forall(F.zip_with("_pm", "_pn", lambda a, b: a <= b), lambda x: x))
    return met.select(ID, "n", "m", "e_n", "e_m").distinct()


def steps(states: DataFrame, edges: DataFrame) -> DataFrame:
    """Per state: down (lowest neighbour by rank, null for a minimum) and is_min (no neighbour of
    lower energy)."""
    seen = edges.groupBy(ID, F.col("n").alias("rank")).agg(F.min("m").alias("down"), F.bool_or(F.col("e_m") < F.col("e_n")).alias("_lower"))
    out = states.join(seen, [ID, "rank"], "left").withColumn("is_min", ~F.coalesce("_lower", F.lit(False)))
    return out.withColumn("down", F.when(~F.col("is_min"), F.col("down"))).drop("_lower")


def numbered_minima(stepped: DataFrame) -> DataFrame:
    """Minima with their index in order of energy: landscape_id, lmin, rank, structure, energy."""
    extra = [c for c in ("pov",) if c in stepped.columns]
    return rank_within(stepped.where("is_min").select(ID, "rank", "structure", "energy", *extra).withColumnRenamed("rank", "_r"), [ID], ["_r"], "lmin").select(ID, "lmin", F.col("_r").alias("rank"), "structure", "energy", *extra)


def gradient_basins(stepped: DataFrame) -> DataFrame:
    """Rank of the minimum at the end of each state's descent: landscape_id, rank, basin."""
    return chase(stepped.select(ID, F.col("rank").alias("node"), F.col("down").alias("parent")), [ID]).select(ID, F.col("node").alias("rank"), F.col("top").alias("basin"))


def ground(states: DataFrame) -> DataFrame:
    return states.groupBy(ID).agg(F.min("energy").alias("mfe"))


def weight(energy: Column, mfe: Column, kt: float) -> Column:
    return F.exp((mfe - energy) / F.lit(kt))


def basin_statistics(states: DataFrame, basins: DataFrame, kt: float = 1.0) -> DataFrame:
    """Per basin: size, zg (partition sum relative to the ground state) and free_energy."""
    joined = states.select(ID, "rank", "energy").join(basins, [ID, "rank"]).join(ground(states), ID)
    out = joined.groupBy(ID, "basin").agg(F.count("*").alias("size"), F.sum(weight(F.col("energy"), F.col("mfe"), kt)).alias("zg"), F.min("mfe").alias("mfe"))
    return out.withColumn("free_energy", F.col("mfe") - F.lit(kt) * F.log("zg")).drop("mfe")


def energy_bands(states: DataFrame) -> DataFrame:
    return states.groupBy(ID, "energy").agg(F.count("*").alias("size"))


def plateau_components(states: DataFrame, edges: DataFrame) -> DataFrame:
    """Components of states of equal energy: landscape_id, rank, comp (its smallest rank). Every
    state appears; alone if it has no neighbour of its own energy."""
    parts = connected_components(edges.where("e_n = e_m").select(ID, F.col("n").alias("src"), F.col("m").alias("dst")), [ID])
    return states.select(ID, "rank").join(parts.withColumnRenamed("node", "rank"), [ID, "rank"], "left").select(ID, "rank", F.coalesce("component", "rank").alias("comp"))


def component_basins(states: DataFrame, edges: DataFrame, stepped: DataFrame, basins: DataFrame, components: DataFrame) -> DataFrame:
    """Per plateau component: energy, size (its states that are no minima) and the basins (by index)
    of its states and of their lower neighbours, each with a contact state."""
    minima = numbered_minima(stepped).select(ID, F.col("rank").alias("basin"), "lmin")
    index = basins.join(minima, [ID, "basin"]).select(ID, "rank", "lmin")
    own = components.join(index, [ID, "rank"]).select(ID, "comp", "lmin", F.col("rank").alias("contact"))
    below = edges.where("e_m < e_n").join(components.withColumnRenamed("rank", "n"), [ID, "n"]).join(index.withColumnRenamed("rank", "m"), [ID, "m"]).select(ID, "comp", "lmin", F.col("m").alias("contact"))
    touched = own.unionByName(below).groupBy(ID, "comp", "lmin").agg(F.min("contact").alias("contact"))
    sizes = components.join(stepped.select(ID, "rank", "energy", "is_min"), [ID, "rank"]).groupBy(ID, "comp").agg(F.min("energy").alias("energy"), F.sum(F.when(F.col("is_min"), 0).otherwise(1)).alias("size"))
    return sizes.join(touched.groupBy(ID, "comp").agg(F.array_sort(F.collect_list(F.struct("lmin", "contact"))).alias("basins")), [ID, "comp"])


def joining(components: DataFrame) -> DataFrame:
    """The components that can merge basins: at least two basins, and of some pair of them it is a
    lowest meeting. What is left out only meets basins that lower components have joined already,
    so the merge tree is the same, from about as many rows as there are pairs of adjacent basins."""
    many = components.where(F.size("basins") > 1)
    ids = F.transform("basins", lambda b: b["lmin"])
    hub = many.select(ID, "comp", "energy", F.explode(F.slice(ids, 2, F.size(ids))).alias("b"), ids[0].alias("a"))
    first = hub.groupBy(ID, "a", "b").agg(F.min("energy").alias("energy"))
    return many.join(hub.join(first, [ID, "a", "b", "energy"]).select(ID, "comp").distinct(), [ID, "comp"], "left_semi")


TREE = f"{ID} string, lmin long, father long, e_saddle double, saddle long, left_contact long, right_contact long"


def replay(rows: pd.DataFrame) -> pd.DataFrame:
    """Merges of one landscape in ascending bands. Within a band, components are taken in the order of
    their basins' roots when the band began; the smallest index survives."""
    father: dict[int, int] = {}

    def root(i):
        while i in father:
            i = father[i]
        return i

    out = []
    for energy, band in rows.sort_values("energy", kind="stable").groupby("energy", sort=True):
        todo = sorted((sorted({root(b["lmin"]) for b in basins}), comp, basins) for comp, basins in zip(band["comp"], (list(x) for x in band["basins"])))
        for _, comp, basins in todo:
            contact: dict[int, int] = {}
            for b in basins:
                r = root(b["lmin"])
                contact[r] = min(b["contact"], contact.get(r, b["contact"]))
            first, *rest = sorted(contact)
            for r in rest:
                father[r] = first
                out.append((rows[ID].iloc[0], r, first, float(energy), comp, contact[first], contact[r]))
    return pd.DataFrame(out, columns=[ID, "lmin", "father", "e_saddle", "saddle", "left_contact", "right_contact"])


def ids_of(basins: str = "basins") -> Column:
    return F.transform(basins, lambda b: b["lmin"])


def star(rows: DataFrame, ids: str, key: str) -> DataFrame:
    """Edges (a, b, key) from the first of each row's nodes to all others."""
    return rows.select(ID, F.explode(F.slice(ids, 2, F.size(ids))).alias("b"), F.col(ids)[0].alias("a"), F.col(key).alias("key"))


def turns(rows: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """For rows (landscape_id, energy, ids) of basins that meet at an energy: roots, the sorted roots of the
    basins when the band of that energy begins, and turn, the place of (energy, roots) in the landscape's
    order of merging. levels: the doubled forest of the landscape's merges by energy."""
    distinct = cut(rows.select(ID, "energy", "ids").distinct())
    began = climbed(distinct.select(ID, "energy", "ids", F.explode("ids").alias("at")), levels, "at", F.col("key") < F.col("energy"))
    rooted = cut(began.groupBy(ID, "energy", "ids").agg(F.array_sort(F.collect_set("at")).alias("roots")))
    order = rank_within(rooted.select(ID, "energy", "roots").distinct(), [ID], ["energy", "roots"], "turn")
    return cut(rooted.join(order, [ID, "energy", "roots"]).select(ID, "energy", "ids", "roots", "turn"))


def contracted(rows: DataFrame) -> DataFrame:
    """What replay() gives, of landscapes of any size and without a task that sees a whole one.

    The forest of merges by energy alone says which roots a band begins with; with these, components
    have their order of merging, and a second forest, by that order, has each minimum's father and turn.
    Of the components of one turn the first does the merging; its basins' roots just before that turn
    say on which side each contact lies."""
    rows = cut(rows.withColumn("ids", ids_of()))
    timed = cut(rows.join(turns(rows, doubled(elder_forest(star(rows, "ids", "energy")))), [ID, "energy", "ids"]).where(F.size("roots") > 1))
    firsts = cut(timed.groupBy(ID, "turn").agg(F.min("comp").alias("comp")).join(timed.drop("turn"), [ID, "comp"]))
    merged = cut(elder_forest(star(firsts, "roots", "turn")))
    used = firsts.join(merged.select(ID, F.col("key").alias("turn")).distinct(), [ID, "turn"])
    sides = climbed(used.select(ID, "turn", F.explode("basins").alias("b")).select(ID, "turn", F.col("b.lmin").alias("at"), F.col("b.contact").alias("contact")), doubled(merged), "at", F.col("key") < F.col("turn"))
    contacts = cut(sides.groupBy(ID, "turn", "at").agg(F.min("contact").alias("contact")))
    of = lambda node, name: contacts.select(ID, "turn", F.col("at").alias(node), F.col("contact").alias(name))
    out = merged.select(ID, F.col("node").alias("lmin"), F.col("up").alias("father"), F.col("key").alias("turn")).join(used.select(ID, "turn", F.col("energy").alias("e_saddle"), F.col("comp").alias("saddle")), [ID, "turn"])
    return out.join(of("father", "left_contact"), [ID, "turn", "father"]).join(of("lmin", "right_contact"), [ID, "turn", "lmin"]).select(ID, "lmin", "father", "e_saddle", "saddle", "left_contact", "right_contact")


def merge_tree(components: DataFrame, replayed: int | None = None) -> DataFrame:
    """Father and saddle of every minimum that is merged: one row each. As a rule a
    task replays a landscape. With `replayed`, landscapes of more joining components than that are contracted
    by joins, which is meant to give the same and is not verified yet."""
    if replayed is None:
        return cut(joining(components).select(ID, "comp", "energy", "basins")).groupBy(ID).applyInPandas(replay, TREE)
    most = replayed
    rows = cut(joining(components).select(ID, "comp", "energy", "basins"))
    large = cut(rows.groupBy(ID).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(ID))
    small = rows if (none := large.isEmpty()) else rows.join(large, ID, "left_anti")
    out = small.groupBy(ID).applyInPandas(replay, TREE)
    return out if none else out.unionByName(contracted(rows.join(large, ID, "left_semi")))


def forest(minima: DataFrame, tree: DataFrame, states: DataFrame, top: float = 1e-6) -> DataFrame:
    """All minima with father (0 for a root) and e_saddle (a root: last energy + top)."""
    last = states.groupBy(ID).agg(F.max("energy").alias("_last"))
    out = minima.join(tree, [ID, "lmin"], "left").join(last, ID)
    return out.withColumn("e_saddle", F.coalesce("e_saddle", F.col("_last") + F.lit(top))).withColumn("father", F.coalesce("father", F.lit(0)).cast("long")).withColumn("barrier", F.col("e_saddle") - F.col("energy")).drop("_last")


def component_roots(tree: DataFrame) -> DataFrame:
    """Root of each minimum's tree: landscape_id, lmin, root."""
    return chase(tree.select(ID, F.col("lmin").alias("node"), F.when(F.col("father") > 0, F.col("father")).alias("parent")), [ID]).select(ID, F.col("node").alias("lmin"), F.col("top").alias("root"))


def holders(tree: DataFrame, components: DataFrame, rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """For rows (landscape_id, energy, ids) of basins that meet at an energy: node, the root that they have
    when their turn has come, which is the first ancestor, from their smallest root when the band began,
    that is merged later. Also the doubled forest of merges by turn."""
    merges = cut(tree.where("father > 0").select(ID, "lmin", "father", "e_saddle", "saddle"))
    order = turns(rows, doubled(merges.select(ID, F.col("lmin").alias("node"), F.col("father").alias("up"), F.col("e_saddle").alias("key"))))
    saddles = merges.join(components.select(ID, F.col("comp").alias("saddle"), "energy", ids_of().alias("ids")), [ID, "saddle"]).join(order, [ID, "energy", "ids"])
    levels = doubled(saddles.select(ID, F.col("lmin").alias("node"), F.col("father").alias("up"), F.col("turn").alias("key")))
    return climbed(order.select(ID, "energy", "ids", "turn", F.col("roots")[0].alias("node")), levels, "node", F.col("key") <= F.col("turn")).select(ID, "energy", "ids", "node"), levels


def pools(tree: DataFrame, components: DataFrame, states: DataFrame, kt: float = 1.0) -> DataFrame:
    """Per minimum: pool (states that its valley holds when it is merged, or at the end) and z (their
    partition sum). A component's states count for its holder; a valley then holds what counts for any
    minimum below it in the tree of merges."""
    low = ground(states)
    base = components.join(low, ID).select(ID, "energy", ids_of().alias("ids"), "size", (F.col("size") * weight(F.col("energy"), F.col("mfe"), kt)).alias("w"))
    sums = cut(base.groupBy(ID, "energy", "ids").agg(F.sum("size").alias("size"), F.sum("w").alias("w")))
    held, levels = holders(tree, components, sums)
    own = tree.join(low, ID).select(ID, F.col("lmin").alias("node"), F.lit(1).cast("long").alias("size"), weight(F.col("energy"), F.col("mfe"), kt).alias("w"))
    each = sums.join(held, [ID, "energy", "ids"]).select(ID, "node", "size", "w").unionByName(own).groupBy(ID, "node").agg(F.sum("size").alias("pool"), F.sum("w").alias("z"))
    return subtree_sums(each, levels, "pool", "z").withColumnRenamed("node", "lmin")


def flooded_basins(tree: DataFrame, components: DataFrame, parts: DataFrame) -> DataFrame:
    """The basin by merging of every state: a minimum's own, else the holder of the state's plateau component
    (parts, see plateau_components()). landscape_id, rank, basin."""
    rows = components.select(ID, "comp", "energy", ids_of().alias("ids"))
    held, _ = holders(tree, components, rows.select(ID, "energy", "ids"))
    own = tree.select(ID, "rank", "lmin")
    return parts.join(rows.join(held, [ID, "energy", "ids"]).select(ID, "comp", "node"), [ID, "comp"]).join(own, [ID, "rank"], "left").select(ID, "rank", F.coalesce("lmin", "node").alias("basin"))


def ground_roots(tree: DataFrame, roots: DataFrame, ligand: bool) -> DataFrame:
    """landscape_id and root of the ground state's tree, that of minimum 1; with ligands, of the lowest
    bound and of the lowest unbound root."""
    if not ligand:
        return tree.select(ID).distinct().withColumn("root", F.lit(1).cast("long"))
    tops = roots.select(ID, F.col("root").alias("lmin")).distinct().join(tree.select(ID, "lmin", "energy", F.col("structure").endswith("*").alias("_bound")), [ID, "lmin"])
    return tops.groupBy(ID, "_bound").agg(F.min(F.struct("energy", "lmin")).alias("_low")).select(ID, F.col("_low.lmin").alias("root"))


def true_minima(tree: DataFrame, minh: float = 1e-6, most: int = 0, connected: bool = False, epsilon: float = 1.1920928955078125e-07, ligand: bool = False) -> DataFrame:
    """Minima at least minh deep (and, with connected, in the tree of the ground state, see
    ground_roots()), numbered from 1 by energy; at most `most` of them (0: all). A landscape's only minimum
    is always true."""
    alone = tree.groupBy(ID).agg((F.count("*") == 1).alias("_alone"))
    good = tree.join(alone, ID)
    good = good.where(F.col("_alone") | (F.col("barrier") - F.lit(minh) + F.lit(epsilon) >= 0)).drop("_alone")
    if connected:
        roots = component_roots(tree)
        held = good.join(roots, [ID, "lmin"])
        good = held.join(ground_roots(tree, held.select(ID, "root"), ligand), [ID, "root"], "left_semi").drop("root")
    out = rank_within(good, [ID], ["lmin"], "true_id")
    return out.where(F.col("true_id") <= most) if most else out


def folded(tree: DataFrame, true: DataFrame) -> DataFrame:
    """The true minimum that each minimum counts for: itself or its nearest true ancestor; minima
    without one do not appear. landscape_id, lmin, true_id."""
    ids = true.select(ID, "lmin", "true_id")
    links = tree.select(ID, "lmin", "father").join(ids, [ID, "lmin"], "left")
    tops = chase(links.select(ID, F.col("lmin").alias("node"), F.when(F.col("true_id").isNull() & (F.col("father") > 0), F.col("father")).alias("parent")), [ID])
    return tops.select(ID, F.col("node").alias("lmin"), F.col("top")).join(ids.withColumnRenamed("lmin", "top"), [ID, "top"]).select(ID, "lmin", "true_id")


#: Rows of a chunk or of a tile side of the Pareto comparison.
CHUNK = 2048


def dominated(order: np.ndarray, pov: np.ndarray, by_order: np.ndarray, by_pov: np.ndarray) -> np.ndarray:
    """Rows for which one of the other rows comes earlier and is smaller in every objective."""
    out = np.zeros(len(order), bool)
    for k in range(0, len(order), 256):
        worse = by_order[None, :] < order[k : k + 256, None]
        for c in range(pov.shape[1]):
            worse &= by_pov[None, :, c] < pov[k : k + 256, c, None]
        out[k : k + 256] = worse.any(1)
    return out


def pareto_flags(minima: DataFrame, order: str = "lmin", pov: str = "pov") -> DataFrame:
    """minima with is_global: no earlier minimum is smaller in every objective.

    Being beaten is transitive, so rows that are beaten within a chunk of bounded size are set aside
    first, and only the others are compared in full, tile by tile. No pair of rows is ever emitted.
    """
    minima = cut(minima)
    rows = minima.select(ID, F.col(order).cast("double").alias("_o"), F.col(pov).cast("array<double>").alias("_p"))
    schema = f"{ID} string, _o double, _p array<double>"

    def within(t: pd.DataFrame) -> pd.DataFrame:
        p = np.array(t["_p"].tolist(), float).reshape(len(t), -1)
        o = t["_o"].to_numpy()
        return t.loc[~dominated(o, p, o, p), [ID, "_o", "_p"]]

    def across(t: pd.DataFrame) -> pd.DataFrame:
        p, o, side = np.array(t["_p"].tolist(), float).reshape(len(t), -1), t["_o"].to_numpy(), t["_side"].to_numpy()
        lost = np.zeros(len(t), bool)
        for mine, other in ((side <= 1, side != 1), (side == 2, side == 1)):
            lost[mine] |= dominated(o[mine], p[mine], o[other], p[other])
        return t.loc[lost, [ID, "_o"]]

    counts = rows.groupBy(ID).agg(F.ceil(F.count("*") / CHUNK).cast("long").alias("_cuts"))
    left = cut(rows.join(counts, ID).withColumn("_own", F.pmod(F.xxhash64("_o"), "_cuts")).groupBy(ID, "_own").applyInPandas(within, schema))
    counts = left.groupBy(ID).agg(F.ceil(F.count("*") / CHUNK).cast("long").alias("_cuts"))
    dealt = left.join(counts, ID).withColumn("_own", F.pmod(F.xxhash64("_o"), "_cuts")).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_cuts") - 1)))
    tiles = dealt.select(ID, "_o", "_p", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), F.when(F.col("_own") == F.col("_other"), 0).when(F.col("_own") < F.col("_other"), 1).otherwise(2).alias("_side"))
    lost = tiles.groupBy(ID, "_i", "_j").applyInPandas(across, f"{ID} string, _o double").distinct()
    best = left.select(ID, "_o").join(lost, [ID, "_o"], "left_anti").withColumn("is_global", F.lit(True))
    return minima.withColumn("_o", F.col(order).cast("double")).join(best, [ID, "_o"], "left").drop("_o").withColumn("is_global", F.coalesce("is_global", F.lit(False)))


def rates(states: DataFrame, edges: DataFrame, labels: DataFrame, kt: float = 1.0, double_moves: Column | None = None) -> DataFrame:
    """Transition rates between labelled basins: landscape_id, i, j, rate, from every edge in both
    directions with the Boltzmann weight of its upper end, divided by the partition sum of i.

    labels: landscape_id, rank, label. States without a label take no part. double_moves: a factor
    per edge, such as a lower weight for moves of two pairs. Entries i = j hold the mass that stays.
    Weights are relative to the ground state: where all of a basin's are too small for a double, its
    rates are not numbers (NaN).
    """
    factor = double_moves if double_moves is not None else F.lit(1.0)
    low = ground(states)
    of = lambda end: labels.select(ID, F.col("rank").alias(end), F.col("label").alias(f"g_{end}"))
    mass = edges.join(of("n"), [ID, "n"]).join(of("m"), [ID, "m"]).join(low, ID).select(ID, "g_n", "g_m", (weight(F.col("e_n"), F.col("mfe"), kt) * factor).alias("w"))
    both = mass.select(ID, F.col("g_m").alias("i"), F.col("g_n").alias("j"), "w").unionByName(mass.select(ID, F.col("g_n").alias("i"), F.col("g_m").alias("j"), "w"))
    z = states.join(labels, [ID, "rank"]).join(low, ID).groupBy(ID, F.col("label").alias("i")).agg(F.sum(weight(F.col("energy"), F.col("mfe"), kt)).alias("z"))
    return both.groupBy(ID, "i", "j").agg(F.sum("w").alias("w")).join(z, [ID, "i"]).select(ID, "i", "j", F.coalesce(F.try_divide("w", "z"), F.lit(float("nan"))).alias("rate"))


def micro_rates(edges: DataFrame, kt: float = 1.0) -> DataFrame:
    """Per edge: rate of the step up (m to n); the step down has rate 1."""
    return edges.select(ID, F.col("m").alias("source"), F.col("n").alias("target"), F.exp(-(F.col("e_n") - F.col("e_m")) / F.lit(kt)).alias("rate"))


def map_structures(query: DataFrame, states: DataFrame, basins: DataFrame, minima: DataFrame, tree: DataFrame, true: DataFrame) -> DataFrame:
    """For query(landscape_id, structure): found, rank, energy, gradient basin (index and structure)
    and the true minimum it counts for; a miss keeps its row with nulls."""
    index = minima.select(ID, F.col("rank").alias("basin"), "lmin", F.col("structure").alias("minimum"))
    known = states.select(ID, "structure", "rank", "energy").join(basins, [ID, "rank"]).join(index, [ID, "basin"]).join(folded(tree, true), [ID, "lmin"], "left")
    return query.join(known.select(ID, "structure", "rank", "energy", "lmin", "minimum", "true_id"), [ID, "structure"], "left").withColumn("found", F.col("rank").isNotNull())
