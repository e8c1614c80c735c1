"""What follows the tree: cross rates between two sub-landscapes, maps between trees, graph exports."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basinflow.functions.rna import base_pairs, pair_distance
from basinflow.operators.forest import doubled, subtree_sums, summed_up
from basinflow.operators.graph import cut, rank_within
from basinflow.operators.landscape import GAS, ID, ZERO


def reordered(minima: DataFrame) -> DataFrame:
    """New numbers with unbound minima (no trailing *) first: landscape_id, lmin, bound, new_id."""
    return rank_within(minima.withColumn("bound", F.col("structure").endswith("*")), [ID], ["bound", "lmin"], "new_id")


def cross_rates(rates: DataFrame, order: DataFrame, association: float = 170000.0, concentration: float = 1.0, binding_energy: float = 0.0, temperature: float = 37.0) -> DataFrame:
    """Rates under the new numbers; a step that binds is scaled by concentration x association, one
    that unbinds by association x exp(-binding_energy / RT)."""
    of = lambda end: order.select(ID, F.col("lmin").alias(end), F.col("bound").alias(f"b_{end}"), F.col("new_id").alias(f"new_{end}"))
    met = rates.join(of("i"), [ID, "i"]).join(of("j"), [ID, "j"])
    on, off = F.lit(concentration * association), F.lit(association) * F.exp(F.lit(-binding_energy / (GAS * (ZERO + temperature))))
    scale = F.when(~F.col("b_i") & F.col("b_j"), on).when(F.col("b_i") & ~F.col("b_j"), off).otherwise(F.lit(1.0))
    return met.select(ID, F.col("new_i").alias("i"), F.col("new_j").alias("j"), (F.col("rate") * scale).alias("rate"))


def nearest(rest: DataFrame, others: DataFrame, distance: Callable[[Column, Column], Column], changes: int) -> DataFrame:
    """For each of rest(landscape_id, source, structure) the nearest of others(landscape_id, target, other):
    landscape_id, source, target, distance; the smaller target on ties.

    Strings that differ at fewer places than they have parts agree on a part, so only those that share one
    are compared; what is then found within reach is the nearest. For the others the parts are halved. A
    distance of one changes `changes` letters at most. Only strings that agree nowhere with a near one
    meet all of their landscape in the end."""
    out, parts = None, 2
    n = max(2, others.agg(F.max(F.length("other"))).first()[0] or 0, rest.agg(F.max(F.length("structure"))).first()[0] or 0)
    best = lambda pairs: pairs.withColumn("distance", distance(F.col("structure"), F.col("other"))).groupBy(ID, "source").agg(F.min(F.struct("distance", "target")).alias("m")).select(ID, "source", F.col("m.target").alias("target"), F.col("m.distance").alias("distance"))
    while True:
        cuts = [n * k // parts for k in range(parts + 1)]
        pieces = lambda c: F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.substring(c, a + 1, b - a).alias("part")) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))))).alias("piece")  # noqa: B023, E731
        met = rest.select("*", pieces("structure")).join(others.select("*", pieces("other")), [ID, "piece"]).drop("piece").distinct()
        sure = cut(best(met).where(F.col("distance") * changes < parts))
        out = sure if out is None else out.unionByName(sure)
        rest = cut(rest.join(sure.select(ID, "source"), [ID, "source"], "left_anti"))
        if rest.isEmpty():
            return out
        if parts >= n:
            return out.unionByName(best(rest.join(others, ID)))
        parts = min(n, 2 * parts)


def nearest_structures(queries: DataFrame, others: DataFrame) -> DataFrame:
    """For each of queries(landscape_id, source, structure) the one of others(landscape_id, target, other) that
    differs in the fewest base pairs, the smaller target on ties: landscape_id, source, target, distance.

    Pairs are put in order of rarity. Two structures that differ in at most d pairs and share one share it
    among the first d + 1 of both, so only those that meet there are compared, for d = 1, 2, 4, ...; of those
    that share nothing with a structure, the one with the fewest pairs is nearest. What is found within d is
    the nearest, and common pairs come into play for the last queries only. Structures of landscapes without
    others have no row. Rows that grow with the structures are joined by merging: a broadcast, which may be
    chosen for what is small when compressed, would pass them through the driver."""
    of = lambda rows, key, text: rows.select(ID, F.col(key).alias("key"), base_pairs(F.col(text)).alias("pairs"))
    a, b = cut(of(queries, "source", "structure")), cut(of(others, "target", "other"))
    often = cut(b.select(ID, F.explode("pairs").alias("pair")).groupBy(ID, "pair").agg(F.count("*").alias("n")))

    def rare_first(rows: DataFrame) -> DataFrame:
        each = rows.select(ID, "key", F.explode("pairs").alias("pair")).join(often.hint("merge"), [ID, "pair"], "left")
        order = each.groupBy(ID, "key").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "pair"))).alias("s"))
        return cut(rows.select(ID, "key").join(order.hint("merge"), [ID, "key"], "left").select(ID, "key", F.coalesce(F.transform("s", lambda x: x["pair"]), F.array().cast("array<string>")).alias("pairs")))

    a, b = rare_first(a), rare_first(b)
    least = b.groupBy(ID).agg(F.min(F.struct(F.size("pairs").alias("size"), "key")).alias("least"))
    rest = cut(a.join(least, ID).select(ID, F.col("key").alias("source"), F.col("pairs").alias("own"), F.struct((F.size("pairs") + F.col("least.size")).alias("distance"), F.col("least.key").alias("target")).alias("best")))
    out, d = [], 1
    while not rest.isEmpty():
        first = lambda c: F.explode(F.slice(c, 1, d + 1)).alias("pair")  # noqa: B023, E731
        met = rest.select(ID, "source", first("own")).join(b.select(ID, F.col("key").alias("target"), first("pairs")).hint("merge"), [ID, "pair"]).select(ID, "source", "target").distinct()
        near = met.join(rest.select(ID, "source", "own").hint("merge"), [ID, "source"]).join(b.select(ID, F.col("key").alias("target"), F.col("pairs").alias("other")).hint("merge"), [ID, "target"])
        found = near.groupBy(ID, "source").agg(F.min(F.struct((F.size("own") + F.size("other") - 2 * F.size(F.array_intersect("own", "other"))).alias("distance"), "target")).alias("_best"))
        now = cut(rest.join(found.hint("merge"), [ID, "source"], "left").withColumn("best", F.least("best", F.coalesce("_best", "best"))).drop("_best"))
        out.append(now.where(F.col("best.distance") <= d).select(ID, "source", F.col("best.target").alias("target"), F.col("best.distance").alias("distance")))
        rest, d = now.where(F.col("best.distance") > d), 2 * d
    return reduce(DataFrame.unionByName, out) if out else rest.select(ID, "source", F.col("best.target").alias("target"), F.col("best.distance").alias("distance"))


def mapped_trees(first: DataFrame, second: DataFrame, distance: Callable[[Column, Column], Column] = pair_distance, changes: int = 2, walked: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Every minimum of the first tree in the second: the equal structure if there is one (exact), else
    the one of least distance, the earlier one on ties. distance and changes: of two structures, and the
    letters that a distance of one changes at most; base pairs (2) by default, rna.hamming (1) for spins
    and strings. walked: takes the first minima to where they descend in the second landscape (see
    paths.gradient_walk), with the same columns."""
    first = walked(first) if walked else first
    a = first.select(ID, F.col("lmin").alias("source"), "structure")
    b = second.select(ID, F.col("lmin").alias("target"), F.col("structure").alias("other"))
    exact = a.join(b, (a[ID] == b[ID]) & (a["structure"] == b["other"])).groupBy(a[ID], "source").agg(F.min("target").alias("target")).select(ID, "source", "target", F.lit(0).alias("distance"), F.lit(True).alias("exact"))
    rest = cut(a.join(exact.select(ID, "source"), [ID, "source"], "left_anti"))
    return exact.unionByName(nearest(rest, cut(b), distance, changes).withColumn("exact", F.lit(False)))


def saddle_graph(components: DataFrame, most: int | None = 1000) -> DataFrame:
    """Edges between saddles and the minima they touch, up to a minimum's number (None: all):
    landscape_id, saddle, energy, lmin."""
    edges = components.where(F.size("basins") > 1).select(ID, F.col("comp").alias("saddle"), "energy", F.explode("basins").alias("b")).select(ID, "saddle", "energy", F.col("b.lmin").alias("lmin"))
    return edges if most is None else edges.where(F.col("lmin") <= most)


def dot_lines(graph: DataFrame, name: str = "saddles") -> DataFrame:
    """The graph as lines of the dot language, one text column in order."""
    edge = graph.select(F.lit(2).alias("part"), F.format_string('  "S%d" -- "%d";', "saddle", "lmin").alias("value"))
    saddles = graph.select("saddle", "energy").distinct().select(F.lit(1).alias("part"), F.format_string('  "S%d" [shape=point,label="%.2f"];', "saddle", "energy").alias("value"))
    return framed(edge.unionByName(saddles), f"graph {name} {{", "}")


def gml_lines(graph: DataFrame) -> DataFrame:
    """The graph as lines of GML; saddles have negative numbers."""
    nodes = graph.select(F.col("lmin").alias("id"), F.col("lmin").cast("string").alias("label")).unionByName(graph.select((-F.col("saddle")).alias("id"), F.format_string("%.2f", "energy").alias("label"))).distinct()
    node = nodes.select(F.lit(1).alias("part"), F.format_string('  node [ id %d label "%s" ]', "id", "label").alias("value"))
    edge = graph.select(F.lit(2).alias("part"), F.format_string("  edge [ source %d target %d ]", -F.col("saddle"), "lmin").alias("value"))
    return framed(node.unionByName(edge), "graph [", "]")


def framed(lines: DataFrame, head: str, tail: str) -> DataFrame:
    spark = lines.sparkSession
    ends = spark.createDataFrame([(0, head), (9, tail)], "part int, value string")
    return lines.unionByName(ends).orderBy("part", "value").select("value")


def leaf_order(minima: DataFrame) -> DataFrame:
    """Places of a landscape's minima along the axis of a drawing: landscape_id, lmin, place (from 0).
    Visited by saddle (of equal ones the larger number first), a minimum's chain goes behind its father's;
    trees follow each other by the number of their root.

    So a minimum stands behind its father by one and by all that hangs on the father's earlier children;
    places are the sums of these numbers up to the root, by doubled ancestors. A father that is not among
    the rows makes a root."""
    known = minima.select(ID, F.col("lmin").alias("father")).distinct()
    tree = cut(minima.join(known.withColumn("_known", F.lit(True)), [ID, "father"], "left").select(ID, F.col("lmin").alias("node"), "e_saddle", F.when(F.col("_known") & (F.col("father") != F.col("lmin")), F.col("father")).alias("up")))
    levels = doubled(tree.where("up is not null").select(ID, "node", "up", F.col("e_saddle").alias("key")))
    sizes = subtree_sums(tree.select(ID, "node", F.lit(1).cast("long").alias("held")), levels, "held")
    rows = tree.join(sizes, [ID, "node"])
    before = lambda order: F.coalesce(F.sum("held").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    roots = rows.where("up is null").withColumn("offset", before(Window.partitionBy(ID).orderBy("node")))
    others = rows.where("up is not null").withColumn("offset", before(Window.partitionBy(ID, "up").orderBy("e_saddle", F.desc("node"))) + 1)
    return summed_up(roots.unionByName(others).select(ID, "node", "up", "offset"), "offset").select(ID, F.col("node").alias("lmin"), F.col("offset").alias("place"))


def incidence(rates: DataFrame, size: int) -> DataFrame:
    """The rates as rows of a dense matrix: landscape_id, i, row (array of size numbers)."""
    return rates.groupBy(ID, "i").agg(F.map_from_entries(F.collect_list(F.struct("j", "rate"))).alias("m")).select(ID, "i", F.transform(F.sequence(F.lit(1).cast("long"), F.lit(size).cast("long")), lambda j: F.coalesce(F.element_at("m", j), F.lit(0.0))).alias("row"))
