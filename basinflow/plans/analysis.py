"""The whole analysis of a set of landscapes behind one object with lazy results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basinflow.functions.moves import adjacency, move_set, rna_options
from basinflow.functions.rna import other_mark
from basinflow.operators import landscape as L
from basinflow.operators.graph import cut, rank_within
from basinflow.operators.paths import saddle_path

ID = L.ID


@dataclass(frozen=True)
class LandscapeOptions:
    """graph and moves: the move set by name, or move itself. sequence: of RNA structures (T counts as U);
    strands: whether it is cut into two. design, scores: of a sequence design (see moves.move_set).
    minh, most: depth and number of true minima. connected: only the tree of the ground state (with
    ligands, of the bound and of the unbound one). temperature: see operators.landscape.kt. poset: edges
    must not worsen any objective. early_stop: read no more than the bands that give the first most - 1
    merges deeper than minh. sizes: valley sizes are wanted in bar. Energies are compared exactly. An
    unknown graph or move option is an error."""

    graph: str = "RNA"
    moves: str = ""
    move: Callable[[Column], Column] | None = None
    sequence: str | None = None
    strands: bool = False
    design: tuple[str, str, int, int] | None = None
    scores: dict | None = None
    minh: float = 1e-6
    most: int = 100
    connected: bool = False
    temperature: float | None = None
    poset: bool = False
    early_stop: bool = False
    double_rate: float = 1.0
    sizes: bool = False

    @property
    def ligand(self) -> bool:
        return self.move is None and self.graph.startswith("RNA") and rna_options(self.graph, self.moves)["ligand"]


class Landscape:
    """states (landscape_id, rank, structure, energy[, pov][, listed]) and everything derived from them.
    Every property is computed once; edges and labels are written to the shared checkpoint folder."""

    def __init__(self, spark: SparkSession, states: DataFrame, options: LandscapeOptions = LandscapeOptions()):
        self.spark, self.options = spark, options
        self.states = cut(L.validated(states))
        if options.early_stop and options.most:
            self.states = cut(self.first_bands())

    @property
    def kt(self) -> float:
        return L.kt(self.options.temperature, self.options.graph.startswith("RNA"))

    def neighbours(self, states: DataFrame) -> DataFrame:
        """landscape_id, n, structure, is_double: all neighbours of all states, stored or not."""
        o = self.options
        if o.move is None and o.graph.startswith("RNA"):
            found = move_set(o.graph, o.moves, least=1 if o.strands else 4)(F.col("structure"), F.lit((o.sequence or "").replace("T", "U")))
            return states.select(ID, F.col("rank").alias("n"), F.explode(found).alias("x")).select(ID, "n", "x.structure", "x.is_double")
        if o.graph == "?":
            found = adjacency(F.col("listed"))
        else:
            found = (o.move or move_set(o.graph, o.moves, o.design, o.scores))(F.col("structure"))
        return states.select(ID, F.col("rank").alias("n"), F.explode(found).alias("structure")).withColumn("is_double", F.lit(False))

    @cached_property
    def all_edges(self) -> DataFrame:
        """Look-back edges without the poset filter: landscape_id, n, m, e_n, e_m, is_double."""
        own = self.states.select(ID, F.col("rank").alias("n"), F.col("energy").alias("e_n"))
        build = self.states.select(ID, "structure", F.col("rank").alias("m"), F.col("energy").alias("e_m"))
        met = self.neighbours(self.states).join(build, [ID, "structure"]).where("m < n").join(own, [ID, "n"])
        return cut(met.groupBy(ID, "n", "m").agg(F.min("e_n").alias("e_n"), F.min("e_m").alias("e_m"), F.bool_and("is_double").alias("is_double")))

    @cached_property
    def rate_edges(self) -> DataFrame:
        """The edges that rates count: with ligands, binding and release are steps too."""
        if not self.options.ligand:
            return self.all_edges
        build = self.states.select(ID, "structure", F.col("rank").alias("m"), F.col("energy").alias("e_m"))
        turned = self.states.select(ID, F.col("rank").alias("n"), F.col("energy").alias("e_n"), other_mark(F.col("structure")).alias("structure"))
        met = turned.join(build, [ID, "structure"]).where("m < n").select(ID, "n", "m", "e_n", "e_m", F.lit(False).alias("is_double"))
        return cut(self.all_edges.unionByName(met))

    @cached_property
    def edges(self) -> DataFrame:
        if not self.options.poset:
            return self.all_edges
        of = lambda end: self.states.select(ID, F.col("rank").alias(end), F.col("pov").alias(f"_p{end}"))
        met = self.all_edges.join(of("n"), [ID, "n"]).join(of("m"), [ID, "m"])
        return cut(met.where(F.forall(F.zip_with("_pm", "_pn", lambda a, b: a <= b), lambda x: x)).drop("_pm", "_pn"))

    @cached_property
    def stepped(self) -> DataFrame:
        return cut(L.steps(self.states, self.edges))

    @cached_property
    def minima(self) -> DataFrame:
        return cut(L.numbered_minima(self.stepped))

    @cached_property
    def basins(self) -> DataFrame:
        return L.gradient_basins(self.stepped)

    @cached_property
    def index(self) -> DataFrame:
        """landscape_id, rank, lmin: the gradient basin of every state by its minimum's number."""
        return cut(self.basins.join(self.minima.select(ID, F.col("rank").alias("basin"), "lmin"), [ID, "basin"]).select(ID, "rank", "lmin"))

    @cached_property
    def components(self) -> DataFrame:
        return cut(L.component_basins(self.states, self.edges, self.stepped, self.basins, L.plateau_components(self.states, self.edges)))

    @cached_property
    def tree(self) -> DataFrame:
        out = L.forest(self.minima, L.merge_tree(self.components), self.states)
        named = self.states.select(ID, F.col("rank").alias("saddle"), F.col("structure").alias("saddle_structure"))
        return cut(out.join(named, [ID, "saddle"], "left"))

    @cached_property
    def true_minima(self) -> DataFrame:
        o = self.options
        return cut(L.true_minima(self.tree, o.minh, o.most, o.connected, ligand=o.ligand))

    @cached_property
    def pareto(self) -> DataFrame:
        return L.pareto_flags(self.true_minima)

    @cached_property
    def bar(self) -> DataFrame:
        """True minima under their new numbers: landscape_id, lmin, structure, energy, father, barrier; with
        sizes, also the columns of pools."""
        ids = self.true_minima.select(ID, F.col("lmin").alias("father"), F.col("true_id").alias("_f"))
        rows = self.true_minima.join(self.pools, [ID, "lmin"]) if self.options.sizes else self.true_minima
        return rows.join(ids, [ID, "father"], "left").withColumn("father", F.coalesce("_f", F.lit(0))).withColumn("lmin", F.col("true_id")).drop("_f", "true_id")

    @cached_property
    def labels(self) -> DataFrame:
        return cut(self.index.join(L.folded(self.tree, self.true_minima), [ID, "lmin"]).select(ID, "rank", F.col("true_id").alias("label")))

    @cached_property
    def pools(self) -> DataFrame:
        """Pool, partition sum and free energies of every minimum."""
        valley = L.pools(self.tree, self.components, self.states, self.kt)
        basin = L.basin_statistics(self.states, self.index.withColumnRenamed("lmin", "basin"), self.kt).select(ID, F.col("basin").alias("lmin"), F.col("size").alias("gradient_pool"), F.col("free_energy").alias("gradient_free_energy"))
        return valley.join(L.ground(self.states), ID).withColumn("free_energy", F.col("mfe") - F.lit(self.kt) * F.log("z")).drop("mfe").join(basin, [ID, "lmin"])

    @cached_property
    def rates(self) -> DataFrame:
        factor = F.when(F.col("is_double"), F.lit(self.options.double_rate)).otherwise(F.lit(1.0))
        return L.rates(self.states, self.rate_edges, self.labels, self.kt, factor)

    @cached_property
    def micro_rates(self) -> DataFrame:
        return L.micro_rates(self.rate_edges, self.kt)

    def path(self, a: int, b: int, landscape: str = "1") -> DataFrame:
        """The saddle path between two true minima."""
        ids = {r["true_id"]: r["lmin"] for r in self.true_minima.where((F.col(ID) == landscape) & F.col("true_id").isin(a, b)).collect()}
        return saddle_path(self.tree, self.states, self.stepped, self.index, landscape, ids[a], ids[b])

    def map_structures(self, query: DataFrame) -> DataFrame:
        """Structures looked up, with their basins by descent (lmin, true_id) and by merging (basin,
        true_basin)."""
        found = L.map_structures(query, self.states, self.basins, self.minima, self.tree, self.true_minima)
        merged = L.flooded_basins(self.tree, self.components, L.plateau_components(self.states, self.edges))
        true = L.folded(self.tree, self.true_minima).select(ID, F.col("lmin").alias("basin"), F.col("true_id").alias("true_basin"))
        return found.join(merged, [ID, "rank"], "left").join(true, [ID, "basin"], "left")

    def first_bands(self, begin: int = 1 << 14) -> DataFrame:
        """The states up to the band in which most - 1 merges of at least minh have happened, and the
        first state above it. Merges up to an energy depend on the states up to it only, so the tree of
        the first states is looked at, then of eight times as many, until it has enough merges: what
        lies far above the last merge is never joined."""
        n, k, plain = self.states.agg(F.max("rank")).first()[0] or 0, begin, replace(self.options, early_stop=False)
        while True:
            top = self.states.where(F.col("rank") <= k).groupBy(ID).agg(F.max("energy").alias("_top"))
            part = self.states if k >= n else self.states.join(top, ID).where(F.col("energy") <= F.col("_top")).drop("_top")
            merges = Landscape(self.spark, part, plain).tree.where((F.col("father") > 0) & (F.col("barrier") >= self.options.minh))
            last = cut(rank_within(merges.select(ID, "e_saddle", "lmin"), [ID], ["e_saddle", "lmin"], "_n").where(F.col("_n") == max(1, self.options.most - 1)).select(ID, F.col("e_saddle").alias("_last")))
            if k >= n or self.states.where(F.col("rank") > k).join(last, ID, "left_anti").isEmpty():
                break
            k *= 8
        met = self.states.join(last, ID, "left")
        above = met.where(F.col("energy") > F.col("_last")).groupBy(ID).agg(F.min("rank").alias("_next"))
        return met.join(above, ID, "left").where("_next is null or rank <= _next").drop("_last", "_next")
