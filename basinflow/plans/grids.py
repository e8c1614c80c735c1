"""Landscapes derived from the driver's tables, and their queries with the SQL that gives the same."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinflow.functions import moves
from basinflow.operators import landscape as L
from basinflow.operators.graph import cut, rank_within

ID = L.ID


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One landscape a year of shipping: cells of quantity and discount, energy less the count."""
    items = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").cast("string").alias(ID), F.col("l_quantity").cast("int").alias("q"), F.round(F.col("l_discount") * 100).cast("int").alias("d"))
    cells = items.groupBy(ID, "q", "d").agg((-F.count("*")).cast("double").alias("energy"))
    return L.ranked(cells.withColumn("structure", F.concat_ws(",", F.col("q").cast("string"), F.col("d").cast("string"))), "q", "d")


def week_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One landscape an event type: the torus of weekday and hour, energy less the count."""
    seen = table(spark, sf_dir, "events").select(F.col("event_type").alias(ID), (F.dayofweek("ts") - 1).alias("q"), F.hour("ts").alias("d"))
    cells = seen.groupBy(ID, "q", "d").agg((-F.count("*")).cast("double").alias("energy"))
    return L.ranked(cells.withColumn("structure", F.concat_ws(",", F.col("q").cast("string"), F.col("d").cast("string"))), "q", "d")


class Grid:
    """The steps of the analysis of one set of landscapes, each computed once and then kept."""

    def __init__(self, states: DataFrame, move=moves.grid):
        self.states = cut(states)
        self.edges = cut(L.look_back_edges(self.states, move))
        self.stepped = cut(L.steps(self.states, self.edges))

    @cached_property
    def minima(self):
        return L.numbered_minima(self.stepped)

    @cached_property
    def basins(self):
        return L.gradient_basins(self.stepped)

    def components(self):
        return cut(L.component_basins(self.states, self.edges, self.stepped, self.basins, L.plateau_components(self.states, self.edges)))

    def tree(self, components=None):
        """Father and saddle of all minima; components: those of components(), if at hand."""
        return L.forest(self.minima, L.merge_tree(components if components is not None else self.components()), self.states)

    @cached_property
    def index(self):
        return self.basins.join(self.minima.select(ID, F.col("rank").alias("basin"), "lmin"), [ID, "basin"]).select(ID, "rank", "lmin")


def orders(spark, sf_dir) -> Grid:
    return Grid(order_cells(spark, sf_dir))


def rounded(column: str, digits: int = 6):
    return F.round(column, digits).alias(column)


QUERIES, SQL = {}, {}

CELLS = """WITH RECURSIVE cell AS (SELECT cast(year(l_shipdate) AS varchar) AS landscape_id, cast(l_quantity AS int) AS q, cast(round(l_discount * 100) AS int) AS d, -count(*) AS e FROM lineitem GROUP BY ALL),
st AS (SELECT *, row_number() OVER (PARTITION BY landscape_id ORDER BY e, q, d) AS n FROM cell),
ed AS (SELECT a.landscape_id, a.n AS n, b.n AS m, a.e AS e_n, b.e AS e_m FROM st a JOIN st b ON a.landscape_id = b.landscape_id AND abs(a.q - b.q) + abs(a.d - b.d) = 1 WHERE b.n < a.n),
mn AS (SELECT *, row_number() OVER (PARTITION BY landscape_id ORDER BY n) AS lmin FROM st WHERE NOT EXISTS (SELECT 1 FROM ed WHERE ed.landscape_id = st.landscape_id AND ed.n = st.n AND e_m < e_n)),
dn AS (SELECT landscape_id, n, min(m) AS down FROM ed WHERE NOT EXISTS (SELECT 1 FROM mn WHERE mn.landscape_id = ed.landscape_id AND mn.n = ed.n) GROUP BY ALL),
walk AS (SELECT landscape_id, n, n AS at FROM st UNION ALL SELECT w.landscape_id, w.n, dn.down FROM walk w JOIN dn ON dn.landscape_id = w.landscape_id AND dn.n = w.at),
gb AS (SELECT w.landscape_id, w.n, mn.n AS basin, mn.lmin FROM walk w JOIN mn ON mn.landscape_id = w.landscape_id AND mn.n = w.at),
low AS (SELECT landscape_id, min(e) AS mfe, max(e) AS top FROM st GROUP BY ALL)
"""


def query(name: str, sql: str | None = None, head: str = CELLS):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = head + sql
        return f

    return keep


@query("grid_neighbors", "SELECT landscape_id, n, m, cast(e_n AS double) AS e_n, cast(e_m AS double) AS e_m FROM ed")
def grid_neighbors(spark, sf_dir):
    return orders(spark, sf_dir).edges


@query("grid_minima", "SELECT landscape_id, lmin, n AS rank, q || ',' || d AS structure, cast(e AS double) AS energy FROM mn")
def grid_minima(spark, sf_dir):
    return orders(spark, sf_dir).minima


@query("grid_down", "SELECT landscape_id, n AS rank, down FROM dn")
def grid_down(spark, sf_dir):
    return orders(spark, sf_dir).stepped.where("down is not null").select(ID, "rank", "down")


@query("grid_basin", "SELECT landscape_id, n AS rank, basin FROM gb")
def grid_basin(spark, sf_dir):
    return orders(spark, sf_dir).basins


@query("basin_partition", "SELECT landscape_id, basin, count(*) AS size, round(sum(exp((mfe - e) / 1.0)), 6) AS zg, round(min(mfe) - ln(sum(exp((mfe - e) / 1.0))), 6) AS free_energy FROM gb JOIN st USING (landscape_id, n) JOIN low USING (landscape_id) GROUP BY ALL")
def basin_partition(spark, sf_dir):
    g = orders(spark, sf_dir)
    return L.basin_statistics(g.states, g.basins).select(ID, "basin", "size", rounded("zg"), rounded("free_energy"))


@query("energy_bands", "SELECT landscape_id, cast(e AS double) AS energy, count(*) AS size FROM st GROUP BY ALL")
def energy_bands(spark, sf_dir):
    return L.energy_bands(order_cells(spark, sf_dir))


PLATEAU = ", flat AS (SELECT landscape_id, n AS a, m AS b FROM ed WHERE e_n = e_m UNION SELECT landscape_id, m, n FROM ed WHERE e_n = e_m), reach AS (SELECT landscape_id, n AS a, n AS b FROM st UNION SELECT r.landscape_id, r.a, f.b FROM reach r JOIN flat f ON f.landscape_id = r.landscape_id AND f.a = r.b) "


@query("plateau_components", PLATEAU + "SELECT landscape_id, a AS rank, min(b) AS comp FROM reach GROUP BY ALL")
def plateau_components(spark, sf_dir):
    g = orders(spark, sf_dir)
    return L.plateau_components(g.states, g.edges)


# A minimum's saddle: the lowest level at which it can reach a minimum of smaller index.
SADDLE = (
    ", way AS (SELECT landscape_id, n AS a, m AS b, e_n AS level FROM ed UNION ALL SELECT landscape_id, m, n, e_n FROM ed), "
    "flood AS (SELECT landscape_id, lmin, n AS at, e AS level FROM mn UNION SELECT f.landscape_id, f.lmin, b.b, greatest(f.level, b.level) FROM flood f JOIN way b ON b.landscape_id = f.landscape_id AND b.a = f.at), "
    "saddle AS (SELECT f.landscape_id, f.lmin, min(level) AS level FROM flood f JOIN mn ON mn.landscape_id = f.landscape_id AND mn.n = f.at AND mn.lmin < f.lmin GROUP BY ALL), "
    "tree AS (SELECT mn.landscape_id, mn.lmin, cast(mn.e AS double) AS energy, coalesce(cast(level AS double), top + 1e-6) AS e_saddle, level IS NULL AS is_root FROM mn JOIN low USING (landscape_id) LEFT JOIN saddle USING (landscape_id, lmin)) "
)


#: Descents to minima, for heads that have st, ed and mn.
DESCENT = (
    ", dn AS (SELECT landscape_id, n, min(m) AS down FROM ed WHERE NOT EXISTS (SELECT 1 FROM mn WHERE mn.landscape_id = ed.landscape_id AND mn.n = ed.n) GROUP BY ALL), "
    "walk AS (SELECT landscape_id, n, n AS at FROM st UNION ALL SELECT w.landscape_id, w.n, dn.down FROM walk w JOIN dn ON dn.landscape_id = w.landscape_id AND dn.n = w.at), "
    "gb AS (SELECT w.landscape_id, w.n, mn.n AS basin, mn.lmin FROM walk w JOIN mn ON mn.landscape_id = w.landscape_id AND mn.n = w.at) "
)
#: Plateau components with the basins they touch, in their order of merging (by energy, then by the roots
#: of their basins when the band begins), and the merges, one component after another: r holds the root of
#: each minimum, pool and z what its valley holds. Follows PLATEAU and SADDLE.
REPLAY = (
    ", comp AS (SELECT landscape_id, a AS n, min(b) AS comp FROM reach GROUP BY ALL), "
    "touch AS (SELECT landscape_id, comp, lmin, min(contact) AS contact FROM (SELECT c.landscape_id, comp, lmin, c.n AS contact FROM comp c JOIN gb USING (landscape_id, n) UNION ALL SELECT ed.landscape_id, comp, lmin, ed.m FROM ed JOIN comp c ON c.landscape_id = ed.landscape_id AND c.n = ed.n JOIN gb ON gb.landscape_id = ed.landscape_id AND gb.n = ed.m WHERE e_m < e_n) GROUP BY ALL), "
    "lev AS MATERIALIZED (SELECT f.landscape_id, f.lmin, mn.lmin AS o, min(level) AS level FROM flood f JOIN mn ON mn.landscape_id = f.landscape_id AND mn.n = f.at GROUP BY ALL), "
    "own AS (SELECT t.landscape_id, t.comp, st.e, t.lmin, t.contact, coalesce(least(t.lmin, min(l.o)), t.lmin) AS root0 FROM touch t JOIN st ON st.landscape_id = t.landscape_id AND st.n = t.comp LEFT JOIN lev l ON l.landscape_id = t.landscape_id AND l.lmin = t.lmin AND l.level < st.e GROUP BY t.landscape_id, t.comp, st.e, t.lmin, t.contact), "
    "held AS (SELECT landscape_id, comp, count(*) - count(lmin) AS size FROM comp LEFT JOIN mn USING (landscape_id, n) GROUP BY ALL), "
    "todo AS (SELECT landscape_id, comp, e, list(lmin ORDER BY lmin) AS ids, list(contact ORDER BY lmin) AS contacts, list_sort(list_distinct(list(root0))) AS rs FROM own GROUP BY ALL), "
    "turn AS MATERIALIZED (SELECT t.*, size, exp(mfe - e) AS w, row_number() OVER (PARTITION BY landscape_id ORDER BY e, rs, comp) AS k FROM todo t JOIN held USING (landscape_id, comp) JOIN low USING (landscape_id)), "
    "rep AS (SELECT landscape_id, cast(0 AS bigint) AS k, list(lmin ORDER BY lmin) AS r, list(cast(1 AS hugeint) ORDER BY lmin) AS pool, list(exp(mfe - e) ORDER BY lmin) AS z, cast(NULL AS bigint[]) AS s, cast(NULL AS bigint) AS comp, cast(NULL AS bigint[]) AS ids, cast(NULL AS bigint[]) AS contacts, cast(NULL AS bigint[]) AS old FROM mn JOIN low USING (landscape_id) GROUP BY landscape_id "
    "UNION ALL SELECT landscape_id, k, list_transform(r, lambda x: CASE WHEN list_contains(s, x) THEN s[1] ELSE x END), "
    "list_transform(pool, lambda p, i: CASE WHEN i = s[1] THEN cast(p + size + coalesce(list_sum(list_transform(s[2:], lambda x: pool[x])), 0) AS hugeint) ELSE p END), "
    "list_transform(z, lambda p, i: CASE WHEN i = s[1] THEN p + size * w + coalesce(list_sum(list_transform(s[2:], lambda x: z[x])), 0) ELSE p END), s, comp, ids, contacts, r "
    "FROM (SELECT rep.landscape_id, turn.k, rep.r, rep.pool, rep.z, turn.size, turn.w, turn.comp, turn.ids, turn.contacts, list_sort(list_distinct(list_transform(turn.ids, lambda x: rep.r[x]))) AS s FROM rep JOIN turn ON turn.landscape_id = rep.landscape_id AND turn.k = rep.k + 1)), "
    "made AS (SELECT landscape_id, comp, s[1] AS father, unnest(s[2:]) AS lmin, ids, contacts, old FROM rep WHERE len(s) > 1), "
    "fathers AS (SELECT landscape_id, lmin, father, comp AS saddle, list_min(list_transform(list_filter(list_zip(ids, contacts), lambda y: old[y[1]] = father), lambda y: y[2])) AS left_contact, list_min(list_transform(list_filter(list_zip(ids, contacts), lambda y: old[y[1]] = lmin), lambda y: y[2])) AS right_contact FROM made) "
)


@query("merge_saddle", SADDLE + "SELECT landscape_id, lmin, energy, round(e_saddle, 7) AS e_saddle, round(e_saddle - energy, 7) AS barrier, is_root FROM tree")
def merge_saddle(spark, sf_dir):
    return orders(spark, sf_dir).tree().select(ID, "lmin", "energy", rounded("e_saddle", 7), rounded("barrier", 7), (F.col("father") == 0).alias("is_root"))


@query("merge_fathers", PLATEAU + SADDLE + REPLAY + "SELECT landscape_id, lmin, coalesce(father, 0) AS father, saddle, left_contact, right_contact FROM mn LEFT JOIN fathers USING (landscape_id, lmin)")
def merge_fathers(spark, sf_dir):
    return orders(spark, sf_dir).tree().select(ID, "lmin", "father", "saddle", "left_contact", "right_contact")


@query("true_minima", SADDLE + "SELECT landscape_id, lmin, row_number() OVER (PARTITION BY landscape_id ORDER BY lmin) AS true_id, round(e_saddle - energy, 7) AS barrier FROM (SELECT *, count(*) OVER (PARTITION BY landscape_id) AS c FROM tree) WHERE c = 1 OR e_saddle - energy - 2.0 + 1.1920928955078125e-07 >= 0")
def true_minima(spark, sf_dir):
    return L.true_minima(orders(spark, sf_dir).tree(), minh=2.0).select(ID, "lmin", "true_id", rounded("barrier", 7))


@query("merge_forest_roots", SADDLE + "SELECT landscape_id, count(*) AS minima, cast(sum(cast(is_root AS int)) AS bigint) AS roots FROM tree GROUP BY ALL")
def merge_forest_roots(spark, sf_dir):
    return orders(spark, sf_dir).tree().groupBy(ID).agg(F.count("*").alias("minima"), F.sum((F.col("father") == 0).cast("int")).alias("roots"))


@query("valley_pools", PLATEAU + SADDLE + REPLAY + "SELECT landscape_id, mn.lmin, cast(pool[mn.lmin] AS bigint) AS pool, round(z[mn.lmin], 6) AS z FROM mn JOIN (SELECT landscape_id, arg_max(pool, k) AS pool, arg_max(z, k) AS z FROM rep GROUP BY ALL) USING (landscape_id)")
def valley_pools(spark, sf_dir):
    g = orders(spark, sf_dir)
    components = g.components()
    return L.pools(g.tree(components), components, g.states).select(ID, "lmin", "pool", rounded("z"))


RATES = ", w AS (SELECT ed.landscape_id, a.lmin AS gn, b.lmin AS gm, exp((mfe - e_n) / 1.0) AS w FROM ed JOIN gb a ON a.landscape_id = ed.landscape_id AND a.n = ed.n JOIN gb b ON b.landscape_id = ed.landscape_id AND b.n = ed.m JOIN low ON low.landscape_id = ed.landscape_id), r AS (SELECT landscape_id, gm AS i, gn AS j, w FROM w UNION ALL SELECT landscape_id, gn, gm, w FROM w), z AS (SELECT landscape_id, lmin AS i, sum(exp((mfe - e) / 1.0)) AS z FROM gb JOIN st USING (landscape_id, n) JOIN low USING (landscape_id) GROUP BY ALL) "


@query("rates_sparse", RATES + "SELECT landscape_id, i, j, round(sum(w) / z, 6) AS rate FROM r JOIN z USING (landscape_id, i) GROUP BY landscape_id, i, j, z")
def rates_sparse(spark, sf_dir):
    g = orders(spark, sf_dir)
    return L.rates(g.states, g.edges, g.index.withColumnRenamed("lmin", "label")).select(ID, "i", "j", rounded("rate"))


#: True minima at least 2 deep, and the true minimum that each one counts for.
FOLDED = (
    ", tm AS (SELECT landscape_id, lmin, row_number() OVER (PARTITION BY landscape_id ORDER BY lmin) AS true_id FROM (SELECT *, count(*) OVER (PARTITION BY landscape_id) AS c FROM tree) WHERE c = 1 OR e_saddle - energy - 2.0 + 1.1920928955078125e-07 >= 0), "
    "up AS (SELECT landscape_id, lmin, lmin AS at FROM mn UNION ALL SELECT u.landscape_id, u.lmin, f.father FROM up u JOIN fathers f ON f.landscape_id = u.landscape_id AND f.lmin = u.at WHERE NOT EXISTS (SELECT 1 FROM tm WHERE tm.landscape_id = u.landscape_id AND tm.lmin = u.at)), "
    "fold AS (SELECT up.landscape_id, up.lmin, tm.true_id FROM up JOIN tm ON tm.landscape_id = up.landscape_id AND tm.lmin = up.at), tb AS (SELECT gb.landscape_id, gb.n, fold.true_id AS lmin FROM gb JOIN fold USING (landscape_id, lmin)) "
)


@query("true_rates", PLATEAU + SADDLE + REPLAY + FOLDED + RATES.replace("JOIN gb", "JOIN tb").replace("FROM gb", "FROM tb") + "SELECT landscape_id, i, j, round(sum(w) / z, 6) AS rate FROM r JOIN z USING (landscape_id, i) GROUP BY landscape_id, i, j, z")
def true_rates(spark, sf_dir):
    """Rates between true minima: states of false minima count for their true ancestor."""
    g = orders(spark, sf_dir)
    tree = g.tree()
    labels = g.index.join(L.folded(tree, L.true_minima(tree, minh=2.0)), [ID, "lmin"]).select(ID, "rank", F.col("true_id").alias("label"))
    return L.rates(g.states, g.edges, labels).select(ID, "i", "j", rounded("rate"))


@query("detailed_balance", RATES + ", q AS (SELECT landscape_id, i, j, sum(w) AS m FROM r GROUP BY ALL) SELECT a.landscape_id, count(*) AS pairs, cast(sum(cast(abs(a.m - b.m) > 1e-9 AS int)) AS bigint) AS broken FROM q a JOIN q b ON a.landscape_id = b.landscape_id AND a.i = b.j AND a.j = b.i GROUP BY ALL")
def detailed_balance(spark, sf_dir):
    g = orders(spark, sf_dir)
    labels = g.index.withColumnRenamed("lmin", "label")
    z = g.states.join(labels, [ID, "rank"]).join(L.ground(g.states), ID).groupBy(ID, F.col("label").alias("i")).agg(F.sum(L.weight(F.col("energy"), F.col("mfe"), 1.0)).alias("z"))
    flow = L.rates(g.states, g.edges, labels).join(z, [ID, "i"]).select(ID, "i", "j", F.when(F.col("z") > 0, F.col("rate") * F.col("z")).otherwise(0.0).alias("m"))
    back = flow.select(ID, F.col("j").alias("i"), F.col("i").alias("j"), F.col("m").alias("o"))
    return flow.join(back, [ID, "i", "j"]).groupBy(ID).agg(F.count("*").alias("pairs"), F.sum((F.abs(F.col("m") - F.col("o")) > 1e-9).cast("int")).alias("broken"))


@query("micro_rates", "SELECT landscape_id, m AS source, n AS target, round(exp(-(e_n - e_m) / 1.0), 6) AS rate FROM ed")
def micro_rates(spark, sf_dir):
    return L.micro_rates(orders(spark, sf_dir).edges).select(ID, "source", "target", rounded("rate"))


@query("topk_minima", "SELECT landscape_id, lmin, cast(e AS double) AS energy FROM mn WHERE lmin <= 10")
def topk_minima(spark, sf_dir):
    return orders(spark, sf_dir).minima.where("lmin <= 10").select(ID, "lmin", "energy")


@query("map_structures", "SELECT landscape_id, q || ',' || d AS structure, coalesce(st.n, 0) AS rank, coalesce(cast(st.e AS double), 0) AS energy, coalesce(gb.lmin, 0) AS lmin, st.n IS NOT NULL AS found FROM (SELECT DISTINCT landscape_id FROM st) JOIN (SELECT DISTINCT cast(l_quantity AS int) AS q, cast(round(l_discount * 100) AS int) AS d FROM lineitem) ON true LEFT JOIN st USING (landscape_id, q, d) LEFT JOIN gb ON gb.landscape_id = st.landscape_id AND gb.n = st.n")
def map_structures(spark, sf_dir):
    """Every cell that any year has, looked up in each year's landscape; misses keep their row."""
    g = orders(spark, sf_dir)
    tree = g.tree()
    asked = g.states.select("structure").distinct().join(F.broadcast(g.states.select(ID).distinct()))
    met = L.map_structures(asked, g.states, g.basins, g.minima, tree, L.true_minima(tree, minh=2.0))
    return met.select(ID, "structure", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("rank", "energy", "lmin")), "found")


@query("map_basins", PLATEAU + SADDLE + REPLAY + FOLDED + "SELECT b.landscape_id, b.n AS rank, b.basin, f.true_id AS true_basin, g.lmin, h.true_id FROM (SELECT c.landscape_id, c.n, coalesce(mn.lmin, rep.r[turn.ids[1]]) AS basin FROM comp c JOIN turn USING (landscape_id, comp) JOIN rep ON rep.landscape_id = c.landscape_id AND rep.k = turn.k LEFT JOIN mn ON mn.landscape_id = c.landscape_id AND mn.n = c.n) b JOIN gb g ON g.landscape_id = b.landscape_id AND g.n = b.n LEFT JOIN fold f ON f.landscape_id = b.landscape_id AND f.lmin = b.basin LEFT JOIN fold h ON h.landscape_id = b.landscape_id AND h.lmin = g.lmin")
def map_basins(spark, sf_dir):
    """Each state's basin by merging and by descent, and the true minima at least 2 deep that these count for."""
    g = orders(spark, sf_dir)
    components = g.components()
    tree = cut(g.tree(components))
    of = cut(L.folded(tree, L.true_minima(tree, minh=2.0)))
    merged = L.flooded_basins(tree, components, L.plateau_components(g.states, g.edges)).join(g.index, [ID, "rank"])
    both = merged.join(of.select(ID, F.col("lmin").alias("basin"), F.col("true_id").alias("true_basin")), [ID, "basin"], "left").join(of, [ID, "lmin"], "left")
    return both.select(ID, "rank", "basin", "true_basin", "lmin", "true_id")


@query("first_true_minima", SADDLE + "SELECT landscape_id, lmin, true_id FROM (SELECT landscape_id, lmin, row_number() OVER (PARTITION BY landscape_id ORDER BY lmin) AS true_id FROM (SELECT *, count(*) OVER (PARTITION BY landscape_id) AS c FROM tree) WHERE c = 1 OR e_saddle - energy - 2.0 + 1.1920928955078125e-07 >= 0) WHERE true_id <= 5")
def first_true_minima(spark, sf_dir):
    """The first five true minima at least 2 deep."""
    return L.true_minima(orders(spark, sf_dir).tree(), minh=2.0, most=5).select(ID, "lmin", "true_id")


TORUS = """WITH RECURSIVE cell AS (SELECT event_type AS landscape_id, dayofweek(ts) AS q, hour(ts) AS d, -count(*) AS e FROM events GROUP BY ALL),
st AS (SELECT *, row_number() OVER (PARTITION BY landscape_id ORDER BY e, q, d) AS n FROM cell),
ed AS (SELECT DISTINCT a.landscape_id, a.n AS n, b.n AS m, a.e AS e_n, b.e AS e_m FROM st a JOIN st b ON a.landscape_id = b.landscape_id AND (a.d = b.d AND (a.q - b.q + 7) % 7 IN (1, 6) OR a.q = b.q AND (a.d - b.d + 24) % 24 IN (1, 23)) WHERE b.n < a.n)
"""


@query("torus_minima", "SELECT landscape_id, n AS rank, q || ',' || d AS structure, cast(e AS double) AS energy FROM st WHERE NOT EXISTS (SELECT 1 FROM ed WHERE ed.landscape_id = st.landscape_id AND ed.n = st.n AND e_m < e_n)", TORUS)
def torus_minima(spark, sf_dir):
    g = Grid(week_cells(spark, sf_dir), lambda s: moves.grid(s, (7, 24)))
    return g.minima.select(ID, "rank", "structure", "energy")


#: Minima with their numbers and lowest and highest energies, for heads that have st and ed.
NUMBERED = ", mn AS (SELECT *, row_number() OVER (PARTITION BY landscape_id ORDER BY n) AS lmin FROM st WHERE NOT EXISTS (SELECT 1 FROM ed WHERE ed.landscape_id = st.landscape_id AND ed.n = st.n AND e_m < e_n)), low AS (SELECT landscape_id, min(e) AS mfe, max(e) AS top FROM st GROUP BY ALL)"
SADDLES = NUMBERED + SADDLE + "SELECT landscape_id, lmin, energy, round(e_saddle, 7) AS e_saddle FROM tree"
#: All that follows st and ed, up to the merges.
WHOLE = NUMBERED + DESCENT + PLATEAU + SADDLE + REPLAY


@query("torus_tree", WHOLE + "SELECT landscape_id, lmin, mn.q || ',' || mn.d AS structure, energy, coalesce(father, 0) AS father, round(e_saddle, 7) AS e_saddle, round(e_saddle - energy, 7) AS barrier FROM mn JOIN tree USING (landscape_id, lmin) LEFT JOIN fathers USING (landscape_id, lmin)", TORUS)
def torus_tree(spark, sf_dir):
    g = Grid(week_cells(spark, sf_dir), lambda s: moves.grid(s, (7, 24)))
    return g.tree().select(ID, "lmin", "structure", "energy", "father", rounded("e_saddle", 7), rounded("barrier", 7))


@query("torus_saddles", SADDLES, TORUS)
def torus_saddles(spark, sf_dir):
    return torus_tree(spark, sf_dir).select(ID, "lmin", "energy", "e_saddle")


PARTS = "WITH p AS (SELECT p_brand AS landscape_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS lmin, p_partkey, p_size AS a, length(p_name) AS b, cast(p_partkey % 97 AS int) AS c FROM part) "


def part_points(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias(ID), "p_retailprice", "p_partkey", F.array(F.col("p_size"), F.length("p_name"), (F.col("p_partkey") % 97).cast("int")).alias("pov"))
    return rank_within(parts, [ID], ["p_retailprice", "p_partkey"], "lmin")


@query("pareto_flags", PARTS + "SELECT landscape_id, lmin, p_partkey, NOT EXISTS (SELECT 1 FROM p o WHERE o.landscape_id = p.landscape_id AND o.lmin < p.lmin AND o.a < p.a AND o.b < p.b AND o.c < p.c) AS is_global FROM p", "")
def pareto_flags(spark, sf_dir):
    return L.pareto_flags(part_points(spark, sf_dir)).select(ID, "lmin", "p_partkey", "is_global")


@query("poset_edges", "SELECT a.landscape_id, a.n, b.n AS m FROM ed JOIN st a ON a.landscape_id = ed.landscape_id AND a.n = ed.n JOIN st b ON b.landscape_id = ed.landscape_id AND b.n = ed.m WHERE b.q % 10 <= a.q % 10 AND b.d % 4 <= a.d % 4")
def poset_edges(spark, sf_dir):
    states = order_cells(spark, sf_dir).withColumn("pov", F.array(F.col("q") % 10, F.col("d") % 4))
    return L.look_back_edges(states, moves.grid, poset=True).select(ID, "n", "m")
