"""Queries about ways in landscapes: descents, saddles between minima, and the states on the way."""

from __future__ import annotations

from pyspark.sql import functions as F

from basinflow.functions import moves
from basinflow.operators import paths, post
from basinflow.operators.graph import rank_within
from basinflow.plans.analysis import Landscape, LandscapeOptions
from basinflow.plans.grids import CELLS, ID, PLATEAU, REPLAY, SADDLE, order_cells, orders, table
from basinflow.plans.strings import CANONICAL, canonical_moves

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = CELLS + sql
        return f

    return keep


@query("descents", ", dw AS (SELECT landscape_id, n, n AS here, 0 AS d FROM st UNION ALL SELECT w.landscape_id, w.n, dn.down, d + 1 FROM dw w JOIN dn ON dn.landscape_id = w.landscape_id AND dn.n = w.here) SELECT landscape_id, n AS rank, arg_max(here, d) AS basin, cast(max(d) AS bigint) AS steps FROM dw GROUP BY ALL")
def descents(spark, sf_dir):
    """The minimum below every state, and how many steps it is away."""
    return paths.way_down(orders(spark, sf_dir).stepped)


MERGED = PLATEAU + SADDLE + REPLAY


@query("descent_paths", MERGED + ", lw AS (SELECT landscape_id, lmin, 'L' AS side, left_contact AS rank, 0 AS step FROM fathers UNION ALL SELECT landscape_id, lmin, 'R', right_contact, 0 FROM fathers UNION ALL SELECT w.landscape_id, w.lmin, w.side, dn.down, step + 1 FROM lw w JOIN dn ON dn.landscape_id = w.landscape_id AND dn.n = w.rank) SELECT landscape_id, side || lmin AS limb, cast(step AS bigint) AS step, rank FROM lw")
def descent_paths(spark, sf_dir):
    """All states on the way down from both sides of every saddle."""
    g = orders(spark, sf_dir)
    tree = g.tree().where("father > 0")
    starts = [tree.select(ID, F.concat(F.lit(side), F.col("lmin")).alias("limb"), F.col(contact).alias("rank")) for side, contact in (("L", "left_contact"), ("R", "right_contact"))]
    return paths.descent(starts[0].unionByName(starts[1]), g.stepped).select(ID, "limb", "step", "rank")


#: Each minimum with the next one, and with the lowest.
PAIRS = ", pr AS (SELECT a.landscape_id, a.lmin AS a, b.lmin AS b FROM mn a JOIN mn b USING (landscape_id) WHERE b.lmin = a.lmin + 1 OR a.lmin = 1 AND b.lmin > 2)"


def neighbouring(minima):
    a, b = (minima.select(ID, F.col("lmin").alias(side)) for side in "ab")
    after = a.join(b.withColumn("a", F.col("b") - 1), [ID, "a"])
    return after.unionByName(b.where("b > 2").select(ID, F.lit(1).cast("long").alias("a"), "b"))


@query(
    "saddle_paths", MERGED + PAIRS
    + ", anc AS (SELECT landscape_id, lmin AS x, lmin AS at, 0 AS d FROM mn UNION ALL SELECT c.landscape_id, c.x, f.father, d + 1 FROM anc c JOIN fathers f ON f.landscape_id = c.landscape_id AND f.lmin = c.at)"
    + ", meet AS (SELECT pr.landscape_id, a, b, min(u.d) AS da, min(v.d) AS db FROM pr JOIN anc u ON u.landscape_id = pr.landscape_id AND u.x = a JOIN anc v ON v.landscape_id = pr.landscape_id AND v.x = b AND v.at = u.at GROUP BY ALL)"
    + ", onway AS (SELECT m.landscape_id, a, b, u.at FROM meet m JOIN anc u ON u.landscape_id = m.landscape_id AND u.x = a AND u.d < da UNION ALL SELECT m.landscape_id, a, b, u.at FROM meet m JOIN anc u ON u.landscape_id = m.landscape_id AND u.x = b AND u.d < db)"
    + ", best AS (SELECT w.landscape_id, a, b, w.at AS merged, e_saddle, saddle, row_number() OVER (PARTITION BY w.landscape_id, a, b ORDER BY e_saddle DESC, w.at) AS k FROM onway w JOIN fathers f ON f.landscape_id = w.landscape_id AND f.lmin = w.at JOIN tree t ON t.landscape_id = w.landscape_id AND t.lmin = w.at)"
    + " SELECT landscape_id, a, b, merged, e_saddle, saddle FROM pr LEFT JOIN (SELECT * FROM best WHERE k = 1) USING (landscape_id, a, b)",
)
def saddle_paths(spark, sf_dir):
    """The saddle between each minimum and the next one, and the lowest."""
    g = orders(spark, sf_dir)
    return paths.saddles_between(neighbouring(g.minima), g.tree()).select(ID, "a", "b", "merged", "e_saddle", "saddle")


@query("saddle_path_states", MERGED + PAIRS + " SELECT pr.landscape_id, a, b, cast(l.level AS double) AS top, x.n AS first, y.n AS last FROM pr JOIN lev l ON l.landscape_id = pr.landscape_id AND l.lmin = b AND l.o = a JOIN mn x ON x.landscape_id = pr.landscape_id AND x.lmin = a JOIN mn y ON y.landscape_id = pr.landscape_id AND y.lmin = b")
def saddle_path_states(spark, sf_dir):
    """The ways themselves, each told by its ends and by its highest state, which floods find as well."""
    g = orders(spark, sf_dir)
    steps = paths.saddle_paths(neighbouring(g.minima), g.tree(), g.states, g.stepped, g.index)
    return steps.groupBy(ID, "a", "b").agg(F.max("energy").alias("top"), F.min_by("rank", "step").alias("first"), F.max_by("rank", "step").alias("last"))


@query(
    "leaf_places", MERGED
    + ", under AS (SELECT landscape_id, lmin AS x, lmin AS up FROM mn UNION ALL SELECT u.landscape_id, u.x, f.father FROM under u JOIN fathers f ON f.landscape_id = u.landscape_id AND f.lmin = u.up)"
    + ", sizes AS (SELECT landscape_id, up AS lmin, count(*) AS held FROM under GROUP BY ALL)"
    + ", behind AS (SELECT landscape_id, lmin, cast(coalesce(sum(held) OVER (PARTITION BY landscape_id, father ORDER BY CASE WHEN father IS NULL THEN lmin END, e_saddle, lmin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) + CASE WHEN father IS NULL THEN 0 ELSE 1 END AS away FROM tree LEFT JOIN fathers USING (landscape_id, lmin) JOIN sizes USING (landscape_id, lmin))"
    + " SELECT u.landscape_id, x AS lmin, cast(sum(away) AS bigint) AS place FROM under u JOIN behind b ON b.landscape_id = u.landscape_id AND b.lmin = u.up GROUP BY ALL",
)
def leaf_places(spark, sf_dir):
    """Places of all minima along the axis of a drawing of their tree."""
    return post.leaf_order(orders(spark, sf_dir).tree())


@query("early_stop_states", MERGED + ", deep AS (SELECT landscape_id, e_saddle, row_number() OVER (PARTITION BY landscape_id ORDER BY e_saddle, lmin) AS k FROM tree JOIN fathers USING (landscape_id, lmin) WHERE e_saddle - energy >= 2), above AS (SELECT st.landscape_id, min(n) AS first FROM st JOIN deep USING (landscape_id) WHERE k = 4 AND e > e_saddle GROUP BY ALL) SELECT landscape_id, n AS rank FROM st LEFT JOIN above USING (landscape_id) WHERE first IS NULL OR n <= first")
def early_stop_states(spark, sf_dir):
    """The states that are read if no more is wanted than the merges of the first five minima at least 2
    deep."""
    options = LandscapeOptions(move=moves.grid, minh=2.0, most=5, early_stop=True)
    return Landscape(spark, order_cells(spark, sf_dir), options).states.select(ID, "rank")


STRUCTURES = CANONICAL[: CANONICAL.rindex("SELECT p_partkey, q AS sequence")]
SQL_NEAREST = STRUCTURES + """, d AS (SELECT DISTINCT p_brand AS landscape_id, p_size % 2 = 0 AS even, list_sort(list_transform(range(1, len(l) + 1), lambda k: 100 * l[k] + r[k])) AS pairs, array_to_string(list_transform(range(1, 21), lambda x: CASE WHEN list_contains(l, x) THEN '(' WHEN list_contains(r, x) THEN ')' ELSE '.' END), '') AS structure FROM t JOIN part USING (p_partkey)),
nk AS (SELECT *, row_number() OVER (PARTITION BY landscape_id, even ORDER BY structure) AS number FROM d),
m AS (SELECT a.landscape_id, a.number AS source, b.number AS target, len(a.pairs) + len(b.pairs) - 2 * len(list_intersect(a.pairs, b.pairs)) AS distance FROM nk a JOIN nk b ON a.landscape_id = b.landscape_id AND a.even AND NOT b.even)
SELECT landscape_id, source, target, cast(distance AS int) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY landscape_id, source ORDER BY distance, target) AS j FROM m) WHERE j = 1"""


def brand_structures(spark, sf_dir):
    """Structures of the parts of each brand, of even and of odd size. Brands go along with the parts: a join after
    the moves would broadcast the part table, whose files are small for its rows, through the driver."""
    return canonical_moves(table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias(ID), (F.col("p_size") % 2 == 0).alias("even")))


def nearest_structures(spark, sf_dir):
    """For the structures of each brand's parts of even size, the nearest ones of its parts of odd size."""
    found = brand_structures(spark, sf_dir)
    rows = rank_within(found.select(ID, "even", "structure").distinct(), [ID, "even"], ["structure"], "number")
    return post.nearest_structures(rows.where("even").select(ID, F.col("number").alias("source"), "structure"), rows.where("not even").select(ID, F.col("number").alias("target"), F.col("structure").alias("other")))


QUERIES["nearest_structures"], SQL["nearest_structures"] = nearest_structures, SQL_NEAREST

#: Of stream_minima, whose query is in basinflow.streaming.flood.
SQL["stream_minima"] = CELLS + MERGED + "SELECT mn.landscape_id, lmin, mn.n AS rank, q || ',' || d AS structure, cast(mn.e AS double) AS energy, coalesce(father, 0) AS father, e_saddle FROM mn LEFT JOIN (SELECT landscape_id, lmin, father, e_saddle FROM fathers JOIN tree USING (landscape_id, lmin)) USING (landscape_id, lmin)"
