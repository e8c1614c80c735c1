"""Queries of landscapes of bound and unbound RNA structures."""

from __future__ import annotations

from pyspark.sql import functions as F

from basinflow.functions import rna
from basinflow.operators import landscape as L
from basinflow.plans.analysis import Landscape, LandscapeOptions
from basinflow.plans.grids import FOLDED, ID, NUMBERED, RATES, SADDLE, WHOLE, rounded, table

QUERIES, SQL = {}, {}
#: The sequence of all these landscapes.
SEQUENCE = "GACGUCAGUCGA"


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return keep


def ligand_states(spark, sf_dir):
    """A landscape a brand: structures of at most one pair, unbound and bound, that some parts fall to by
    their keys and sizes; energy less the parts."""
    chain = spark.range(1).select(F.lit(SEQUENCE).alias("q"), F.repeat(F.lit("."), len(SEQUENCE)).alias("structure"))
    found = chain.select(F.explode(rna.rna_moves()(F.col("structure"), F.col("q"))).alias("x")).select("x.structure").unionByName(chain.select("structure"))
    cell = found.select("structure", ((F.instr("structure", "(") * 7 + F.instr("structure", ")")) % 16).cast("long").alias("k"))
    parts = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias(ID), (F.col("p_partkey") % 16).alias("k"), (F.col("p_size") % 2 == 1).alias("bound")).agg((-F.count("*")).cast("double").alias("energy"))
    states = parts.join(cell, "k").select(ID, F.concat("structure", F.when(F.col("bound"), "*").otherwise("")).alias("structure"), "energy")
    return L.ranked(states)


N = len(SEQUENCE)
LIGANDS = f"""WITH RECURSIVE o AS (SELECT 0 AS i, 0 AS j UNION ALL SELECT i, j FROM range(1, {N + 1}) a(i), range(1, {N + 1}) b(j) WHERE j - i >= 4 AND substr('{SEQUENCE}', cast(i AS int), 1) || substr('{SEQUENCE}', cast(j AS int), 1) IN ('AU', 'UA', 'CG', 'GC', 'GU', 'UG')),
cell AS (SELECT p_brand AS landscape_id, p_partkey % 16 AS k, p_size % 2 = 1 AS bound, -count(*) AS e FROM part GROUP BY ALL),
st AS (SELECT *, row_number() OVER (PARTITION BY landscape_id ORDER BY e, structure) AS n FROM (SELECT landscape_id, i, j, bound, e, CASE WHEN i = 0 THEN repeat('.', {N}) ELSE repeat('.', cast(i - 1 AS int)) || '(' || repeat('.', cast(j - i - 1 AS int)) || ')' || repeat('.', cast({N} - j AS int)) END || CASE WHEN bound THEN '*' ELSE '' END AS structure FROM cell JOIN o ON (7 * i + j) % 16 = k)),
ed AS (SELECT a.landscape_id, a.n, b.n AS m, a.e AS e_n, b.e AS e_m FROM st a JOIN st b ON a.landscape_id = b.landscape_id AND b.n < a.n AND a.bound = b.bound AND (a.i = 0) <> (b.i = 0))"""
#: Binding and release, which only rates count.
TOGGLED = ", red AS (SELECT * FROM ed UNION ALL SELECT a.landscape_id, a.n, b.n, a.e, b.e FROM st a JOIN st b ON a.landscape_id = b.landscape_id AND b.n < a.n AND a.bound <> b.bound AND a.i = b.i AND a.j = b.j)"
TRUE = (
    ", lv AS (SELECT f.landscape_id, f.lmin, min(mn.lmin) AS root FROM flood f JOIN mn ON mn.landscape_id = f.landscape_id AND mn.n = f.at GROUP BY ALL), "
    "good AS (SELECT landscape_id, t.lmin, round(e_saddle - energy, 7) AS barrier, root, mn.bound FROM (SELECT *, count(*) OVER (PARTITION BY landscape_id) AS c FROM tree) t JOIN lv USING (landscape_id, lmin) JOIN mn USING (landscape_id, lmin) WHERE c = 1 OR e_saddle - energy - 0.5 + 1.1920928955078125e-07 >= 0), "
    "low2 AS (SELECT landscape_id, mn.bound, arg_min(mn.lmin, (mn.e, mn.lmin)) AS root FROM (SELECT DISTINCT landscape_id, root FROM good) g JOIN mn ON mn.landscape_id = g.landscape_id AND mn.lmin = g.root GROUP BY ALL)"
).replace("SELECT landscape_id, mn.bound, arg_min", "SELECT mn.landscape_id, mn.bound, arg_min")


@query("ligand_minima", LIGANDS + NUMBERED + SADDLE + TRUE + " SELECT good.landscape_id, lmin, row_number() OVER (PARTITION BY good.landscape_id ORDER BY lmin) AS true_id, barrier, good.bound FROM good JOIN low2 ON low2.landscape_id = good.landscape_id AND low2.root = good.root")
def ligand_minima(spark, sf_dir):
    """Minima in the trees of the lowest bound and of the lowest unbound state."""
    found = Landscape(spark, ligand_states(spark, sf_dir), LandscapeOptions(graph="RNA", moves="ligand", sequence=SEQUENCE, minh=0.5, most=0, connected=True)).true_minima
    return found.select(ID, "lmin", "true_id", rounded("barrier", 7), F.col("structure").endswith("*").alias("bound"))


KT = f"/ {L.kt(None, True)!r})"


@query("ligand_rates", LIGANDS + TOGGLED + WHOLE + FOLDED.replace("- 2.0 +", "- 1e-6 +") + RATES.replace("JOIN gb", "JOIN tb").replace("FROM gb", "FROM tb").replace("FROM ed JOIN", "FROM red ed JOIN").replace("/ 1.0)", KT) + "SELECT landscape_id, i, j, round(sum(w) / z, 6) AS rate FROM r JOIN z USING (landscape_id, i) GROUP BY landscape_id, i, j, z")
def ligand_rates(spark, sf_dir):
    """Rates between all minima, bound and unbound, where binding and release are steps as well."""
    found = Landscape(spark, ligand_states(spark, sf_dir), LandscapeOptions(graph="RNA", moves="ligand", sequence=SEQUENCE, most=0)).rates
    return found.select(ID, "i", "j", rounded("rate"))
