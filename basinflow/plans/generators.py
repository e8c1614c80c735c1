"""Queries of what is generated from rows of the given tables: designs under constraints, and trees by number
or by chance."""

from __future__ import annotations

from pyspark.sql import functions as F

from basinflow.functions import design, rna, trees
from basinflow.operators import paths
from basinflow.operators.graph import spread
from basinflow.plans.grids import table
from basinflow.plans.strings import CODE, sequence

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


ACID = f"substr('{CODE}', 16 * (strpos('UCAG', substr({{x}}, cast(3 * k + 1 AS int), 1)) - 1) + 4 * (strpos('UCAG', substr({{x}}, cast(3 * k + 2 AS int), 1)) - 1) + strpos('UCAG', substr({{x}}, cast(3 * k + 3 AS int), 1)), 1)"
DESIGNS = f"""WITH s AS (SELECT p_partkey, translate(substr(md5(cast(p_partkey AS varchar)), 1, 15), '0123456789abcdef', 'ACGUACGUACGUACGU') AS q FROM part),
b(c) AS (VALUES ('A'), ('C'), ('G'), ('U')),
x AS (SELECT p_partkey, q, b1.c || substr(q, 2, 4) || b6.c || substr(q, 7, 1) || b8.c || substr(q, 9, 3) || b12.c || substr(q, 13, 2) || b15.c AS sequence FROM s, b b1, b b6, b b8, b b12, b b15 WHERE b8.c IN ('A', 'G') AND b12.c IN ('C', 'U') AND b1.c || b15.c IN ('AU', 'CG', 'GC', 'UA')),
c AS (SELECT p_partkey, sequence, {ACID.format(x="sequence")} AS aa, {ACID.format(x="q")} AS p FROM x, range(0, 5) t(k))
SELECT p_partkey, sequence, cast(sum(cast(aa <> p AS int)) AS int) AS mutations, cast(sum(CASE WHEN aa = p THEN 5 ELSE -1 END) AS int) AS score FROM (SELECT p_partkey, sequence, aa, replace(p, '*', 'W') AS p FROM c) GROUP BY ALL HAVING NOT bool_or(aa = '*') AND sum(cast(aa <> p AS int)) <= 2 AND sum(CASE WHEN aa = p THEN 5 ELSE -1 END) >= 13"""


@query("pruned_designs", DESIGNS)
def pruned_designs(spark, sf_dir):
    """Sequences that code for nearly the same protein as each part's own, some bases of which are free."""
    q, part = F.col("q"), lambda at, n: F.substring("q", at, n)
    rows = table(spark, sf_dir, "part").select("p_partkey", sequence(15).alias("q"))
    free = F.concat(F.lit("N"), part(2, 4), F.lit("N"), part(7, 1), F.lit("R"), part(9, 3), F.lit("Y"), part(13, 2), F.lit("N"))
    asked = rows.select("p_partkey", free.alias("constraint"), F.translate(F.array_join(design.translated(q), ""), "*", "W").alias("protein"))
    return design.pruned_sequences(asked, "(.............)", 2, 13).select("p_partkey", "sequence", "mutations", "score")


def planting(base: str, leaves: int) -> str:
    """SQL for the trees of base(key, places): each leaf wraps the group that its place counts to."""
    return f"""WITH RECURSIVE base AS ({base}),
plant AS (SELECT key, places, 4 AS leaf, '{trees.SEED}' AS s FROM base
UNION ALL SELECT key, places, leaf + 1, CASE WHEN p = 0 THEN substr(s, 1, 4) || '(' || substr(s, 5, length(s) - 5) || ')(' || leaf || '))' ELSE substr(s, 1, a - 1) || '(' || substr(s, a, z - a + 1) || '(' || leaf || '))' || substr(s, z + 1) END
FROM (SELECT *, list_filter(range(a, length(s) + 1), lambda j: length(replace(substr(s, a, j - a + 1), '(', '')) = length(replace(substr(s, a, j - a + 1), ')', '')))[1] AS z FROM (SELECT *, places[leaf - 3] AS p, CASE WHEN places[leaf - 3] > 0 THEN list_filter(range(5, length(s) + 1), lambda i: substr(s, i, 1) = '(')[places[leaf - 3]] END AS a FROM plant WHERE leaf <= {leaves})))
"""


@query("random_trees", planting("SELECT c_custkey AS key, list_transform(range(4, 9), lambda n: cast(('0x' || substr(md5('11:' || c_custkey || ':' || n), 1, 8)) AS bigint) % (2 * n - 5)) AS places FROM customer", 8) + "SELECT key AS c_custkey, s AS tree FROM plant WHERE leaf = 9")
def random_trees(spark, sf_dir):
    """A random tree of eight leaves for each customer."""
    return trees.random_trees(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 8, seed=11)


RANKED = "SELECT s_suppkey AS key, s_suppkey % 135135 AS rank, [r // 45045, r // 9009 % 5, r // 1287 % 7, r // 143 % 9, r // 13 % 11, r % 13] AS places FROM (SELECT s_suppkey, s_suppkey % 135135 AS r FROM supplier)"


@query("tree_slice", planting(RANKED, 9) + "SELECT key AS s_suppkey, key % 135135 AS rank, s AS tree, key % 135135 AS back, (SELECT cast(product(2 * n - 5) AS bigint) FROM range(4, 10) t(n)) AS trees FROM plant WHERE leaf = 10")
def tree_slice(spark, sf_dir):
    """The trees of nine leaves that have suppliers' keys as their numbers, and their numbers read back."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % trees.count_trees(9)).alias("rank"))
    made = rows.withColumn("tree", trees.from_places(trees.rank_places(F.col("rank"), 9)))
    return made.withColumn("back", trees.places_rank(trees.to_places("tree"), 9)).withColumn("trees", F.lit(trees.count_trees(9)).cast("long"))


PAIR_ENERGIES = {"GC": -3.0, "CG": -3.0, "AU": -2.0, "UA": -2.0, "GU": -1.0, "UG": -1.0}
START, TARGET = "((.(....).........))", ".....((....))..(..)."
#: Pairs of both structures, with 1 for those that a way adds; 4 and 8 cross 16 and 32.
TOGGLES = ((1, 20, 0), (2, 19, 0), (4, 9, 0), (6, 13, 1), (7, 12, 1), (16, 19, 1))
DIRECT = f"""WITH RECURSIVE s AS (SELECT p_partkey, translate(substr(md5(cast(p_partkey AS varchar)), 1, 20), '0123456789abcdef', 'ACGUACGUACGUACGU') AS q FROM part),
t(k, i, j, adds) AS (VALUES {', '.join(f'({k}, {i}, {j}, {a})' for k, (i, j, a) in enumerate(TOGGLES))}),
pe AS (SELECT p_partkey, k, adds, coalesce(v, 1.0) AS v FROM (SELECT p_partkey, k, adds, substr(q, i, 1) || substr(q, j, 1) AS ends FROM s, t) LEFT JOIN (VALUES {', '.join(f"('{p}', {v})" for p, v in PAIR_ENERGIES.items())}) w(ends, v) USING (ends)),
en AS (SELECT p_partkey, m, sum(CASE WHEN (m >> k) & 1 = adds THEN v ELSE 0 END) AS e FROM pe, range(0, 64) r(m) WHERE (m & 24 = 0 OR m & 4 > 0) AND (m & 32 = 0 OR m & 2 > 0) GROUP BY ALL),
fl AS (SELECT p_partkey, m, e AS top FROM en WHERE m = 0 UNION SELECT f.p_partkey, n.m, greatest(f.top, n.e) FROM fl f JOIN en n ON n.p_partkey = f.p_partkey AND n.m > f.m AND bit_count(xor(f.m, n.m)) = 1)
SELECT p_partkey, cast(min(top) AS double) AS saddle_energy FROM fl WHERE m = 63 GROUP BY ALL"""


@query("direct_path_saddles", DIRECT)
def direct_path_saddles(spark, sf_dir):
    """The barrier of the direct paths between two structures for each part's sequence."""
    parts = spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select("p_partkey", sequence(20).alias("sequence"))
    asked = parts.select("sequence", F.lit(START).alias("start"), F.lit(TARGET).alias("target"))
    found = paths.direct_saddles(asked, lambda q, s: rna.pair_sum(q, s, PAIR_ENERGIES, 1.0))
    return parts.join(found, "sequence").select("p_partkey", "saddle_energy")
