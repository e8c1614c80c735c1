"""Landscapes of strings, spins, permutations, sequences and graphs derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from basinflow.functions import design, lattice, moves, rna, trees
from basinflow.operators import landscape as L
from basinflow.operators import post
from basinflow.operators.graph import spread
from basinflow.plans.grids import DESCENT, NUMBERED, PLATEAU, RATES, SADDLES, WHOLE, Grid, rounded, table
from basinflow.sources.readers import hopfield, spin_string

ID = L.ID
QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def spin_states(spark, sf_dir, bits: int = 6):
    """A landscape a priority: customers' numbers modulo 2 ** bits as spins, energy less the orders."""
    seen = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias(ID), (F.col("o_custkey") % 2**bits).alias("x"))
    cells = seen.groupBy(ID, "x").agg((-F.count("*")).cast("double").alias("energy")).withColumn("structure", spin_string(F.col("x"), bits))
    return L.ranked(cells, "x")


SPINS = """WITH cell AS (SELECT o_orderpriority AS landscape_id, o_custkey % 64 AS x, -count(*) AS e FROM orders GROUP BY ALL),
st AS (SELECT *, row_number() OVER (PARTITION BY landscape_id ORDER BY e, x) AS n FROM cell)
"""
PAIR = "SELECT a.landscape_id, a.n, b.n AS m, cast(a.e AS double) AS e_n, cast(b.e AS double) AS e_m FROM st a JOIN st b ON a.landscape_id = b.landscape_id AND b.n < a.n AND "


@query("spin_edges", SPINS + PAIR + "bit_count(xor(a.x, b.x)) = 1")
def spin_edges(spark, sf_dir):
    return L.look_back_edges(spin_states(spark, sf_dir), moves.spin)


@query("spin_complement_edges", SPINS + PAIR + "xor(a.x, b.x) IN (1, 3, 7, 15, 31, 63)")
def spin_complement_edges(spark, sf_dir):
    return L.look_back_edges(spin_states(spark, sf_dir), moves.spin_complement)


@query("exchange_edges", SPINS + PAIR + "bit_count(xor(a.x, b.x)) = 2 AND bit_count(a.x) = bit_count(b.x)")
def exchange_edges(spark, sf_dir):
    return L.look_back_edges(spin_states(spark, sf_dir), moves.exchange)


@query("spin_minima", SPINS + "SELECT landscape_id, n AS rank, translate(lpad(bin(x), 6, '0'), '01', '+-') AS structure, cast(e AS double) AS energy FROM st WHERE NOT EXISTS (SELECT 1 FROM st b WHERE b.landscape_id = st.landscape_id AND b.n < st.n AND b.e < st.e AND bit_count(xor(st.x, b.x)) = 1)")
def spin_minima(spark, sf_dir):
    states = spin_states(spark, sf_dir)
    return L.steps(states, L.look_back_edges(states, moves.spin)).where("is_min").select(ID, "rank", "structure", "energy")


#: States and edges of the spin landscapes, for what follows them.
SPIN_HEAD = SPINS.replace("WITH cell", "WITH RECURSIVE cell") + ", ed AS (" + PAIR.replace("cast(a.e AS double)", "a.e").replace("cast(b.e AS double)", "b.e") + "bit_count(xor(a.x, b.x)) = 1)"
SPIN_TEXT = "translate(lpad(bin(x), 6, '0'), '01', '+-')"


@query("spin_tree", SPIN_HEAD + WHOLE + f"SELECT landscape_id, lmin, {SPIN_TEXT} AS structure, energy, coalesce(father, 0) AS father, round(e_saddle, 7) AS e_saddle FROM mn JOIN tree USING (landscape_id, lmin) LEFT JOIN fathers USING (landscape_id, lmin)")
def spin_tree(spark, sf_dir):
    g = Grid(spin_states(spark, sf_dir), moves.spin)
    return g.tree().select(ID, "lmin", "structure", "energy", "father", rounded("e_saddle", 7))


@query("spin_saddles", SPIN_HEAD + SADDLES)
def spin_saddles(spark, sf_dir):
    return spin_tree(spark, sf_dir).select(ID, "lmin", "energy", "e_saddle")


DIGITS = """WITH cell AS (SELECT o_orderpriority AS landscape_id, o_custkey % 81 AS x, -count(*) AS e FROM orders GROUP BY ALL),
st AS (SELECT *, x % 3 AS d0, x // 3 % 3 AS d1, x // 9 % 3 AS d2, x // 27 AS d3, row_number() OVER (PARTITION BY landscape_id ORDER BY e, x) AS n FROM cell)
"""


@query("point_mutant_edges", DIGITS + PAIR + "cast(a.d0 <> b.d0 AS int) + cast(a.d1 <> b.d1 AS int) + cast(a.d2 <> b.d2 AS int) + cast(a.d3 <> b.d3 AS int) = 1")
def point_mutant_edges(spark, sf_dir):
    """Strings of four letters over A, B, C."""
    seen = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias(ID), (F.col("o_custkey") % 81).alias("x"))
    cells = seen.groupBy(ID, "x").agg((-F.count("*")).cast("double").alias("energy"))
    text = F.translate(F.lpad(F.conv(F.col("x").cast("string"), 10, 3), 4, "0"), "012", "ABC")
    return L.look_back_edges(L.ranked(cells.withColumn("structure", text), "x"), moves.move_set("Q3"))


PERMUTED = """WITH p AS (SELECT p_type AS landscape_id, list_transform(list_sort([{'v': cast(p_size AS bigint), 'i': 1}, {'v': cast(length(p_name) AS bigint), 'i': 2}, {'v': p_partkey % 50, 'i': 3}, {'v': p_partkey % 31, 'i': 4}]), lambda x: x.i) AS a FROM part),
cell AS (SELECT landscape_id, a, array_to_string(a, ',') AS s, -count(*) AS e FROM p GROUP BY ALL), st AS (SELECT *, row_number() OVER (PARTITION BY landscape_id ORDER BY e, s) AS n FROM cell)
"""
DIFFER = "(SELECT count(*) FROM range(1, 5) t(k) WHERE a.a[k] <> b.a[k])"


def permutations(spark, sf_dir):
    """A landscape a part type: the order of four attributes of a part, energy less the parts."""
    value = lambda v, i: F.struct(v.cast("long").alias("v"), F.lit(i).alias("i"))
    order = F.array_sort(F.array(value(F.col("p_size"), 1), value(F.length("p_name"), 2), value(F.col("p_partkey") % 50, 3), value(F.col("p_partkey") % 31, 4)))
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias(ID), F.array_join(F.transform(order, lambda x: x["i"].cast("string")), ",").alias("structure"))
    return L.ranked(rows.groupBy(ID, "structure").agg((-F.count("*")).cast("double").alias("energy")))


@query("transposition_edges", PERMUTED + PAIR + DIFFER + " = 2")
def transposition_edges(spark, sf_dir):
    return L.look_back_edges(permutations(spark, sf_dir), moves.transposition)


@query("canonical_transposition_edges", PERMUTED + PAIR + DIFFER + " = 2 AND (a.a[1] <> b.a[1] AND a.a[2] <> b.a[2] OR a.a[2] <> b.a[2] AND a.a[3] <> b.a[3] OR a.a[3] <> b.a[3] AND a.a[4] <> b.a[4])")
def canonical_transposition_edges(spark, sf_dir):
    return L.look_back_edges(permutations(spark, sf_dir), moves.canonical_transposition)


@query("reversal_edges", PERMUTED + PAIR + "EXISTS (SELECT 1 FROM range(1, 4) i(i), range(2, 5) j(j) WHERE i < j AND b.a = list_concat(list_concat(a.a[1:i - 1], list_reverse(a.a[i:j])), a.a[j + 1:4]))")
def reversal_edges(spark, sf_dir):
    return L.look_back_edges(permutations(spark, sf_dir), moves.reversal)


TRADE = """WITH w AS (SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 49 AND c_nationkey <> s_nationkey),
cell AS (SELECT c_nationkey AS x, -count(*) AS e FROM customer GROUP BY ALL), st AS (SELECT *, row_number() OVER (ORDER BY e, x) AS n FROM cell)
"""


@query("graph_edges", TRADE + "SELECT '1' AS landscape_id, a.n, b.n AS m, cast(a.e AS double) AS e_n, cast(b.e AS double) AS e_m FROM st a JOIN w ON w.a = a.x JOIN st b ON b.x = w.b WHERE b.n < a.n")
def graph_edges(spark, sf_dir):
    """A general graph: nations with a list of those whose suppliers they order large amounts from."""
    t = lambda name: table(spark, sf_dir, name)
    lines = t("lineitem").where("l_quantity >= 49").select("l_orderkey", "l_suppkey")
    trade = lines.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    listed = trade.where("c_nationkey <> s_nationkey").groupBy("c_nationkey").agg(F.array_join(F.collect_set(F.col("s_nationkey").cast("string")), ":").alias("listed"))
    cells = t("customer").groupBy("c_nationkey").agg((-F.count("*")).cast("double").alias("energy")).join(listed, "c_nationkey", "left")
    states = L.ranked(cells.select(F.lit("1").alias(ID), "c_nationkey", F.col("c_nationkey").cast("string").alias("structure"), "energy", "listed"), "c_nationkey")
    probe = states.select(ID, F.col("rank").alias("n"), F.col("energy").alias("e_n"), F.explode(moves.adjacency(F.col("listed"))).alias("structure"))
    build = states.select(ID, "structure", F.col("rank").alias("m"), F.col("energy").alias("e_m"))
    return probe.join(build, [ID, "structure"]).where("m < n").select(ID, "n", "m", "e_n", "e_m")


FIELD = ("+-+-+-", "++--++", "+++---")


@query("hopfield_energies", "WITH s AS (SELECT DISTINCT o_custkey % 64 AS x FROM orders), t AS (SELECT translate(lpad(bin(x), 6, '0'), '01', '+-') AS structure FROM s), o AS (SELECT structure, p, sum(CASE WHEN substr(structure, cast(k AS int), 1) = substr(p, cast(k AS int), 1) THEN 1 ELSE -1 END) AS v FROM t, (VALUES ('+-+-+-'), ('++--++'), ('+++---')) f(p), range(1, 7) r(k) GROUP BY ALL) SELECT structure, cast(-sum(v * v) AS int) AS energy FROM o GROUP BY ALL")
def hopfield_energies(spark, sf_dir):
    states = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 64).alias("x")).distinct().select(spin_string(F.col("x"), 6).alias("structure"))
    return states.select("structure", hopfield(F.col("structure"), list(FIELD)).cast("int").alias("energy"))


def sequence(n: int = 16):
    return F.translate(F.substring(F.md5(F.col("p_partkey").cast("string")), 1, n), "0123456789abcdef", "ACGUACGUACGUACGU")


SEQUENCE = "SELECT p_partkey, translate(substr(md5(cast(p_partkey AS varchar)), 1, 16), '0123456789abcdef', 'ACGUACGUACGUACGU') AS q FROM part"


@query("rna_open_chain", f"WITH s AS ({SEQUENCE}) SELECT p_partkey, q AS sequence, repeat('.', cast(i - 1 AS int)) || '(' || repeat('.', cast(j - i - 1 AS int)) || ')' || repeat('.', cast(16 - j AS int)) AS structure, false AS is_double FROM s, range(1, 17) a(i), range(1, 17) b(j) WHERE j - i >= 4 AND substr(q, cast(i AS int), 1) || substr(q, cast(j AS int), 1) IN ('AU', 'UA', 'CG', 'GC', 'GU', 'UG')")
def rna_open_chain(spark, sf_dir):
    """All structures one move from the open chain of each part's sequence."""
    rows = spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select("p_partkey", sequence().alias("sequence"))
    found = rna.rna_moves()(F.repeat(F.lit("."), F.length("sequence")), F.col("sequence"))
    return rows.select("p_partkey", "sequence", F.explode(found).alias("x")).select("p_partkey", "sequence", "x.structure", "x.is_double")


CHAIN20 = SEQUENCE.replace("1, 16)", "1, 20)")
FITS = "substr(q, cast({i} AS int), 1) || substr(q, cast({j} AS int), 1) IN ('AU', 'UA', 'CG', 'GC', 'GU', 'UG')"
#: Two steps from the open chain: a stack of two pairs comes first; then it goes again, grows by a pair outside
#: or inside, or a second stack comes beside, around or within it. Moving an end would leave lonely pairs.
CANONICAL = f"""WITH s AS ({CHAIN20}), p AS (SELECT p_partkey, q, i, j FROM s, range(1, 21) a(i), range(1, 21) b(j) WHERE j - i >= 3 AND {FITS.format(i="i", j="j")}),
k AS (SELECT o.p_partkey, o.q, o.i, o.j FROM p o JOIN p n ON n.p_partkey = o.p_partkey AND n.i = o.i + 1 AND n.j = o.j - 1 WHERE o.j - o.i >= 6),
t AS (SELECT p_partkey, q, [] AS l, [] AS r FROM k
UNION ALL SELECT k.p_partkey, k.q, [k.i, k.i + 1, p.i], [k.j, k.j - 1, p.j] FROM k JOIN p ON p.p_partkey = k.p_partkey AND (p.i = k.i - 1 AND p.j = k.j + 1 OR p.i = k.i + 2 AND p.j = k.j - 2)
UNION ALL SELECT k.p_partkey, k.q, [k.i, k.i + 1, n.i, n.i + 1], [k.j, k.j - 1, n.j, n.j - 1] FROM k JOIN k n USING (p_partkey) WHERE n.j < k.i OR n.i > k.j OR n.i + 1 < k.i AND n.j - 1 > k.j AND NOT (n.i + 2 = k.i AND n.j - 2 = k.j) OR n.i > k.i + 1 AND n.j < k.j - 1 AND NOT (n.i = k.i + 2 AND n.j = k.j - 2))
SELECT p_partkey, q AS sequence, structure FROM (SELECT DISTINCT p_partkey, q, array_to_string(list_transform(range(1, 21), lambda x: CASE WHEN list_contains(l, x) THEN '(' WHEN list_contains(r, x) THEN ')' ELSE '.' END), '') AS structure FROM t)"""


def canonical_moves(rows):
    """For rows(p_partkey, ...): two rounds of moves without lonely pairs, with shifts, from the open chain of each
    part's sequence, with the other columns."""
    rows = spread(rows, "p_partkey").withColumn("sequence", sequence(20)).withColumn("structure", F.repeat(F.lit("."), 20))
    kept, step = [c for c in rows.columns if c != "structure"], rna.rna_moves(no_lonely=True, shift=True, second=True)
    for _ in range(2):
        rows = rows.select(*kept, F.explode(step(F.col("structure"), F.col("sequence"))).alias("x")).select(*kept, "x.structure").distinct()
    return rows


@query("rna_canonical_moves", CANONICAL)
def rna_canonical_moves(spark, sf_dir):
    """Two rounds of moves without lonely pairs, with shifts, from the open chain."""
    return canonical_moves(table(spark, sf_dir, "part").select("p_partkey"))


@query("pair_distances", f"WITH s AS ({SEQUENCE}), o AS (SELECT p_partkey, i, j FROM s, range(1, 17) a(i), range(1, 17) b(j) WHERE j - i >= 4 AND substr(q, cast(i AS int), 1) || substr(q, cast(j AS int), 1) IN ('AU', 'UA', 'CG', 'GC', 'GU', 'UG')) SELECT p_partkey, count(*) AS structures, cast(sum(CASE WHEN i = 1 AND j = 16 THEN 0 ELSE 2 END) AS bigint) AS distance FROM o GROUP BY ALL")
def pair_distances(spark, sf_dir):
    """Sum of the base-pair distances of all one-pair structures to the one that pairs both ends."""
    closed = F.concat(F.lit("("), F.repeat(F.lit("."), F.length("structure") - 2), F.lit(")"))
    found = rna_open_chain(spark, sf_dir).select("p_partkey", rna.pair_distance(F.col("structure"), closed).alias("distance"))
    return found.groupBy("p_partkey").agg(F.count("*").alias("structures"), F.sum("distance").cast("long").alias("distance"))


CODE = design.GENETIC_CODE


@query("translated_designs", f"WITH s AS ({SEQUENCE}), c AS (SELECT p_partkey, k, substr('{CODE}', 16 * (strpos('UCAG', substr(q, cast(3 * k + 1 AS int), 1)) - 1) + 4 * (strpos('UCAG', substr(q, cast(3 * k + 2 AS int), 1)) - 1) + strpos('UCAG', substr(q, cast(3 * k + 3 AS int), 1)), 1) AS aa, substr('MAGIC', cast(k + 1 AS int), 1) AS p FROM s, range(0, 5) t(k)) SELECT p_partkey, string_agg(aa, '' ORDER BY k) AS acids, cast(sum(cast(aa <> p AS int)) AS int) AS mutations, cast(CASE WHEN bool_or(aa = '*') THEN -999 ELSE sum(CASE WHEN aa = p THEN 5 ELSE -1 END) END AS int) AS score FROM c GROUP BY ALL")
def translated_designs(spark, sf_dir):
    acids = design.translated(sequence())
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(acids, "").alias("acids"), design.mutations(acids, "MAGIC").alias("mutations"), F.coalesce(design.similarity(acids, "MAGIC"), F.lit(-999)).cast("int").alias("score"))


MUTANTS = f"""WITH s AS ({SEQUENCE}), o AS (SELECT p_partkey, substr(q, 1, 7) || translate(reverse(substr(q, 1, 3)), 'ACGU', 'UGCA') || substr(q, 11, 6) AS q FROM s),
m AS (SELECT p_partkey, q, substr(q, 1, i - 1) || b || substr(q, i + 1) AS x FROM o, (VALUES (4), (5), (6), (7), (11), (12), (13), (14), (15), (16)) t(i), (VALUES ('A'), ('C'), ('G'), ('U')) u(b) WHERE b <> substr(q, i, 1)
UNION ALL SELECT p_partkey, q, substr(q, 1, i - 1) || b[1] || substr(q, i + 1, j - i - 1) || b[2] || substr(q, j + 1) FROM o, (VALUES (1, 10), (2, 9), (3, 8)) t(i, j), (VALUES ('AU'), ('CG'), ('GC'), ('UA')) u(b) WHERE b <> substr(q, i, 1) || substr(q, j, 1)),
c AS (SELECT p_partkey, q, x, substr('{CODE}', 16 * (strpos('UCAG', substr(x, cast(3 * k + 1 AS int), 1)) - 1) + 4 * (strpos('UCAG', substr(x, cast(3 * k + 2 AS int), 1)) - 1) + strpos('UCAG', substr(x, cast(3 * k + 3 AS int), 1)), 1) AS aa, substr('MAGIC', cast(k + 1 AS int), 1) AS p FROM m, range(0, 5) t(k))
SELECT p_partkey, q AS sequence, x AS mutant FROM c GROUP BY ALL HAVING NOT bool_or(aa = '*') AND sum(cast(aa <> p AS int)) <= 5 AND sum(CASE WHEN aa = p THEN 5 ELSE -1 END) >= -5"""


@query("design_mutants", MUTANTS)
def design_mutants(spark, sf_dir):
    """Mutants of each part's sequence that respect a hairpin and stay close to a protein."""
    structure = "(((....)))......"
    close = F.translate(F.reverse(F.substring("q", 1, 3)), "ACGU", "UGCA")
    rows = table(spark, sf_dir, "part").select("p_partkey", sequence().alias("q")).select("p_partkey", F.concat(F.substring("q", 1, 7), close, F.substring("q", 11, 6)).alias("sequence"))
    found = design.mutants(structure, "MAGIC", 5, -5)(F.col("sequence"))
    return rows.select("p_partkey", "sequence", F.explode(found).alias("mutant"))


def pairs_as_values(listed: str) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in lattice.both_ways(listed).items())


LATTICE = f"""WITH w(a, b) AS (VALUES {pairs_as_values(lattice.SQUARE)}), e(a, b) AS (VALUES {pairs_as_values(lattice.SQUARE_ENDS)}),
s AS (SELECT p_partkey, translate(substr(md5(cast(p_partkey AS varchar)), 1, 12), '0123456789abcdef', 'FLRFLRFLRFLRFLRF') AS chain FROM part),
t AS (SELECT s.*, i, coalesce(x.b, y.b) AS new FROM s CROSS JOIN range(2, 11) r(i) LEFT JOIN w x ON x.a = substr(chain, cast(i AS int), 3) LEFT JOIN w y ON y.a = substr(chain, cast(i AS int), 4))
SELECT p_partkey, chain, substr(chain, 1, cast(i - 1 AS int)) || new || substr(chain, cast(i + length(new) AS int)) AS neighbour FROM t WHERE new IS NOT NULL
UNION ALL SELECT p_partkey, chain, substr(chain, 1, 10) || e.b FROM s JOIN e ON e.a = substr(chain, 11, 2)
UNION ALL SELECT p_partkey, chain, substr(chain, 1, 11) || c FROM s, (VALUES ('F'), ('L'), ('R')) l(c) WHERE c <> substr(chain, 12, 1)"""


@query("lattice_moves", LATTICE)
def lattice_moves(spark, sf_dir):
    """Local moves of chains on the square lattice, one chain a part."""
    chain = F.translate(F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 12), "0123456789abcdef", "FLRFLRFLRFLRFLRF")
    rows = table(spark, sf_dir, "part").select("p_partkey", chain.alias("chain"))
    return rows.select("p_partkey", "chain", F.explode(lattice.crankshaft("FLR")(F.col("chain"))).alias("neighbour"))


def joined_sql(t) -> tuple[str, str]:
    """SQL for the least leaf and the text of a nested pair of leaf columns, the subtree of smaller least
    leaf first."""
    if isinstance(t, str):
        return t, f"cast({t} AS varchar)"
    (a, x), (b, y) = map(joined_sql, t)
    return f"least({a}, {b})", f"CASE WHEN {a} < {b} THEN '(' || {x} || ')(' || {y} || ')' ELSE '(' || {y} || ')(' || {x} || ')' END"


LEFT, RIGHT = ("l0", "l1"), ("l2", ("l3", "l4"))
SWAPPED = [((RIGHT, "l1"), "l0"), (("l0", RIGHT), "l1"), ((LEFT, RIGHT[1]), "l2"), (("l2", LEFT), RIGHT[1]), ((("l2", "l4"), "l3"), LEFT), ((("l3", "l2"), "l4"), LEFT)]
LEAVES = ", ".join(f"(k + {i}) % 5 + 2 AS l{i}" for i in range(5))


@query("tree_interchanges", f"WITH b AS (SELECT p_brand, min(p_partkey) AS k FROM part GROUP BY ALL), l AS (SELECT p_brand, {LEAVES} FROM b), t AS (SELECT *, '((1)((' || l0 || ')(' || l1 || '))((' || l2 || ')((' || l3 || ')(' || l4 || '))))' AS tree FROM l) " + " UNION ALL ".join(f"SELECT p_brand, tree, '((1)' || {joined_sql(x)[1]} || ')' AS neighbour FROM t" for x in SWAPPED))
def tree_interchanges(spark, sf_dir):
    """Interchanges of one tree a brand: leaves 2 to 6 in the order of the brand's first parts."""
    brands = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("k"))
    leaf = lambda i: (F.pmod(F.col("k") + i, F.lit(5)) + 2).cast("string")
    tree = F.concat(F.lit("((1)(("), leaf(0), F.lit(")("), leaf(1), F.lit("))(("), leaf(2), F.lit(")(("), leaf(3), F.lit(")("), leaf(4), F.lit("))))"))
    rows = brands.select("p_brand", tree.alias("tree"))
    return rows.select("p_brand", "tree", F.explode(trees.nni("tree")).alias("neighbour"))


@query("hamming_neighbors", "WITH p AS (SELECT p_partkey, p_name, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS o FROM part) SELECT p_partkey, cast((SELECT count(*) FROM range(1, 200) r(k) WHERE k <= least(length(p_name), length(o)) AND substr(p_name, cast(k AS int), 1) <> substr(o, cast(k AS int), 1)) AS int) AS distance FROM p WHERE o IS NOT NULL")
def hamming_neighbors(spark, sf_dir):
    from pyspark.sql.window import Window

    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.lead("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("o"))
    return rows.where("o is not null").select("p_partkey", rna.hamming(F.col("p_name"), F.col("o")).alias("distance"))


CROSS = ", nw AS (SELECT landscape_id, lmin, lmin % 2 = 1 AS bound, row_number() OVER (PARTITION BY landscape_id ORDER BY lmin % 2 = 1, lmin) AS new_id FROM mn), f AS (SELECT landscape_id, i, j, sum(w) / z AS rate FROM r JOIN z USING (landscape_id, i) GROUP BY landscape_id, i, j, z) "


@query("cross_rates", SPIN_HEAD + WHOLE + RATES + CROSS + "SELECT f.landscape_id, a.new_id AS i, b.new_id AS j, round(rate * CASE WHEN NOT a.bound AND b.bound THEN 6.0 WHEN a.bound AND NOT b.bound THEN 2.0 ELSE 1.0 END, 6) AS rate FROM f JOIN nw a ON a.landscape_id = f.landscape_id AND a.lmin = f.i JOIN nw b ON b.landscape_id = f.landscape_id AND b.lmin = f.j")
def cross_rates(spark, sf_dir):
    """Rates of the spin landscapes with minima of odd number marked as bound, reordered and scaled."""
    g = Grid(spin_states(spark, sf_dir), moves.spin)
    order = post.reordered(g.minima.withColumn("structure", F.when(F.col("lmin") % 2 == 1, F.concat("structure", F.lit("*"))).otherwise(F.col("structure"))))
    rates = L.rates(g.states, g.edges, g.index.withColumnRenamed("lmin", "label"))
    return post.cross_rates(rates, order, association=2.0, concentration=3.0).select(ID, "i", "j", rounded("rate"))


MAPPED = """, oc AS (SELECT o_orderpriority AS landscape_id, o_custkey % 64 AS x, -count(*) AS e FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL), ost AS (SELECT *, row_number() OVER (PARTITION BY landscape_id ORDER BY e, x) AS n FROM oc),
om AS (SELECT *, row_number() OVER (PARTITION BY landscape_id ORDER BY n) AS lmin FROM ost WHERE NOT EXISTS (SELECT 1 FROM ost b WHERE b.landscape_id = ost.landscape_id AND b.e < ost.e AND bit_count(xor(ost.x, b.x)) = 1))
SELECT landscape_id, source, target, distance, distance = 0 AS exact FROM (SELECT a.landscape_id, a.lmin AS source, b.lmin AS target, cast(bit_count(xor(a.x, b.x)) AS int) AS distance, row_number() OVER (PARTITION BY a.landscape_id, a.lmin ORDER BY bit_count(xor(a.x, b.x)), b.lmin) AS k FROM mn a JOIN om b USING (landscape_id)) WHERE k = 1"""


@query("mapped_trees", SPIN_HEAD + WHOLE + MAPPED)
def mapped_trees(spark, sf_dir):
    """Minima of each priority's spin landscape in the tree of the same spins over orders not yet closed."""
    first = Grid(spin_states(spark, sf_dir), moves.spin).minima
    other = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderpriority").alias(ID), (F.col("o_custkey") % 64).alias("x")).groupBy(ID, "x").agg((-F.count("*")).cast("double").alias("energy")).withColumn("structure", spin_string(F.col("x"), 6))
    second = Grid(L.ranked(other, "x"), moves.spin).minima
    return post.mapped_trees(first, second, rna.hamming, 1)


@query("saddle_graph", SPIN_HEAD + WHOLE + "SELECT landscape_id, comp AS saddle, cast(e AS double) AS energy, lmin FROM own WHERE (landscape_id, comp) IN (SELECT (landscape_id, comp) FROM own GROUP BY ALL HAVING count(*) > 1)")
def saddle_graph(spark, sf_dir):
    return post.saddle_graph(Grid(spin_states(spark, sf_dir), moves.spin).components(), most=None)


def order_states(spark, sf_dir, bits: int = 20):
    """One landscape of all orders, which grows with the table: numbers modulo 2 ** bits as spins, energy less
    the thousands of the price."""
    seen = table(spark, sf_dir, "orders").select(F.lit("orders").alias(ID), (F.col("o_orderkey") % 2**bits).alias("x"), (-F.floor(F.col("o_totalprice") / 1000)).cast("double").alias("e"))
    return L.ranked(seen.groupBy(ID, "x").agg(F.min("e").alias("energy")).withColumn("structure", spin_string(F.col("x"), bits)), "x")


#: States and edges of the landscape of all orders: 20 flips of each state, looked up.
ORDERS = """WITH RECURSIVE st AS (SELECT 'orders' AS landscape_id, x, e, row_number() OVER (ORDER BY e, x) AS n FROM (SELECT o_orderkey % 1048576 AS x, cast(min(-floor(o_totalprice / 1000)) AS bigint) AS e FROM orders GROUP BY ALL)),
ed AS (SELECT a.landscape_id, a.n, b.n AS m, a.e AS e_n, b.e AS e_m FROM (SELECT *, xor(x, cast(1 << k AS bigint)) AS y FROM st, range(0, 20) t(k)) a JOIN st b ON b.x = a.y WHERE b.n < a.n)"""


@query("order_spin_edges", ORDERS + "SELECT landscape_id, n, m FROM ed")
def order_spin_edges(spark, sf_dir):
    return L.look_back_edges(order_states(spark, sf_dir), moves.spin).select(ID, "n", "m")


@query("order_spin_basins", ORDERS + NUMBERED + DESCENT + "SELECT landscape_id, n AS rank, lmin FROM gb")
def order_spin_basins(spark, sf_dir):
    return Grid(order_states(spark, sf_dir), moves.spin).index


@query("order_spin_plateaus", ORDERS + NUMBERED + PLATEAU + "SELECT landscape_id, comp, count(*) AS size FROM (SELECT landscape_id, a, min(b) AS comp FROM reach GROUP BY ALL) GROUP BY ALL")
def order_spin_plateaus(spark, sf_dir):
    g = Grid(order_states(spark, sf_dir), moves.spin)
    return L.plateau_components(g.states, g.edges).groupBy(ID, "comp").agg(F.count("*").alias("size"))


@query("order_spin_tree")
def order_spin_tree(spark, sf_dir):
    """The merge tree of all orders. (As SQL it would need every minimum's flood over all states.)"""
    return Grid(order_states(spark, sf_dir), moves.spin).tree().select(ID, "lmin", "energy", "father", rounded("e_saddle", 7))
