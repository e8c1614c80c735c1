"""Queries that go through the library's files, and moves and scores of sequences, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from basinflow.functions import design, moves, rna
from basinflow.operators import landscape as L
from basinflow.operators.graph import checkpoint_dir
from basinflow.plans.grids import FOLDED, RATES, WHOLE, Grid, orders, rounded, table
from basinflow.plans.grids import CELLS, PLATEAU, REPLAY, SADDLE
from basinflow.plans.strings import MAPPED, ORDERS, SEQUENCE, SPIN_HEAD, mapped_trees, order_states, sequence
from basinflow.sources import readers, sinks
from basinflow.sources.readers import spin_string

ID = L.ID
QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("text_landscape", ORDERS + " SELECT n AS rank, translate(lpad(bin(x), 20, '0'), '01', '+-') AS structure, cast(e AS double) AS energy, (x % 5) || ' ' || (x % 7) AS objectives FROM st")
def text_landscape(spark, sf_dir):
    """The landscape of all orders, written as text and read back."""
    states = order_states(spark, sf_dir).withColumn("pov", F.array(F.col("x") % 5, F.col("x") % 7))
    path = folder(spark, "landscape")
    sinks.write_landscape(states, "orders -999 P:2 Q2 price", path)
    head = readers.read_header(spark, path)
    back = readers.read_landscape(spark, path, header=head)
    return back.select("rank", "structure", "energy", F.array_join(F.transform("pov", lambda x: x.cast("string")), " ").alias("objectives"))


def one_spin_grid(spark, sf_dir) -> Grid:
    """One landscape of customers' numbers modulo 64 over all orders."""
    seen = table(spark, sf_dir, "orders").select(F.lit("1").alias(ID), (F.col("o_custkey") % 64).alias("x"))
    cells = seen.groupBy(ID, "x").agg((-F.count("*")).cast("double").alias("energy")).withColumn("structure", spin_string(F.col("x"), 6))
    return Grid(L.ranked(cells, "x"), moves.spin)


ONE = SPIN_HEAD.replace("o_orderpriority AS landscape_id", "'1' AS landscape_id") + WHOLE
TEXT = "translate(lpad(bin({x}), 6, '0'), '01', '+-')"


@query("bar_file", ONE + f"SELECT landscape_id, lmin, {TEXT.format(x='mn.x')} AS structure, energy, coalesce(father, 0) AS father, round(e_saddle - energy, 5) AS barrier, round(e_saddle, 5) AS e_saddle, false AS bound FROM mn JOIN tree USING (landscape_id, lmin) LEFT JOIN fathers USING (landscape_id, lmin)")
def bar_file(spark, sf_dir):
    path = folder(spark, "bar")
    sinks.write_bar(one_spin_grid(spark, sf_dir).tree(), "spins", path)
    return readers.read_bar(spark, path).withColumn("e_saddle", F.round("e_saddle", 5))


@query("saddles_file", ONE + f"SELECT cast(s.e AS double) AS energy, size, {TEXT.format(x='st.x')} AS saddle, list_aggregate(ids, 'string_agg', ' ') AS minima FROM (SELECT DISTINCT landscape_id, comp, e, ids, size FROM turn WHERE len(ids) > 1) s JOIN st ON st.n = s.comp")
def saddles_file(spark, sf_dir):
    g, path = one_spin_grid(spark, sf_dir), folder(spark, "saddles")
    sinks.write_saddles(g.components(), g.states, path)
    return readers.read_saddles(spark, path).select("energy", "size", "saddle", F.array_join(F.transform("minima", lambda x: x.cast("string")), " ").alias("minima"))


@query("rates_files", ONE + RATES + "SELECT i, j, round(sum(w) / z, 6) AS rate, true AS in_text FROM r JOIN z USING (landscape_id, i) GROUP BY i, j, z")
def rates_files(spark, sf_dir):
    """Rates through the binary file, and whether the text file has the same entry to four digits."""
    g, path = one_spin_grid(spark, sf_dir), folder(spark, "rates")
    rates = L.rates(g.states, g.edges, g.index.withColumnRenamed("lmin", "label"))
    sinks.write_text_rates(rates, f"{path}/text")
    sinks.write_binary_rates(rates, f"{path}/binary")
    text = readers.numbered(spark.read.text(f"{path}/text")).select(F.col("line").alias("i"), F.posexplode(readers.tokens(F.col("value"))).alias("k", "entry")).select("i", (F.col("k") + 1).cast("long").alias("j"), F.col("entry").cast("double").alias("entry"))
    held = rates.select("i", "j").join(readers.read_binary_rates(spark, f"{path}/binary"), ["i", "j"], "left")  # of 0 there are no rows
    met = held.select("i", "j", F.coalesce("rate", F.lit(0.0)).alias("rate")).join(text, ["i", "j"])
    return met.select("i", "j", rounded("rate"), (F.abs(F.col("entry") - F.col("rate")) <= F.abs("rate") * 0.001).alias("in_text"))


@query("map_lines", ONE + f"SELECT {TEXT.format(x='st.x')} AS structure, printf('%s %6d %6.2f %6d %6d', {TEXT.format(x='mn.x')}, st.n, cast(st.e AS double), mn.lmin, coalesce(mn.lmin, 0)) AS value FROM st JOIN gb USING (landscape_id, n) JOIN mn ON mn.lmin = gb.lmin UNION ALL SELECT '+', '+ not found'")
def map_lines(spark, sf_dir):
    """Lines for all spin strings of the landscape, and for one that it lacks; minima of any depth are true."""
    g = one_spin_grid(spark, sf_dir)
    tree = g.tree()
    asked = g.states.select(ID, "structure").unionByName(spark.createDataFrame([("1", "+")], f"{ID} string, structure string"))
    return sinks.map_lines(L.map_structures(asked, g.states, g.basins, g.minima, tree, L.true_minima(tree, minh=-1.0))).select("structure", "value")


@query("tree_map_lines", SPIN_HEAD + WHOLE + MAPPED.replace("SELECT landscape_id, source, target, distance, distance = 0 AS exact FROM", "SELECT landscape_id, source, printf('%4d %s %4d', source, CASE WHEN distance = 0 THEN '->' ELSE '~>' END, target) AS value FROM"))
def tree_map_lines(spark, sf_dir):
    return sinks.tree_map_lines(mapped_trees(spark, sf_dir))


@query("connected_minima", CELLS + PLATEAU + SADDLE + REPLAY + FOLDED + "SELECT landscape_id, tm.lmin, row_number() OVER (PARTITION BY landscape_id ORDER BY tm.lmin) AS true_id FROM tm JOIN (SELECT landscape_id, lmin, min(o) AS root FROM lev GROUP BY ALL) USING (landscape_id, lmin) WHERE root = 1")
def connected_minima(spark, sf_dir):
    """True minima of the ground state's tree."""
    return L.true_minima(orders(spark, sf_dir).tree(), minh=2.0, connected=True).select(ID, "lmin", "true_id")


@query("connected_states", CELLS + PLATEAU + SADDLE + REPLAY + FOLDED + "SELECT landscape_id, row_number() OVER (PARTITION BY landscape_id ORDER BY st.n) AS number, q || ',' || d AS structure, cast(e AS double) AS energy, tb.lmin AS true_id, gb.lmin FROM st JOIN tb USING (landscape_id, n) JOIN gb USING (landscape_id, n)")
def connected_states(spark, sf_dir):
    """States that count for a true minimum, numbered anew."""
    g = orders(spark, sf_dir)
    tree = g.tree()
    labels = g.index.join(L.folded(tree, L.true_minima(tree, minh=2.0)), [ID, "lmin"]).select(ID, "rank", F.col("true_id").alias("label"))
    return sinks.connected_states(g.states, labels, g.index)


CUT = "SELECT p_partkey, substr(q, 1, cast(p_partkey % 15 + 1 AS int)) || '&' || substr(q, cast(p_partkey % 15 + 2 AS int)) AS costring, q AS text, cast(p_partkey % 15 + 2 AS int) AS cut"


@query("strand_cuts", f"WITH s AS ({SEQUENCE}), c AS ({CUT} FROM s) SELECT p_partkey, costring, text, cut, costring AS back FROM c")
def strand_cuts(spark, sf_dir):
    """Sequences of two strands: the place of the cut, the text without it, and the two joined again."""
    at = (F.col("p_partkey") % 15 + 1).cast("int")
    rows = table(spark, sf_dir, "part").select("p_partkey", sequence().alias("q"), at.alias("at")).select("p_partkey", rna.joined_strands(F.col("q"), F.col("at") + 1).alias("costring"))
    met = rows.withColumn("c", rna.cut_strands(F.col("costring")))
    return met.select("p_partkey", "costring", F.col("c.text").alias("text"), F.col("c.cut").alias("cut"), rna.joined_strands(F.col("c.text"), F.col("c.cut")).alias("back"))


VALID = "('AU', 'UA', 'CG', 'GC', 'GU', 'UG')"


@query("rna_stacks", f"WITH s AS ({SEQUENCE}) SELECT p_partkey, q AS sequence, repeat('.', cast(i - 1 AS int)) || '((' || repeat('.', cast(j - i - 3 AS int)) || '))' || repeat('.', cast(16 - j AS int)) AS structure, true AS is_double, i || ',' || j || ' ' || (i + 1) || ',' || (j - 1) AS pairs FROM s, range(1, 17) a(i), range(1, 17) b(j) WHERE j - i >= 6 AND substr(q, cast(i AS int), 1) || substr(q, cast(j AS int), 1) IN {VALID} AND substr(q, cast(i + 1 AS int), 1) || substr(q, cast(j - 1 AS int), 1) IN {VALID}")
def rna_stacks(spark, sf_dir):
    """All stacks of two pairs that can come into the open chain where no pair may be lonely, and their pairs."""
    rows = table(spark, sf_dir, "part").select("p_partkey", sequence().alias("sequence"))
    found = moves.move_set("RNA-noLP")(F.repeat(F.lit("."), F.length("sequence")), F.col("sequence"))
    got = rows.select("p_partkey", "sequence", F.explode(found).alias("x")).select("p_partkey", "sequence", "x.structure", "x.is_double")
    first = lambda p: F.split(p, ",")[0].cast("int")
    ordered = F.transform(F.array_sort(F.transform(rna.base_pairs(F.col("structure")), lambda p: F.struct(first(p).alias("i"), p.alias("p")))), lambda x: x["p"])
    return got.withColumn("pairs", F.array_join(ordered, " "))


ONE_PAIR = f"""WITH s AS ({SEQUENCE}), v AS (SELECT p_partkey, q, i, j FROM s, range(1, 17) a(i), range(1, 17) b(j) WHERE j - i >= 4 AND substr(q, cast(i AS int), 1) || substr(q, cast(j AS int), 1) IN {VALID}),
o AS (SELECT p_partkey, q, i, j FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY i, j DESC) AS k FROM v) WHERE k = 1),
nb AS (SELECT o.p_partkey, o.q, o.i, o.j, NULL AS a, NULL AS b, 'remove' AS kind FROM o
UNION ALL SELECT o.p_partkey, o.q, o.i, o.j, v.i, v.j, 'insert' FROM o JOIN v USING (p_partkey) WHERE v.i > o.i AND v.j < o.j OR v.j < o.i OR v.i > o.j OR v.i < o.i AND v.j > o.j
UNION ALL SELECT o.p_partkey, o.q, o.i, o.j, v.i, v.j, 'shift' FROM o JOIN v USING (p_partkey) WHERE cast(v.i IN (o.i, o.j) AS int) + cast(v.j IN (o.i, o.j) AS int) = 1)
SELECT p_partkey, kind, string_agg(CASE WHEN kind <> 'shift' AND kind <> 'remove' AND p = i OR p = a THEN '(' WHEN kind <> 'shift' AND kind <> 'remove' AND p = j OR p = b THEN ')' ELSE '.' END, '' ORDER BY p) AS structure FROM nb, range(1, 17) t(p) GROUP BY p_partkey, kind, i, j, a, b"""


@query("rna_shifts", ONE_PAIR)
def rna_shifts(spark, sf_dir):
    """All neighbours, with shifts, of each part's first pair (the leftmost one, then the widest)."""
    rows = table(spark, sf_dir, "part").select("p_partkey", sequence().alias("sequence"))
    opened = rows.select("p_partkey", "sequence", F.explode(moves.move_set("RNA")(F.repeat(F.lit("."), F.length("sequence")), F.col("sequence"))).alias("x"))
    place = F.struct(F.instr("x.structure", "("), -F.instr("x.structure", ")"))
    start = opened.groupBy("p_partkey").agg(F.min_by(F.struct("sequence", "x.structure"), place).alias("s")).select("p_partkey", "s.sequence", "s.structure")
    found = start.select("p_partkey", F.col("structure").alias("was"), F.explode(moves.move_set("RNA", "Shift")(F.col("structure"), F.col("sequence"))).alias("x"))
    number = F.length(F.replace("x.structure", F.lit(".")))
    kind = F.when(number == 0, "remove").when(number == 4, "insert").otherwise("shift")
    return found.select("p_partkey", kind.alias("kind"), "x.structure")


CONSTRAINT, HAIRPIN = "NNRYNSWKMBDHVNNN", "G(....)U........"
ALLOWED = " AND ".join(f"substr(q, {i + 1}, 1) IN ({', '.join(repr(b) for b in design.IUPAC[c])})" for i, c in enumerate(CONSTRAINT) if c != "N")


@query("constrained_designs", f"WITH s AS ({SEQUENCE}) SELECT p_partkey, {ALLOWED} AS is_allowed, substr(q, 1, 1) || substr(q, 8, 1) IN ('AU', 'CG', 'GC', 'UA', 'GU', 'UG') AND substr(q, 2, 1) || substr(q, 7, 1) IN ('AU', 'CG', 'GC', 'UA') AS is_paired FROM s")
def constrained_designs(spark, sf_dir):
    """Whether each part's sequence meets an IUPAC constraint, and can form a hairpin."""
    return table(spark, sf_dir, "part").select("p_partkey", design.allowed(sequence(), CONSTRAINT).alias("is_allowed"), design.paired(sequence(), HAIRPIN).alias("is_paired"))


FIELDS = (("+-+-+-", "++--++"), ("+++---", "+--+-+"))
OVERLAP = "(SELECT sum(CASE WHEN substr(structure, cast(k AS int), 1) = substr('{p}', cast(k AS int), 1) THEN 1 ELSE -1 END) FROM range(1, 7) r(k))"
FIELD_SQL = [" - ".join(f"{OVERLAP.format(p=p)} * {OVERLAP.format(p=p)}" for p in field) for field in FIELDS]


@query("hopfield_objectives", f"WITH t AS (SELECT DISTINCT {TEXT.format(x='o_custkey % 64')} AS structure FROM orders), e AS (SELECT structure, cast(-{FIELD_SQL[0]} AS bigint) AS a, cast(-{FIELD_SQL[1]} AS bigint) AS b FROM t) SELECT structure, a || ' ' || b AS objectives, (a + b) * 0.5 AS energy FROM e")
def hopfield_objectives(spark, sf_dir):
    """Spins with one energy for each of two sets of patterns."""
    states = table(spark, sf_dir, "orders").select(spin_string(F.col("o_custkey") % 64, 6).alias("structure")).distinct()
    found = readers.hopfield_landscape(states, [list(f) for f in FIELDS], 0.5)
    return found.select("structure", F.array_join(F.transform("pov", lambda x: x.cast("string")), " ").alias("objectives"), "energy")


@query("part_deviations", "SELECT round(stddev_pop(p_retailprice), 4) AS p_retailprice, round(stddev_pop(p_size), 4) AS p_size FROM part")
def part_deviations(spark, sf_dir):
    return readers.deviations(table(spark, sf_dir, "part"), ["p_retailprice", "p_size"]).select(rounded("p_retailprice", 4), rounded("p_size", 4))
