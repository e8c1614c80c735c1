"""A published spin-glass example: ten spins, three objectives of four patterns each."""

from pyspark.sql import functions as F

from basinflow.operators import landscape as L
from basinflow.plans.analysis import Landscape, LandscapeOptions
from basinflow.sources import readers

# The patterns of each objective, and the known minima in order (structure, energy, father,
# barrier, and whether no earlier minimum is better in every objective).
PATTERNS = (
    ("+-+--+++++", "++-++---++", "+--++++++-", "++---+-+--"),
    ("+-+--+++++", "++-++---++", "+++-+++--+", "+--++++++-"),
    ("+-+--+++++", "+++-+++--+", "+--++++++-", "++---+-++-"),
)
MINIMA = """
+-+--+++++ -2.96667 0 2.86667 *
-+-++----- -2.96667 1 1.33333 *
+--++++++- -2.70000 1 0.46667 *
-++------+ -2.70000 2 0.46667 *
+----++++- -2.56667 1 0.33333 *
-++++----+ -2.56667 2 0.33333 *
++-++---++ -2.10000 1 0.73333 *
--+--+++-- -2.10000 1 0.73333 *
+++--++--+ -1.96667 1 0.33333 .
---++--++- -1.96667 1 0.33333 .
+--++--++- -1.90000 1 0.73333 .
-++--++--+ -1.90000 1 0.73333 .
+++-+++--+ -1.90000 1 1.06667 *
---+---++- -1.90000 1 1.06667 *
++-++--++- -1.83333 1 0.33333 .
--+--++--+ -1.83333 1 0.33333 .
+++-+-+--+ -1.70000 1 0.60000 .
+-+-+++--+ -1.70000 17 0.46667 .
+--+---++- -1.70000 1 0.46667 .
-++-+++--+ -1.70000 1 0.46667 .
-+-+---++- -1.70000 1 0.60000 .
---+-+-++- -1.70000 21 0.46667 .
+++-+++-++ -1.56667 1 0.46667 .
---+---+-- -1.56667 1 0.46667 .
+++++-+--+ -1.50000 1 0.60000 .
++-+---++- -1.50000 1 0.60000 .
--+-+++--+ -1.50000 1 0.60000 .
-----+-++- -1.50000 1 0.60000 .
++---+-+-- -1.43333 0 1.33333 .
--+++-+-++ -1.43333 0 1.33333 .
+--++-+-++ -1.43333 1 0.73333 .
-++--+-+-- -1.43333 1 0.73333 .
+-+++-+-++ -1.36667 1 0.46667 .
-+---+-+-- -1.36667 1 0.46667 .
+++++-+-++ -1.30000 1 0.60000 .
-----+-+-- -1.30000 1 0.60000 .
++-++++-++ -1.30000 1 0.60000 .
--+----+-- -1.30000 1 0.60000 .
+++++++-++ -1.23333 1 0.06667 .
+++-+-+-++ -1.23333 1 0.06667 .
---+-+-+-- -1.23333 1 0.06667 .
-------+-- -1.23333 1 0.06667 .
"""


def test_hopfield_example(spark):
    states = readers.hopfield_landscape(readers.spins(spark, 10), [list(p) for p in PATTERNS], 1 / 120).withColumn("energy", F.round("energy", 6)).withColumn(L.ID, F.lit("1"))
    ranked = L.ranked(states, "pov", "structure")
    assert ranked.count() == 1024 and ranked.select("energy").distinct().count() == 39
    found = Landscape(spark, ranked, LandscapeOptions(graph="Q2", poset=True, most=0))
    flags = {r["lmin"]: r["is_global"] for r in L.pareto_flags(found.bar).collect()}
    got = [(r["structure"], r["energy"], r["father"], r["barrier"], "*" if flags[r["lmin"]] else ".") for r in found.bar.orderBy("lmin").collect()]
    want = [(s, float(e), int(f), float(b), flag) for s, e, f, b, flag in map(str.split, MINIMA.strip().split("\n"))]
    assert [(s, f, flag) for s, _, f, _, flag in got] == [(s, f, flag) for s, _, f, _, flag in want]
    assert all(abs(a[1] - b[1]) < 1e-5 and abs(a[3] - b[3]) < 1.1e-5 for a, b in zip(got, want))
