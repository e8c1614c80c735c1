"""Forests, ways, designs and trees against brute force."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from basinflow.functions import design, rna, trees
from basinflow.operators import forest, paths
from basinflow.operators.landscape import ID
from basinflow.plans.analysis import Landscape, LandscapeOptions
from tests.test_landscape import flood, random_graph, states_of


def test_forest_questions(spark):
    """Ways, depths and sums in deep and flat forests against walking up node by node."""
    rng, up, rows, pairs = random.Random(2), {}, [], []
    for name, pick in (("deep", lambda i: i - 1), ("any", lambda i: rng.randint(1, i - 1)), ("roots", lambda i: rng.randint(1, i - 1) if i % 5 else None)):
        for i in range(2, 26):
            if (j := pick(i)) is not None:
                up[name, i] = (j, 26 - j)
                rows.append((name, i, j, 26 - j))
        pairs += [(name, rng.randint(1, 25), rng.randint(1, 25)) for _ in range(40)]
    table = spark.createDataFrame(rows, f"{ID} string, node long, up long, key long")
    levels = forest.doubled(table)

    def way(name, i):
        out = [i]
        while (name, out[-1]) in up:
            out.append(up[name, out[-1]][0])
        return out

    found = {(r[ID], r["a"], r["b"]): (r["key"], r["on_a"]) for r in forest.joined_at(spark.createDataFrame(pairs, f"{ID} string, a long, b long"), levels, forest.depths(levels)).collect()}
    for name, a, b in pairs:
        one, two = way(name, a), way(name, b)
        if a == b or one[-1] != two[-1]:
            assert found[name, a, b] == (None, None)
            continue
        keys = [[up[name, x][1] for x in side if x not in other] for side, other in ((one, two), (two, one))]
        top = max(keys[0] + keys[1])
        assert found[name, a, b][0] == top and (found[name, a, b][1] == (top in keys[0]) or top in keys[0] and top in keys[1])
    sums = forest.subtree_sums(spark.createDataFrame([(n, i, i) for n in ("deep", "any", "roots") for i in range(1, 26)], f"{ID} string, node long, v long"), levels, "v").collect()
    for r in sums:
        assert r["v"] == sum(i for i in range(1, 26) if r["node"] in way(r[ID], i))


def test_ways_between_minima(spark):
    """Ways of many pairs are walks in the graph over the lowest level, except beside plateaus."""
    graphs = {"a": random_graph(3, n=120, levels=120, degree=3)}
    energies, near = graphs["a"]
    energies = [e + k * 1e-6 for k, e in enumerate(energies)]  # no plateaus: every step is an edge
    ls = Landscape(spark, states_of(spark, {"a": (energies, near)}), LandscapeOptions(graph="?", most=0))
    minimum, _, _, father, level, _ = flood(energies, near)
    pairs = [("a", i, j) for i in minimum for j in minimum if i < j][:60] + [("a", 1, 1)]
    rows = paths.saddle_paths(spark.createDataFrame(pairs, f"{ID} string, a long, b long"), ls.tree, ls.states, ls.stepped, ls.index).collect()

    def root(i, top):
        while i in father and level[i] <= top:
            i = father[i]
        return i

    tops = sorted(set(level.values()))
    for _, a, b in pairs:
        way = [r["rank"] for r in sorted((r for r in rows if (r["a"], r["b"]) == (a, b)), key=lambda r: r["step"])]
        lowest = next((t for t in tops if root(a, t) == root(b, t)), None)
        if a == b:
            assert way == [minimum[a]]
        elif lowest is None:
            assert way == []
        else:
            assert way[0] == minimum[a] and way[-1] == minimum[b] and all(y in near[x] for x, y in zip(way, way[1:]))
            assert max(energies[i - 1] for i in way) == lowest
    lengths = {r["rank"]: (r["basin"], r["steps"]) for r in paths.way_down(ls.stepped).collect()}
    assert all(lengths[minimum[i]] == (minimum[i], 0) for i in minimum)


def test_pruned_designs_equal_filtered_ones(spark):
    structure = "(..G..U..).."
    cases = [("NRNNACNSGNNY", "MAGI"), ("ACGUNNNNNRYN", "TNWK"), ("NNNNNNNNNNN", "MAGI"), (None, "MAGI"), ("NNNNNNNNNNNN", None)]
    rows: list = []
    found = design.pruned_sequences(spark.createDataFrame([(*c, 7) for c in cases], "constraint string, protein string, _best int").drop("_best"), structure, 2, 4, rows=rows).collect()
    table, codons, want = design.partners(structure), design.codons(), set()
    for constraint, protein in cases[:2]:
        for s in map("".join, product(*(design.IUPAC[c] for c in constraint))):
            kinds = {"(": design.WATSON_CRICK, "G": design.WOBBLE}
            if all(s[i] + s[table[i]] in kinds[c] for i, c in enumerate(structure) if c in kinds):
                acids = [codons[s[k : k + 3]] for k in range(0, 12, 3)]
                wrong = sum(x != y for x, y in zip(acids, protein))
                if "*" not in acids and wrong <= 2 and 5 * (4 - wrong) - wrong >= 4:
                    want.add((constraint, s, wrong, 5 * (4 - wrong) - wrong))
    assert {(r["constraint"], r["sequence"], r["mutations"], r["score"]) for r in found} == want and len(found) == len(want) > 10
    assert len(rows) == 4 and rows[-1] == len(want)


def test_pruned_designs_are_spread(spark):
    """Designs that one task reads are dealt over others, and choices of codons follow a matrix of scores."""
    scores = {("M", "M"): 7, ("I", "M"): 2, ("K", "K"): 6, ("K", "N"): 1}
    made = spark.createDataFrame([(k, "AUNAAN", "MK") for k in range(40)] + [(40, "AUNAAX", "MK"), (41, "AUNAAN", "MW")], "id int, constraint string, protein string").coalesce(1)
    found = design.pruned_sequences(made, "......", 2, 8, scores)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    want = {("AUGAAA", 0, 13), ("AUGAAG", 0, 13), ("AUGAAU", 1, 8), ("AUGAAC", 1, 8), *((f"AU{x}AA{y}", 1, 8) for x in "UCA" for y in "AG")}
    got = found.collect()
    assert {(r["sequence"], r["mutations"], r["score"]) for r in got} == want and {r["id"] for r in got} == set(range(40)) and len(got) == 40 * len(want)


def test_direct_saddles_equal_the_search(spark):
    """The table of beams against the plain beam search, where both are exhaustive."""
    asked = [("GGGAAACCCAUGAAAACAU", "(((...)))..........", "..........(......)."), ("GGGAAACCCAUGAAAACAU", "(((...)))..........", "(((...)))........()"), ("GGGAAACCCAUGAAAACAU", "((.....))..........", ".(((...)))........."), ("GGGAAACCCAUGAAAACAU", "...................", "...................")]
    queries = spark.createDataFrame([*asked, asked[0], (None, "..", "..")], "sequence string, start string, target string")
    weights = {"GC": -3.0, "CG": -3.0, "AU": -2.0, "UA": -2.0}
    plain = lambda q, pairs: float(sum(weights.get(q[i] + q[j], 1.0) for i, j in pairs))
    got = {tuple(r)[:3]: r["saddle_energy"] for r in paths.direct_saddles(queries, lambda q, s: rna.pair_sum(q, s, weights, 1.0), most_kept=8).collect()}
    want = {tuple(r)[:3]: r["saddle_energy"] for r in paths.direct_paths(queries.where("sequence is not null").distinct(), plain, most_kept=8).collect()}
    assert got == want and len(got) == 4


def test_direct_saddles_end_early(spark):
    """A query is done when its beam held all states; the others go on, with the same barriers as the plain
    search finds."""
    calls = []
    weights = {"GC": -3.0, "AU": -2.0, "GU": -1.0}

    def energy(q, s):
        calls.append(1)
        return rna.pair_sum(q, s, weights, 1.0)

    schema = "sequence string, start string, target string"
    assert paths.direct_saddles(spark.createDataFrame([("GGAAAACC", "(......)", "(.(..).)")], schema), energy).first()["saddle_energy"] == -2.0
    assert len(calls) == 2
    wide = [("GAUGCUAGCAUGGACUUCAGGAUC", "(((((....)))))..........", "..........(((((....)))))"), ("GGAAAACC", "(......)", "(.(..).)")]
    plain = lambda q, pairs: float(sum(weights.get(q[i] + q[j], 1.0) for i, j in pairs))
    for most in (1, 4, 300):
        got = {tuple(r)[:3]: r["saddle_energy"] for r in paths.direct_saddles(spark.createDataFrame(wide, schema), energy, most_kept=most).collect()}
        want = {tuple(r)[:3]: r["saddle_energy"] for r in paths.direct_paths(spark.createDataFrame(wide, schema), plain, most_kept=most).collect()}
        assert got.keys() == want.keys() and got[wide[1]] == want[wide[1]] and (most < 300 or got == want)


@pytest.mark.parametrize("leaves", [3, 4, 6])
def test_trees_by_number(spark, leaves):
    n = trees.count_trees(leaves)
    rows = spark.range(n).withColumn("tree", trees.from_places(trees.rank_places(F.col("id"), leaves))).withColumn("back", trees.places_rank(trees.to_places("tree"), leaves)).collect()
    assert all(r["id"] == r["back"] for r in rows)
    assert {r["tree"] for r in rows} == {r["tree"] for r in trees.all_trees(spark, leaves).collect()} and len(rows) == n


def test_random_trees_and_walks(spark):
    one = trees.random_trees(spark.range(3000), "id", 5, seed=4)
    two = trees.random_trees(spark.range(3000).repartition(7), "id", 5, seed=4)
    rows = {r["id"]: r["tree"] for r in one.collect()}
    assert rows == {r["id"]: r["tree"] for r in two.collect()}
    counts = [sum(t == x for t in rows.values()) for x in set(rows.values())]
    assert len(counts) == 15 and min(counts) > 140 and max(counts) < 270
    moved = {r["id"]: r["tree"] for r in trees.interchange_walk(one.where("id < 200"), "id", 1, seed=4).collect()}
    assert all(moved[i] in [trees.written(x) for x in trees.interchanges(trees.parse(rows[i]))] for i in moved)
    assert one.select(trees.skeleton(F.lit("((1)((2)(3))(4))")).alias("s")).first()["s"] == "(())"
