"""Move sets: known neighbour lists, symmetry, and enumeration."""

import os
import random

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from basinflow.functions import design, lattice, moves, rna, trees
from basinflow.plans import registry


def neighbours(spark, move, *texts):
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select("s", move(F.col("s")).alias("n")).collect()
    return {r["s"]: r["n"] for r in rows}


def test_spins(spark):
    assert sorted(neighbours(spark, moves.spin, "+-+")["+-+"]) == sorted(["--+", "+++", "+--"])
    assert neighbours(spark, moves.spin_complement, "+-+")["+-+"] == ["-+-", "++-", "+--"]
    assert neighbours(spark, moves.spin, "")[""] == []
    assert sorted(neighbours(spark, moves.exchange, "++-")["++-"]) == ["+-+", "-++"]


def test_strings(spark):
    assert sorted(neighbours(spark, moves.move_set("Q3"), "AB")["AB"]) == ["AA", "AC", "BB", "CB"]
    assert sorted(neighbours(spark, moves.move_set("Q4,ACGU"), "G")["G"]) == ["A", "C", "U"]
    with pytest.raises(ValueError):
        moves.move_set("Q3,AB")
    with pytest.raises(ValueError):
        moves.move_set("Z")


def test_permutations(spark):
    assert sorted(neighbours(spark, moves.transposition, "1,2,3")["1,2,3"]) == ["1,3,2", "2,1,3", "3,2,1"]
    assert sorted(neighbours(spark, moves.canonical_transposition, "1,2,3")["1,2,3"]) == ["1,3,2", "2,1,3"]
    assert sorted(neighbours(spark, moves.reversal, "1,2,3,4")["1,2,3,4"]) == ["1,2,4,3", "1,3,2,4", "1,4,3,2", "2,1,3,4", "3,2,1,4", "4,3,2,1"]
    assert neighbours(spark, moves.transposition, "1")["1"] == []


def test_adjacency_and_grid(spark):
    rows = spark.createDataFrame([("a:b:c",), (":",), ("",), (None,)], "s string").select(moves.adjacency(F.col("s")).alias("n")).collect()
    assert [r["n"] for r in rows] == [["a", "b", "c"], [], [], []]
    assert sorted(neighbours(spark, lambda s: moves.grid(s, (7, 24)), "0,23")["0,23"]) == ["0,0", "0,22", "1,23", "6,23"]


# Known neighbour lists of RNA structures.
CASES = [
    ("GGGGUUUCCCC", "((((...))))", False, False, "(((.....))) ((.(...).)) (.((...)).) .(((...)))."),
    ("GGUUUCC", ".......", False, False, ".(....) .(...). (.....) (....). (...).."),
    ("GGGGUUUCCCC", "((((...))))", True, False, "(((.....))) .(((...)))."),
    ("GGGGUUUCCCC", "...........", True, False, "((......)). .((....)).. .((.....)). ((.....)).. ..((....)). .((......)) ..((...)).. ((.......)) ..((.....)) ((....))... .((...))... ((...))...."),
    ("GGGGGGGGUUUUUUU", "((..(((...)))))", True, True, "....(((...))).. ((..((.....)))) (((..((...))))) ((...((...)).))"),
    (
        "AAGUGAUACCAGCAUCGUCUUGAUGCCCUUGGCAGCACUUCAU", "(((((((......)))).)))((((((...)))).....))..", True, True,
        "(((((((......))))).))((((((...)))).....)).. (((((((......)))).)))(((((.....))).....)).. (((((((......)))).)))((.(((...)))......)).. (((((((......)))).)))..((((...))))......... "
        "((((((........))).)))((((((...)))).....)).. (((.(((......)))..)))((((((...)))).....)).. ((.((((......))))..))((((((...)))).....)).. .((((((......)))).))(((((((...)))).....))). .((((((......)))).)).((((((...)))).....))..",
    ),
    (
        "GGGGGGGGGGGGAAAUUUUUUUGUUUU", ".(((....(((.....)))....))).", False, True,
        ".(((...((((.....))))...))). .(((.(..(((.....)))..).))). ((((....(((.....)))....)))) .(((....((((...))))....))). ..((....(((.....)))....)).. .(((.....((.....)).....))). .(((....((.......))....))). .(((..(.(((.....))).)..))). "
        ".((.....(((.....))).....)). .(.(....(((.....)))....).). .(((....(.(.....).)....))). .(((....(((....).))....))). .(((.(..(((.....))).)..))). .(((..(.(((.....)))..).))). .(((....((.(....)))....))). .(((..(.(((.....))))...))). "
        ".(((...((((.....))).)..))). .(((....(((.....)))....)).) .((.(...(((.....)))....))). .(((...(.((.....)))....))). .(((....(((.....)).)...))). (.((....(((.....)))....))). .((((...(((.....)))..).))). .((((...(((.....))).)..))). "
        ".(((.(..(((.....))))...))). .(((...((((.....)))..).))). .(((....((..(...)))....))). .((..(..(((.....)))....))). .(((..(..((.....)))....))). .(((....(((.....))..)..))). .((((...(((.....))))...))). .(((....(((.....)))..)..)). "
        ".((....((((.....)))....))). .(((....(((.....))))....)). .((((....((.....)))....))). .((...(.(((.....)))....))). .(((....(((.....))).)...)). .(((.(...((.....)))....))). .(((....(((.....))...).))). .(((.....((.....))(...)))).",
    ),
]


@pytest.mark.parametrize("sequence,structure,no_lonely,shift,want", CASES)
def test_rna(spark, sequence, structure, no_lonely, shift, want):
    row = spark.createDataFrame([(structure, sequence)], "s string, q string").select(rna.rna_moves(no_lonely=no_lonely, shift=shift, second=True)(F.col("s"), F.col("q")).alias("n")).first()
    assert sorted(x["structure"] for x in row["n"]) == sorted(want.split())


def test_rna_neighbours_are_symmetric():
    rng = random.Random(1)
    for shift in (False, True):
        sequence = "".join(rng.choice("ACGU") for _ in range(14))
        seen = {"." * 14}
        for _ in range(3):
            seen |= {x for s in list(seen)[:40] for x, _ in rna.neighbours(sequence, s, shift=shift)}
        for s in list(seen)[:60]:
            assert all(s in {y for y, _ in rna.neighbours(sequence, x, shift=shift)} for x, _ in rna.neighbours(sequence, s, shift=shift))


def test_pair_table_and_loneliness():
    assert rna.pair_list("((...))(...)") == [6, 5, -1, -1, -1, 1, 0, 11, -1, -1, -1, 7]
    with pytest.raises(ValueError):
        rna.pair_list("(()")
    # For the pair (2, 9) of each structure, whether it is lonely inside, outside, at all, and
    # whether its inner or outer neighbour would become lonely without it.
    lone = {
        ".(((....))).": (0, 0, 0, 1, 1), "..((....))..": (0, 1, 0, 1, 0), "..(......)..": (1, 1, 1, 0, 0), ".((......).)": (1, 1, 1, 0, 0),
        ".((.(...)).)": (1, 1, 1, 0, 0), ".(((..()))).": (0, 0, 0, 1, 1), "(((......)))": (1, 0, 0, 0, 0), "((((.)(.))))": (1, 0, 0, 0, 0),
    }
    tests = (rna.inside_lonely, rna.outside_lonely, rna.lonely, rna.leaves_inside_lonely, rna.leaves_outside_lonely)
    assert {s: tuple(int(f(rna.pair_list(s), 2, 9)) for f in tests) for s in lone} == lone


def test_rna_dispatch(spark):
    """RNA and RNA2 differ without lonely pairs, in base pairs and in marks; unknown words are errors."""
    of = lambda graph, option, s, q, **more: sorted(x["structure"] for x in spark.createDataFrame([(s, q)], "s string, q string").select(moves.move_set(graph, option, **more)(F.col("s"), F.col("q")).alias("n")).first()["n"])
    s, q = "((..(((...)))))", "GGGGGGGGUUUUUUU"
    assert of("RNA2-noLP", "Shift", s, q) == sorted(CASES[4][4].split()) and set(of("RNA-noLP", "shift", s, q)) == set(of("RNA-noLP", "noShift", s, q)) < set(of("RNA2-noLP", "shift", s, q))
    assert "(((..)))" in of("RNA2-noLP", "", "((....))", "GGGAACCC") and "(((..)))" not in of("RNA-noLP", "", "((....))", "GGGAACCC")
    assert of("RNA", "", "......", "XAAAAK") == ["(....)"] and of("RNA2", "", "......", "XAAAAK") == [] and of("RNA", "", ".....*", "AGGGI") == ["(...)*"]
    assert of("RNA", "", "..", "GC") == [] and of("RNA", "", "..", "GC", least=1) == ["()"]
    for graph, option in (("RNA", "Shiftt"), ("RNA", "xyz"), ("RNA3", ""), ("RNA-noLPs", ""), ("RNA2", "ligand"), ("Q", ""), ("Q0", ""), ("Q27", ""), ("S", "")):
        with pytest.raises(ValueError):
            moves.move_set(graph, option)
    with pytest.raises(Exception):
        of("RNA2", "", ".....*", "AGGGU")
    tree = "((1)((2)(3))((4)(5)))"
    assert len(neighbours(spark, moves.move_set("T"), tree)[tree]) == 4
    assert sorted(neighbours(spark, moves.move_set("S", design=("(.)", "K", 9, -99)), "GAC")["GAC"]) == ["AAU", "CAG", "GCC", "GGC", "GUC"]


def test_ligand_and_strands(spark):
    row = spark.createDataFrame([("....*", "GAAC")], "s string, q string").select(rna.rna_moves(ligand=True)(F.col("s"), F.col("q")).alias("n")).first()
    assert [x["structure"] for x in row["n"]] == ["...."]
    cut = spark.createDataFrame([("((&))",)], "s string").select(rna.cut_strands(F.col("s")).alias("c")).select("c.*", rna.joined_strands(F.col("c.text"), F.col("c.cut")).alias("back")).first()
    assert (cut["cut"], cut["text"], cut["back"]) == (3, "(())", "((&))")


def test_distances(spark):
    row = spark.createDataFrame([("((..))", "(....)", "abcd", "abxy9")], "a string, b string, c string, d string").select(rna.pair_distance(F.col("a"), F.col("b")).alias("p"), rna.hamming(F.col("c"), F.col("d")).alias("h"), rna.base_pairs(F.col("a")).alias("l")).first()
    assert row["p"] == 1 and row["h"] == 2 and sorted(row["l"]) == ["1,6", "2,5"]


def test_crankshaft(spark):
    assert sorted(neighbours(spark, lattice.crankshaft("FLR"), "FLRL")["FLRL"]) == sorted(["FFLF", "FLFR", "FLRF", "FLRR"])
    long = neighbours(spark, lattice.crankshaft("FLRUD"), "FLURDF")["FLURDF"]
    assert "FRDLUF" in long and len([x for x in long if x[:-1] == "FLURD"]) == 4


def test_trees(spark):
    tree = "((1)((2)(3))((4)(5)))"
    found = spark.createDataFrame([(tree,)], "t string").select(trees.nni("t").alias("n")).first()["n"]
    assert len(found) == 4 and len(set(found)) == 4 and all(trees.written(trees.parse(x)) == x for x in found)
    assert [trees.all_trees(spark, n).count() for n in (3, 4, 5)] == [1, 3, 15]


def test_design(spark):
    df = spark.createDataFrame([("AUGGCUUAA",)], "s string").select(design.translated(F.col("s")).alias("a")).select("a", design.mutations(F.col("a"), "MG").alias("m"), design.similarity(F.col("a"), "MA").alias("s"), design.similarity(F.col("a"), "MAK").alias("stop"))
    row = df.first()
    assert row["a"] == ["M", "A", "*"] and row["m"] == 1 and row["s"] == 10 and row["stop"] is None
    assert sorted(r["sequence"] for r in design.sequences(spark, "NAN", "(.)").collect()) == ["AAU", "CAG", "GAC", "UAA"]
    assert design.sequences(spark, "NAN", "G.U").count() == 6
    found = spark.createDataFrame([("GAC",)], "s string").select(design.mutants("(.)", "D", 1, -5)(F.col("s")).alias("n")).first()["n"]
    assert set(found) <= {"AAU", "CAG", "UAA", "GCC", "GGC", "GUC"} and "UAA" not in found


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
@pytest.mark.parametrize("name", ["rna_open_chain"])
def test_small_tables_are_spread(spark, name):
    """A table of one file of few bytes does not put all moves into one task."""
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_parts_are_not_broadcast(spark):
    """The moves of the parts of each brand join nothing, so no table of parts passes through the driver, and they are
    the moves of all parts."""
    from basinflow.plans.ways import brand_structures

    found = brand_structures(spark, "/root/testdata/sf0.001")
    assert "Join" not in found._jdf.queryExecution().toString()
    every = registry.QUERIES["rna_canonical_moves"](spark, "/root/testdata/sf0.001")
    assert found.columns == ["p_partkey", "landscape_id", "even", "sequence", "structure"] and found.count() == every.count() and found.join(every, ["p_partkey", "structure"], "left_anti").isEmpty()


def test_pair_distance_of_many(spark):
    """Distances of random structures of many lengths, against sets of pairs; null has no pairs."""
    rng, texts = random.Random(5), [None, "", "()", "(..)*", "((.)"]
    for _ in range(60):
        text = ["."] * rng.randint(0, 30)
        for _ in range(rng.randint(0, 8)):
            free = [i for i, c in enumerate(text) if c == "."]
            i = rng.choice(free[:-1]) if len(free) > 1 else None
            depth, ends = 0, []
            for j in range(i + 1, len(text)) if i is not None else ():
                depth += {"(": 1, ")": -1, ".": 0}[text[j]]
                if depth < 0:
                    break
                if depth == 0 and text[j] == ".":
                    ends.append(j)
            if ends:
                text[i], text[rng.choice(ends)] = "(", ")"
        texts.append("".join(text))

    def pairs(s):
        out, open_ = set(), []
        for j, c in enumerate(s or ""):
            if c == "(":
                open_.append(j)
            elif c == ")":
                out.add((open_.pop(), j))
        return out

    asked = [(a, b) for a in texts for b in texts]
    got = spark.createDataFrame(asked, "a string, b string").select("a", "b", rna.pair_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r["d"] for r in got] == [len(pairs(r["a"]) ^ pairs(r["b"])) for r in got] and len(got) == len(asked)
    with pytest.raises(PythonException, match="unbalanced"):
        spark.createDataFrame([("())", ".")], "a string, b string").select(rna.pair_distance(F.col("a"), F.col("b"))).collect()
