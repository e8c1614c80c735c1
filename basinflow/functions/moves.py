"""Move sets as native expressions: each maps a structure to the array of its neighbours."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MoveSet = Callable[[Column], Column]


def places(s: Column, last: int = 0) -> Column:
    """1 .. length (less `last`) as an array; empty for a string that is too short."""
    n = F.length(s) - last
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def put(s: Column, at: Column, letter: Column) -> Column:
    """s with the character at a place replaced."""
    return F.overlay(s, letter, at, F.lit(1))


def at(s: Column, i: Column) -> Column:
    return F.substring(s, i, F.lit(1))


def spin(s: Column) -> Column:
    """All single flips of a string of + and -."""
    return F.transform(places(s), lambda i: put(s, i, F.translate(at(s, i), "+-", "-+")))


def spin_complement(s: Column) -> Column:
    """Complements of all suffixes: the first i - 1 spins stay, the others flip."""
    return F.transform(places(s), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.translate(F.substring(s, i, F.length(s)), "+-", "-+")))


def point(alphabet: str) -> MoveSet:
    """All point mutants over an alphabet."""
    letters = F.array(*(F.lit(c) for c in alphabet))
    return lambda s: F.flatten(F.transform(places(s), lambda i: F.transform(F.filter(letters, lambda c: c != at(s, i)), lambda c: put(s, i, c))))


def exchange(s: Column) -> Column:
    """All swaps of a + with a - (their numbers stay)."""
    of = lambda c: F.filter(places(s), lambda i: at(s, i) == c)
    plus, minus = of("+"), of("-")
    return F.flatten(F.transform(plus, lambda i: F.transform(minus, lambda j: put(put(s, i, F.lit("-")), j, F.lit("+")))))


def pairs(n: Column, apart: int = 1) -> Column:
    """All (i, j) with 1 <= i, i + apart <= j <= n as an array of structs."""
    first = F.when(n > apart, F.sequence(F.lit(1), n - apart)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(first, lambda i: F.transform(F.sequence(i + apart, n), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def permutation(move: Callable[[Column, Column, Column], Column], neighbours_only: bool = False) -> MoveSet:
    """Neighbours of a comma-separated permutation; move(items, i, j) gives the changed array."""

    def of(s: Column) -> Column:
        items = F.split(s, ",")
        at_all = pairs(F.size(items))
        chosen = F.filter(at_all, lambda p: p["j"] == p["i"] + 1) if neighbours_only else at_all
        return F.transform(chosen, lambda p: F.array_join(move(items, p["i"], p["j"]), ","))

    return of


def swapped(items: Column, i: Column, j: Column) -> Column:
    return F.transform(items, lambda x, k: F.when(k + 1 == i, F.element_at(items, j)).when(k + 1 == j, F.element_at(items, i)).otherwise(x))


def reversed_part(items: Column, i: Column, j: Column) -> Column:
    """The segment from i to j turned round."""
    return F.transform(items, lambda x, k: F.when((k + 1 >= i) & (k + 1 <= j), F.element_at(items, i + j - k - 1)).otherwise(x))


transposition = permutation(swapped)
canonical_transposition = permutation(swapped, neighbours_only=True)
reversal = permutation(reversed_part)


def adjacency(listed: Column) -> Column:
    """Neighbours that a row itself lists, separated by colons; `:` or nothing: none."""
    return F.filter(F.split(F.coalesce(listed, F.lit("")), ":"), lambda x: x != "")


def grid(s: Column, wrap: tuple[int, int] | None = None) -> Column:
    """The four neighbours of a cell `x,y`; with wrap, on a torus of that size (from 0)."""
    x, y = F.split(s, ",")[0].cast("int"), F.split(s, ",")[1].cast("int")
    turn = (lambda v, n: F.pmod(v, F.lit(n))) if wrap else (lambda v, n: v)
    w, h = wrap or (0, 0)
    return F.array(*(F.concat_ws(",", turn(x + dx, w).cast("string"), turn(y + dy, h).cast("string")) for dx, dy in ((-1, 0), (1, 0), (0, -1), (0, 1))))


#: By graph name and move option, as in a landscape's header.
REGISTRY: dict[tuple[str, str], MoveSet] = {
    ("Q2", ""): spin, ("Q2", "c"): spin_complement, ("X", ""): exchange, ("P", "T"): transposition, ("P", ""): transposition, ("P", "C"): canonical_transposition, ("P", "R"): reversal,
}


def rna_options(graph: str, option: str = "") -> dict[str, bool]:
    """What an RNA graph (RNA, RNA2, each with or without -noLP) and its move option (Shift, noShift or
    ligand) ask for. An unknown word is an error, as are ligands with RNA2, whose structures take no mark."""
    if graph not in ("RNA", "RNA-noLP", "RNA2", "RNA2-noLP"):
        raise ValueError(f"unknown graph {graph!r}")
    words = {"": {}, "shift": {"shift": True}, "noshift": {"shift": False}, "ligand": {"ligand": True}}
    word = option if option == "ligand" else option[:1].lower() + option[1:].replace("Shift", "shift")
    if word not in words:
        raise ValueError(f"unknown moves {option!r}")
    out = {"second": graph.startswith("RNA2"), "no_lonely": graph.endswith("-noLP"), "shift": False, "ligand": False} | words[word]
    if out["second"] and out["ligand"]:
        raise ValueError("RNA2 takes no ligand marks")
    return out


def move_set(graph: str, option: str = "", design: tuple[str, str, int, int] | None = None, scores: dict | None = None, least: int = 4) -> MoveSet:
    """The move set of a graph description: Q2, Qk[,LETTERS], P, X, T (trees), S or SECIS (with design:
    structure, protein, most mutations and least score) and RNA, RNA2 (functions of structure and
    sequence; least: smallest distance of a new pair). Lists of neighbours (?) are a column: adjacency()."""
    if (graph, option) in REGISTRY:
        return REGISTRY[graph, option]
    if graph[:1] == "Q" and graph[1:2].isdigit():
        size, _, letters = graph[1:].partition(",")
        if not size.isdigit() or not 0 < int(size) <= 26 and not letters:
            raise ValueError(f"unknown graph {graph!r}")
        letters = letters or "".join(chr(65 + i) for i in range(int(size)))
        if len(letters) != int(size):
            raise ValueError(f"{graph}: the alphabet has {len(letters)} letters")
        if option == "c":
            from basinflow.functions.lattice import crankshaft

            return crankshaft(letters)
        return point(letters)
    if graph[:3] == "RNA":
        from basinflow.functions.rna import rna_moves

        chosen = rna_options(graph, option)
        return rna_moves(no_lonely=chosen["no_lonely"], shift=chosen["shift"], second=chosen["second"], least=least)
    if graph == "T":
        from basinflow.functions.trees import nni

        return nni
    if graph in ("S", "SECIS"):
        from basinflow.functions.design import mutants

        if design is None:
            raise ValueError("a design landscape needs structure, protein, most mutations and least score")
        return mutants(*design, scores=scores)
    raise ValueError(f"unknown graph {graph!r} with moves {option!r}")
