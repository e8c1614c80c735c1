"""RNA secondary structures: pair tables, move sets and distances.

A structure is a dot-bracket string over a sequence of the same length; a trailing * marks a bound
ligand. A move is written as a rule on the pair table; the string comes from the table afterwards.

There are two move sets. RNA knows the extended base pairs and ligand marks, and has no shifts without
lonely pairs. RNA2 knows the canonical pairs only, has such shifts, takes no marks, and lets a pair that
is not lonely close a loop that is shorter by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The base pairs of the canonical set, and those of the extended set.
PAIRS = frozenset(("AU", "UA", "CG", "GC", "GU", "UG"))
EXTENDED = PAIRS | frozenset(("XK", "KX", "AI", "IA", "UI", "IU"))
NEIGHBOUR = "array<struct<structure:string,is_double:boolean>>"


def normal_sequence(s: Column) -> Column:
    """Upper case, T as U; an error for any other letter."""
    out = F.translate(F.upper(s), "T", "U")
    return F.when(out.rlike("^[ACGU]*$"), out).otherwise(F.raise_error(F.concat(F.lit("not a sequence: "), s)))


def pair_list(structure: str) -> list[int]:
    """Partner of each position from 0, -1 if unpaired."""
    table, open_ = [-1] * len(structure), []
    for j, c in enumerate(structure):
        if c == "(":
            open_.append(j)
        elif c == ")":
            if not open_:
                raise ValueError(f"unbalanced structure {structure}")
            i = open_.pop()
            table[i], table[j] = j, i
    if open_:
        raise ValueError(f"unbalanced structure {structure}")
    return table


def closed_pairs(structure: str) -> list[tuple[int, int]]:
    """All pairs of places from 0, in the order in which they close; a bracket that stays open is no pair."""
    out, open_ = [], []
    for j, c in enumerate(structure):
        if c == "(":
            open_.append(j)
        elif c == ")":
            if not open_:
                raise ValueError(f"unbalanced structure {structure}")
            out.append((open_.pop(), j))
    return out


def loops(table: list[int]) -> list[int]:
    """For each position the left end of the pair around it (-1 outside); an end of a pair belongs to
    the loop around the pair."""
    out, around = [], [-1]
    for i, j in enumerate(table):
        if j >= 0 and j < i:
            around.pop()
        out.append(around[-1])
        if j > i:
            around.append(i)
    return out


def drawn(table: list[int]) -> str:
    return "".join("." if j < 0 else "(" if j > i else ")" for i, j in enumerate(table))


def is_pair(table: list[int], i: int, j: int) -> bool:
    return 0 <= i < j < len(table) and table[i] == j


def outside_lonely(table: list[int], i: int, j: int) -> bool:
    """Whether (i - 1, j + 1) is no pair."""
    return not is_pair(table, i - 1, j + 1)


def inside_lonely(table: list[int], i: int, j: int) -> bool:
    """Whether (i + 1, j - 1) is no pair."""
    return not is_pair(table, i + 1, j - 1)


def lonely(table: list[int], i: int, j: int) -> bool:
    return outside_lonely(table, i, j) and inside_lonely(table, i, j)


def leaves_inside_lonely(table: list[int], i: int, j: int) -> bool:
    """Whether (i + 1, j - 1) is a pair that would be lonely without (i, j)."""
    return is_pair(table, i + 1, j - 1) and inside_lonely(table, i + 1, j - 1)


def leaves_outside_lonely(table: list[int], i: int, j: int) -> bool:
    """Whether (i - 1, j + 1) is a pair that would be lonely without (i, j)."""
    return is_pair(table, i - 1, j + 1) and outside_lonely(table, i - 1, j + 1)


def changed(table: list[int], remove=(), add=()) -> list[int]:
    out = list(table)
    for i, j in remove:
        out[i] = out[j] = -1
    for i, j in add:
        out[i], out[j] = j, i
    return out


def canonical(table: list[int]) -> bool:
    return not any(j > i and lonely(table, i, j) for i, j in enumerate(table))


def neighbours(sequence: str, structure: str, no_lonely: bool = False, shift: bool = False, second: bool = False, least: int = 4) -> Iterator[tuple[str, bool]]:
    """(structure, whether two pairs changed) for every insertion, deletion and, with shift, every
    move of one end of a pair. second: the set RNA2 instead of RNA. least: smallest j - i of a new pair
    (1 for two strands). With no_lonely, a pair that would be lonely comes or goes as a stack of two."""
    table = pair_list(structure)
    loop, n, pairs = loops(table), len(table), PAIRS if second else EXTENDED
    fits = lambda i, j: sequence[i] + sequence[j] in pairs
    mates = {x: {b for a, b in pairs if a == x} for x in set(sequence)}
    free = [i for i in range(n) if table[i] < 0]
    apart = least - 1 if no_lonely and second else least
    text = drawn(table)
    for k, i in enumerate(free):
        around, mate = loop[i], mates[sequence[i]]
        for j in free[k + 1 :]:
            if sequence[j] in mate and j - i >= apart and loop[j] == around:
                if not no_lonely or not lonely(table, i, j):
                    yield f"{text[:i]}({text[i + 1 : j]}){text[j + 1 :]}", False
                elif j - i >= least + 2 and table[i + 1] < 0 and table[j - 1] < 0 and fits(i + 1, j - 1) and inside_lonely(table, i + 1, j - 1):
                    yield f"{text[:i]}(({text[i + 2 : j - 1]})){text[j + 1 :]}", True
    for i, j in enumerate(table):
        if j <= i:
            continue
        new = changed(table, remove=[(i, j)])
        inside, outside = leaves_inside_lonely(table, i, j), leaves_outside_lonely(table, i, j)
        if not no_lonely or not inside and not outside:
            yield drawn(new), False
        elif inside and outside_lonely(table, i, j):
            yield drawn(changed(new, remove=[(i + 1, j - 1)])), True
        if shift and (second or not no_lonely):
            for stay, gone in ((i, j), (j, i)):
                for k in free:
                    a, b = min(stay, k), max(stay, k)
                    if k != gone and loop[k] in (i, loop[i]) and (no_lonely or b - a >= least) and fits(a, b):
                        moved = changed(new, add=[(a, b)])
                        if not no_lonely or canonical(moved):
                            yield drawn(moved), False


def rna_moves(sequence: Column | str | None = None, no_lonely: bool = False, shift: bool = False, second: bool = False, least: int = 4, ligand: bool = False) -> Callable:
    """A function (structure, sequence) -> array of (structure, is_double). ligand: also the state with
    the other mark (the steps of binding and release, which count for rates only). Structures may carry
    a trailing *, which neighbours keep, unless second is set."""

    @F.arrow_udf(NEIGHBOUR)
    def generated(structures: pa.Array, sequences: pa.Array) -> pa.Array:
        found, ends, missing = [], [0], []
        for s, q in zip(structures.to_pylist(), sequences.to_pylist()):
            missing.append(s is None or q is None)
            if not missing[-1]:
                bare = s if second else s.rstrip("*")
                if len(bare) != len(q):
                    raise ValueError(f"structure and sequence differ in length: {s} {q}")
                mark = s[len(bare) :]
                found += [(x + mark, d) for x, d in neighbours(q, bare, no_lonely, shift, second, least)]
            ends.append(len(found))
        texts, doubles = zip(*found) if found else ((), ())
        pairs = pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(doubles, pa.bool_())], ["structure", "is_double"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs, mask=pa.array(missing, pa.bool_()))

    def of(structure: Column, seq: Column | str | None = None) -> Column:
        q = seq if seq is not None else sequence
        found = generated(structure, q if isinstance(q, Column) else F.lit(q))
        return F.concat(found, F.array(F.struct(other_mark(structure).alias("structure"), F.lit(False).alias("is_double")))) if ligand else found

    return of


def is_bound(structure: Column) -> Column:
    return structure.endswith("*")


def other_mark(structure: Column) -> Column:
    """The same structure bound if it is unbound, and the other way round."""
    return F.when(is_bound(structure), F.rtrim(structure, F.lit("*"))).otherwise(F.concat(structure, F.lit("*")))


def cut_strands(s: Column) -> Column:
    """The place of a strand cut & (0: none) and the string without it; two cuts are an error."""
    n = F.length(s) - F.length(F.replace(s, F.lit("&"), F.lit("")))
    return F.struct(F.when(n > 1, F.raise_error(F.concat(F.lit("two cuts in "), s))).otherwise(F.instr(s, "&")).alias("cut"), F.replace(s, F.lit("&"), F.lit("")).alias("text"))


def joined_strands(s: Column, cut: Column) -> Column:
    return F.when(cut > 0, F.concat(F.substring(s, F.lit(1), cut - 1), F.lit("&"), F.substring(s, cut, F.length(s)))).otherwise(s)


def base_pairs(structure: Column) -> Column:
    """All pairs `i,j` (from 1) of a dot-bracket string, by one pass with a stack of open places."""
    start = F.struct(F.array().cast("array<int>").alias("open"), F.array().cast("array<string>").alias("pairs"))
    places = F.when(F.length(structure) > 0, F.sequence(F.lit(1), F.length(structure))).otherwise(F.array().cast("array<int>"))

    def step(state, i):
        c = F.substring(structure, i, F.lit(1))
        opened = F.concat(F.array(i), state["open"])
        closed = F.concat(state["pairs"], F.array(F.concat_ws(",", F.element_at(state["open"], 1).cast("string"), i.cast("string"))))
        return F.when(c == "(", F.struct(opened.alias("open"), state["pairs"].alias("pairs"))).when(c == ")", F.struct(F.slice(state["open"], F.lit(2), F.greatest(F.size(state["open"]), F.lit(1))).alias("open"), closed.alias("pairs"))).otherwise(state)

    return F.aggregate(places, start, step, lambda s: s["pairs"])


def in_one_loop(structure: Column, i: Column, j: Column) -> Column:
    """Whether two places (from 1, i < j) are unpaired and what stands between them is closed in itself, so that
    a pair of them crosses no other."""
    inside = F.when(j > i + 1, F.split(structure.substr(i + 1, j - i - 1), "")).otherwise(F.array().cast("array<string>"))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))

    def step(state, c):
        depth = state["depth"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.least(state["least"], depth).alias("least"))

    closed = F.aggregate(inside, start, step, lambda s: (s["depth"] == 0) & (s["least"] == 0))
    return (structure.substr(i, F.lit(1)) == ".") & (structure.substr(j, F.lit(1)) == ".") & closed


def put_pair(structure: Column, i: Column, j: Column, closed: Column) -> Column:
    """The structure with both places (from 1) paired if closed, else unpaired."""
    a, b = (F.when(closed, F.lit(c)).otherwise(F.lit(".")) for c in "()")
    return F.concat(structure.substr(F.lit(1), i - 1), a, structure.substr(i + 1, j - i - 1), b, structure.substr(j + 1, F.length(structure)))


def pair_sum(sequence: Column, structure: Column, energies: dict[str, float], other: float) -> Column:
    """An additive model: the sum of the energies of all pairs by their two bases; `other` for bases that the
    table does not have."""

    @F.arrow_udf("double")
    def summed(sequences: pa.Array, structures: pa.Array) -> pa.Array:
        out = []
        for q, s in zip(sequences.to_pylist(), structures.to_pylist()):
            total, q = 0.0, q or ""
            for i, j in closed_pairs(s or ""):
                total += energies.get(q[i : i + 1] + q[j : j + 1], other)
            out.append(total)
        return pa.array(out, pa.float64())

    return summed(sequence, structure)


def direct_moves(start: Column, target: Column) -> Column:
    """What a direct path does: one struct (i, j, adds, id, after) for each pair `id` (places from 1) that only one
    of the structures has. after: the pairs of start that it shares a place with or crosses, which have to
    be gone before it comes. Equal structures of a batch are worked out once."""

    def crossing(a: tuple, b: tuple) -> bool:
        (i, j), (k, m) = a, b
        return i <= k <= j <= m or k <= i <= m <= j or bool({i, j} & {k, m})

    def found(s: str, t: str) -> list[dict]:
        a, b = set(closed_pairs(s)), set(closed_pairs(t))
        text = lambda p: f"{p[0] + 1},{p[1] + 1}"
        return [{"i": p[0] + 1, "j": p[1] + 1, "adds": p in b, "id": text(p), "after": sorted(text(o) for o in a - b if crossing(o, p)) if p in b else []} for p in sorted(a ^ b)]

    @F.arrow_udf("array<struct<i:int,j:int,adds:boolean,id:string,after:array<string>>>")
    def moves(starts: pa.Array, targets: pa.Array) -> pa.Array:
        place: dict = {}
        at = [place.setdefault(pair, len(place)) for pair in zip(starts.to_pylist(), targets.to_pylist())]
        kind = pa.list_(pa.struct({"i": pa.int32(), "j": pa.int32(), "adds": pa.bool_(), "id": pa.string(), "after": pa.list_(pa.string())}))
        return pa.array([None if None in pair else found(*pair) for pair in place], kind).take(pa.array(at, pa.int32()))

    return moves(start, target)


def paired_places(texts: np.ndarray) -> np.ndarray:
    """For characters of equally long dot-bracket strings, a row each: the place that each opening bracket is
    closed at, -1 elsewhere. One step a place, for all rows together."""
    n, length = texts.shape
    out, open_, top = np.full((n, length), -1), np.zeros((n, length), dtype=int), np.zeros(n, dtype=int)
    for j in range(length):
        opens, closes = np.flatnonzero(texts[:, j] == "("), np.flatnonzero(texts[:, j] == ")")
        open_[opens, top[opens]] = j
        top[opens] += 1
        top[closes] -= 1
        if (top[closes] < 0).any():
            raise ValueError(f"unbalanced structure {''.join(texts[closes[top[closes] < 0][0]])}")
        out[closes, open_[closes, top[closes]]] = j
    return out


def pair_distance(a: Column, b: Column) -> Column:
    """Number of base pairs that only one of two structures has; null has none."""

    @F.pandas_udf("int")
    def differing(a: pd.Series, b: pd.Series) -> pd.Series:
        length, out = max(1, a.str.len().max(), b.str.len().max()), []
        step = max(1, (1 << 20) // length)
        for k in range(0, len(a), step):
            p, q = (paired_places(np.array(c[k : k + step].tolist(), dtype=f"U{length}").view("U1").reshape(-1, length)) for c in (a, b))
            out.append(((p >= 0) & (p != q)).sum(axis=1) + ((q >= 0) & (p != q)).sum(axis=1))
        return pd.Series(np.concatenate(out))

    return differing(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def hamming(a: Column, b: Column) -> Column:
    """Places at which two strings differ, up to the end of the shorter one."""
    n = F.least(F.length(a), F.length(b))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(places, lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))
