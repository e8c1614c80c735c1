"""Sequence design: translation, similarity to a protein, mutants that respect a structure, and the
enumeration of all sequences under a constraint."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basinflow.functions.moves import put
from basinflow.functions.rna import pair_list
from basinflow.operators.graph import spread

# The standard genetic code in the order U C A G of the three bases (* for a stop), the
# bases that IUPAC letters stand for, and base pairs in their order.
GENETIC_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
IUPAC = {"A": "A", "C": "C", "G": "G", "U": "U", "R": "AG", "Y": "CU", "S": "CG", "W": "AU", "K": "GU", "M": "AC", "B": "CGU", "D": "AGU", "H": "ACU", "V": "ACG", "N": "ACGU"}
WATSON_CRICK = ("AU", "CG", "GC", "UA")
WOBBLE = (*WATSON_CRICK, "GU", "UG")


def codons() -> dict[str, str]:
    bases = "UCAG"
    return {a + b + c: GENETIC_CODE[16 * i + 4 * j + k] for i, a in enumerate(bases) for j, b in enumerate(bases) for k, c in enumerate(bases)}


def translated(sequence: Column) -> Column:
    """The amino acids of all whole codons, as an array of letters."""
    table = F.create_map(*(F.lit(x) for kv in codons().items() for x in kv))
    n = F.floor(F.length(sequence) / 3).cast("int")
    return F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda k: table[F.substring(sequence, 3 * k + 1, F.lit(3))])


def mutations(acids: Column, protein: str) -> Column:
    """Places at which the acids differ from the protein (up to the shorter end)."""
    other = F.array(*(F.lit(c) for c in protein))
    return F.size(F.filter(F.arrays_zip(acids.alias("a"), other.alias("b")), lambda x: x["a"].isNotNull() & x["b"].isNotNull() & (x["a"] != x["b"])))


def similarity(acids: Column, protein: str, scores: dict[tuple[str, str], int] | None = None, match: int = 5, mismatch: int = -1) -> Column:
    """Sum of the scores without gaps, null if a stop codon occurs (no score is low enough for it).
    scores: a substitution matrix by pairs of letters; None: match and mismatch."""
    other = F.array(*(F.lit(c) for c in protein))
    pairs = F.filter(F.arrays_zip(acids.alias("a"), other.alias("b")), lambda x: x["a"].isNotNull() & x["b"].isNotNull())
    if scores is None:
        value = lambda x: F.when(x["a"] == x["b"], F.lit(match)).otherwise(F.lit(mismatch))
    else:
        both = {**{(b, a): v for (a, b), v in scores.items()}, **scores}
        table = F.create_map(*(F.lit(x) for (a, b), v in both.items() for x in (a + b, v)))
        value = lambda x: table[F.concat(x["a"], x["b"])]
    total = F.aggregate(pairs, F.lit(0), lambda s, x: s + value(x))
    return F.when(~F.exists(pairs, lambda x: x["a"] == "*"), total)


def read_scores(spark: SparkSession, path: str) -> dict[tuple[str, str], int]:
    """A substitution matrix in the usual text form: a header line of letters, then a row a letter."""
    rows = [r[0].split() for r in spark.read.text(path).collect() if r[0].strip() and not r[0].startswith("#")]
    return {(row[0], c): int(v) for row in rows[1:] for c, v in zip(rows[0], row[1:])}


def fitting(sequence: Column, protein: str, most_mutations: int, least_score: int, scores=None) -> Column:
    acids = translated(sequence)
    return (mutations(acids, protein) <= most_mutations) & F.coalesce(similarity(acids, protein, scores) >= least_score, F.lit(False))


def partners(structure: str) -> list[int]:
    """Pair table of a design structure, in which G opens and U closes a pair that may wobble."""
    return pair_list(structure.replace("G", "(").replace("U", ")"))


def mutants(structure: str, protein: str, most_mutations: int, least_score: int, scores=None):
    """A move set: all other bases of unpaired places and all other base pairs, if they fit."""
    table = partners(structure)

    def bases(s: Column, i: int) -> Column:
        here = F.substring(s, i + 1, 1)
        return F.transform(F.filter(F.array(*map(F.lit, "ACGU")), lambda b: b != here), lambda b: put(s, F.lit(i + 1), b))

    def pairs(s: Column, i: int, j: int, kinds: tuple[str, ...]) -> Column:
        here = F.concat(F.substring(s, i + 1, 1), F.substring(s, j + 1, 1))
        return F.transform(F.filter(F.array(*map(F.lit, kinds)), lambda p: p != here), lambda p: put(put(s, F.lit(i + 1), F.substring(p, 1, 1)), F.lit(j + 1), F.substring(p, 2, 1)))

    def of(s: Column) -> Column:
        found = [bases(s, i) if c == "." else pairs(s, i, table[i], WATSON_CRICK if c == "(" else WOBBLE) for i, c in enumerate(structure) if c in ".(G"]
        return F.filter(F.concat(*found), lambda x: fitting(x, protein, most_mutations, least_score, scores)) if found else F.array().cast("array<string>")

    return of


def allowed(sequence: Column, constraint: str) -> Column:
    """Whether every place of a sequence holds one of the bases that the constraint's letter stands for."""
    if set(constraint) - set(IUPAC):
        raise ValueError(f"not IUPAC letters: {constraint}")
    here = lambda i: F.substring(sequence, i + 1, 1)
    out = F.length(sequence) == len(constraint)
    for i, c in enumerate(constraint):
        out = out & here(i).isin(*IUPAC[c])
    return out


def paired(sequence: Column, structure: str) -> Column:
    """Whether both ends of every pair of a design structure can pair (G and U close wobbles too)."""
    table, out = partners(structure), F.length(sequence) == len(structure)
    for i, c in enumerate(structure):
        if c in "(G":
            out = out & F.concat(F.substring(sequence, i + 1, 1), F.substring(sequence, table[i] + 1, 1)).isin(*(WATSON_CRICK if c == "(" else WOBBLE))
    return out


def possible(constraint: str, structure: str) -> bool:
    """Whether each pair of a structure has letters under the constraint that can pair."""
    table = partners(structure)
    kinds = {"(": WATSON_CRICK, "G": WOBBLE}
    return all(any(a + b in kinds[c] for a in IUPAC[constraint[i]] for b in IUPAC[constraint[table[i]]]) for i, c in enumerate(structure) if c in kinds)


def pairing(letters: Column, first: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(letters, lambda b: F.concat(first, b).isin(*kinds))


def sequences(spark: SparkSession, constraint: str, structure: str) -> DataFrame:
    """All sequences under an IUPAC constraint and a structure: one column, sequence. Places are
    added one after another by exploding the letters they allow, so the rows grow in Spark."""
    if len(constraint) != len(structure) or set(constraint) - set(IUPAC):
        raise ValueError("constraint and structure must have one length and IUPAC letters")
    if not possible(constraint, structure):
        raise ValueError("no letters of the constraint can pair as the structure asks")
    table = partners(structure)
    out = spark.range(1).select(F.lit("").alias("sequence"))
    for i, c in enumerate(structure):
        allowed = F.array(*map(F.lit, IUPAC[constraint[i]]))
        if table[i] >= 0 and table[i] < i:
            first = F.substring("sequence", table[i] + 1, 1)
            kinds = WATSON_CRICK if c == ")" else WOBBLE
            allowed = pairing(allowed, first, kinds)
        out = out.select(F.explode(allowed).alias("_b"), "sequence").select(F.concat("sequence", "_b").alias("sequence"))
        if i % 8 == 7:
            out = out.repartition("sequence")
    return out


def scored(found: DataFrame, protein: str, scores=None) -> DataFrame:
    acids = translated(F.col("sequence"))
    return found.withColumn("mutations", mutations(acids, protein)).withColumn("score", similarity(acids, protein, scores))


def codon_choices(names: list[str], scores: dict[tuple[str, str], int] | None, match: int, mismatch: int) -> Callable[[Column, Column], Column]:
    """A function (constraint, protein) of whole strings, whose last codons and acids get a field each: all codons
    that the three IUPAC letters stand for, save stops and those without a score, with what each adds to mutations
    and score, and the fewest mutations and the highest score among them (null if there are none). Equal
    letters and acids of a batch are worked out once."""
    code, both = codons(), None if scores is None else {**{(b, a): v for (a, b), v in scores.items()}, **scores}
    kind = "struct<choices:array<struct<codon:string,mutation:int,score:int>>,mutations:int,score:int>"

    def found(letters: str, wanted: str) -> dict:
        made = [(c, code[c]) for c in map("".join, product(*(IUPAC.get(x, "") for x in letters))) if code[c] != "*"]
        priced = [(c, a, (match if a == wanted else mismatch) if both is None else both.get((a, wanted))) for c, a in made]
        kept = [{"codon": c, "mutation": int(a != wanted), "score": v} for c, a, v in priced if v is not None]
        return {"choices": kept, "mutations": min((c["mutation"] for c in kept), default=None), "score": max((c["score"] for c in kept), default=None)}

    @F.arrow_udf(f"struct<{','.join(f'{x}:{kind}' for x in names)}>")
    def choices(constraints: pa.Array, proteins: pa.Array) -> pa.Array:
        held = pa.struct({"choices": pa.list_(pa.struct({"codon": pa.string(), "mutation": pa.int32(), "score": pa.int32()})), "mutations": pa.int32(), "score": pa.int32()})
        columns, rows = [], [(c or "", p or "") for c, p in zip(constraints.to_pylist(), proteins.to_pylist())]
        for k in range(len(names), 0, -1):
            place: dict = {}
            at = [place.setdefault((c[len(c) - 3 * k :][:3], p[len(p) - k :][:1]), len(place)) for c, p in rows]
            columns.append(pa.array([found(*pair) for pair in place], held).take(pa.array(at, pa.int32())))
        return pa.StructArray.from_arrays(columns, names)

    return choices


def pruned_sequences(designs: DataFrame, structure: str, most_mutations: int, least_score: int, scores: dict[tuple[str, str], int] | None = None, match: int = 5, mismatch: int = -1, rows: list[int] | None = None) -> DataFrame:
    """For designs(constraint, protein, ...): all sequences under the IUPAC constraint and the structure that
    differ from the protein at no more than so many acids, without a stop, and score at least so much: the
    columns of designs with sequence, mutations and score.

    Branch and bound by codons. The codons that a constraint allows at a place, whatever stands elsewhere, give
    the fewest mutations and the highest score that the rest can still have; a beginning that cannot
    keep both limits with them is dropped when it is made, so rows only grow with beginnings that
    may end well. rows: a list that gets the number of rows after each codon (a count each).

    null constraints and proteins, and constraints of another length than the structure or without three
    letters for each acid, have no sequences; unknown letters stand for no base."""
    if len(structure) % 3:
        raise ValueError("a structure of whole codons")
    table, n = partners(structure), len(structure) // 3
    name = "_basinflow_{}".format

    def priced(rows: DataFrame, first: int) -> DataFrame:
        """rows with the choices of each codon from the first one on."""
        names = [name(k) for k in range(first, n)]
        made = rows.withColumn("_basinflow", codon_choices(names, scores, match, mismatch)(F.col("constraint"), F.col("protein")))
        return made.select(*rows.columns, "_basinflow.*")

    def fits(k: int, codon: Column) -> Column:
        """Whether the bases of the k-th codon pair with those before them (or among themselves)."""
        ok, whole = F.lit(True), F.concat("sequence", codon)
        for j in range(3 * k, 3 * k + 3):
            if 0 <= table[j] < j:
                ok = ok & F.concat(F.substring(whole, table[j] + 1, 1), F.substring(whole, j + 1, 1)).isin(*(WATSON_CRICK if structure[j] == ")" else WOBBLE))
        return ok

    kept = designs.columns
    out = priced(spread(designs.where((F.length("constraint") == 3 * n) & (F.length("protein") == n)), *kept), 0)
    for k in range(n):
        out = out.where(F.col(f"{name(k)}.score").isNotNull())
    out = out.withColumn("sequence", F.lit("")).withColumn("mutations", F.lit(0)).withColumn("score", F.lit(0))
    for k in range(n):
        rest = lambda what: sum((F.col(f"{name(j)}.{what}") for j in range(k + 1, n)), F.lit(0))  # noqa: B023, E731
        left = [name(j) for j in range(k + 1, n)]
        grown = out.withColumn("_basinflow_c", F.explode(f"{name(k)}.choices")).where(fits(k, F.col("_basinflow_c.codon")))
        out = grown.select(*kept, *left, F.concat("sequence", "_basinflow_c.codon").alias("sequence"), (F.col("mutations") + F.col("_basinflow_c.mutation")).alias("mutations"), (F.col("score") + F.col("_basinflow_c.score")).alias("score"))
        out = out.where((F.col("mutations") + rest("mutations") <= most_mutations) & (F.col("score") + rest("score") >= least_score))
        if k % 4 == 0 and k < n - 1:
            out = priced(spread(out.drop(*left), *kept, "sequence"), k + 1)
        if rows is not None:
            rows.append(out.count())
    return out
