"""Local moves of lattice chains written as relative steps (F L R on the square lattice, and U D on
the cubic one)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from basinflow.functions.moves import MoveSet, at, put

# Windows that replace each other (either way), and ends that do.
SQUARE = "LRL FLF, RLR FRF, LRF FLR, RLF FRL, LRRL RLLR"
CUBIC = (
    "LRF DDR, LRL DDD, LRR DDU, LRD DDF, RLF DUL, RLL DUU, RLR DUD, RLU DUF, UDF RRD, UDR RRF, UDU RRR, UDD RRL, UUF LLU, UUL LLF, UUU LLL, UUD LLR, "
    "FLF LUL, FLL LUU, FLR LUD, FLU LUF, ULF FUL, ULL FUU, ULR FUD, ULU FUF, FDF DRD, FDR DRF, FDU DRR, FDD DRL, FRF RDR, FRL RDD, FRR RDU, FRD RDF, LURD RDLU, ULDR DRUL"
)
SQUARE_ENDS = "LR FL, FR RL"
CUBIC_ENDS = "FL LU, FR RD, FU UL, FD DR, LL UU, LR DD, RL DU, RR UD"


def both_ways(listed: str) -> dict[str, str]:
    out = {}
    for pair in listed.split(", "):
        a, b = pair.split()
        out[a], out[b] = b, a
    return out


def crankshaft(alphabet: str) -> MoveSet:
    """Windows from the second step on (three letters, else four), the last two steps, and all other
    letters for the last step. Alphabets of three and of five letters have windows."""
    inner, ends = {3: (SQUARE, SQUARE_ENDS), 5: (CUBIC, CUBIC_ENDS)}.get(len(alphabet), ("", ""))
    literal = lambda table: F.create_map(*(F.lit(x) for kv in both_ways(table).items() for x in kv)) if table else F.create_map().cast("map<string,string>")
    windows, tails = literal(inner), literal(ends)

    def of(s: Column) -> Column:
        n = F.length(s)
        starts = F.when(n >= 4, F.sequence(F.lit(2), n - 2)).otherwise(F.array().cast("array<int>"))
        new = lambda i: F.coalesce(windows[F.substring(s, i, F.lit(3))], windows[F.substring(s, i, F.lit(4))])
        cranked = F.transform(F.filter(starts, lambda i: new(i).isNotNull()), lambda i: F.overlay(s, new(i), i, F.length(new(i))))
        tail = tails[F.substring(s, n - 1, F.lit(2))]
        ended = F.when(tail.isNotNull(), F.array(F.overlay(s, tail, n - 1, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        pivots = F.transform(F.filter(F.array(*(F.lit(c) for c in alphabet)), lambda c: c != at(s, n)), lambda c: put(s, n, c))
        return F.concat(cranked, ended, pivots)

    return of
