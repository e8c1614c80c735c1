"""Near-duplicate vectors by an epsilon grid order join.

Vectors are scaled to length one, so a cosine of c is a distance of sqrt(2 - 2c) = epsilon. They
are projected on the leading principal directions, sorted by their grid cells (side epsilon) there,
lexicographically, and the sequence is cut into intervals of bounded size. Two intervals are
joined only if their boxes (leading coordinates, and the length of the rest) come within epsilon.
Inside a pair of intervals the join goes on recursively: a pair of runs whose boxes are farther
apart is skipped, larger runs are halved, small ones are compared by one matrix product whose
near-threshold values are decided in double precision.

Equal vectors are one row with a count, so a group of copies costs nothing. A pair of intervals
gives back link counts and a spanning forest per row, never all pairs.

A vector that is null, zero, of another length than the usual one, or has null or non-finite
components links with nothing. null ids: the row stays, and component ids come from the others.
Repeated rows count as separate vectors. Extra columns (and labels) are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinflow.llm.common import connected_components, cut, global_rank
from basinflow.llm.simhash import forest

#: Leading principal directions, rows of an interval, rows of a run that is compared as a whole.
LEAD, INTERVAL, RUN = 6, 4096, 256


def usable(col: str):
    value = F.col(col)
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return value.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(value, lambda x: x != 0), F.lit(False))


def raw(col) -> np.ndarray:
    """A column of equally long float arrays as a matrix in double precision."""
    flat = col.flatten() if isinstance(col, pa.Array) else col
    return np.asarray(flat, np.float64).reshape(len(col), -1)


def principal(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and leading principal directions of the unit vectors: each task gives one matrix of
    sums, which Spark adds up; only one width x width matrix reaches the driver."""

    def run(batches):
        total = np.zeros((width + 1, width + 1))
        for batch in batches:
            if len(batch):
                x = raw(batch.column(0))
                x = np.hstack([x / np.linalg.norm(x, axis=1)[:, None], np.ones((len(x), 1))])
                total += x.T @ x
        yield pa.RecordBatch.from_pydict({"cell": pa.array(range(total.size), pa.int32()), "value": total.ravel()})

    sums = rows.select("vec").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    total = np.zeros((width + 1, width + 1))
    for r in sums.collect():
        total.flat[r["cell"]] = r["value"]
    n = max(total[-1, -1], 1.0)
    mean = total[-1, :-1] / n
    _, directions = np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))
    return mean, directions[:, ::-1][:, : min(LEAD, width)]


class Runs:
    """One interval's rows: unit vectors, leading coordinates, length of the rest."""

    def __init__(self, x: np.ndarray, mean: np.ndarray, directions: np.ndarray):
        self.x = x / np.linalg.norm(x, axis=1)[:, None]
        centred = self.x - mean
        self.lead = centred @ directions
        rest = np.sqrt(np.maximum((centred**2).sum(1) - (self.lead**2).sum(1), 0))
        self.box = np.hstack([self.lead, rest[:, None]])
        self.small = self.x.astype(np.float32)

    def bounds(self, a: int, b: int):
        return self.box[a:b].min(0), self.box[a:b].max(0)


def far(one, two, epsilon: float) -> bool:
    """Whether two boxes are surely more than epsilon apart. The rest counts as one coordinate:
    the distance of two rests is at least the difference of their lengths."""
    gap = np.maximum(0, np.maximum(one[0] - two[1], two[0] - one[1]))
    return float((gap**2).sum()) > epsilon**2 * (1 + 1e-9) + 1e-12


def join_runs(a: Runs, b: Runs, same: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of all linked rows; with same, each pair once."""
    epsilon, left, right = math.sqrt(max(0.0, 2 - 2 * least)), [], []
    todo = [(0, len(a.x), 0, len(b.x))]
    while todo:
        i, j, k, m = todo.pop()
        if same and i >= m or i >= j or k >= m or far(a.bounds(i, j), b.bounds(k, m), epsilon):
            continue
        if j - i > RUN or m - k > RUN:
            if j - i >= m - k:
                mid = (i + j) // 2
                todo += [(i, mid, k, m), (mid, j, k, m)]
            else:
                mid = (k + m) // 2
                todo += [(i, j, k, mid), (i, j, mid, m)]
            continue
        near = np.argwhere(a.small[i:j] @ b.small[k:m].T >= least - 1e-4) + (i, k)
        if same:
            near = near[near[:, 0] < near[:, 1]]
        p, q = near.T
        ok = np.einsum("ij,ij->i", a.x[p], b.x[q]) >= least
        left.append(p[ok])
        right.append(q[ok])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def tile(rows: pa.Table, mean: np.ndarray, directions: np.ndarray, least: float) -> pa.Table:
    """Of one pair of intervals: per linked row its link count, and a link of the forest or null."""
    rows = rows.sort_by("rank")
    first, second = (rows.filter(pa.compute.equal(rows["side"], s)).combine_chunks() for s in (0, 1))
    same = not len(second)
    a = Runs(raw(first["vec"].combine_chunks()), mean, directions)
    b = a if same else Runs(raw(second["vec"].combine_chunks()), mean, directions)
    p, q = join_runs(a, b, same, least)
    ids = np.concatenate([first["rank"].to_numpy(), second["rank"].to_numpy()])
    n = np.concatenate([first["n"].to_numpy(), second["n"].to_numpy()])
    q = q if same else q + len(first)
    count = np.bincount(p, n[q], len(ids)) + np.bincount(q, n[p], len(ids))
    links = pd.DataFrame(forest(ids, p, q), columns=["rank", "other"], dtype="int64")
    linked = np.flatnonzero(count)
    return pa.table({
        "rank": np.concatenate([ids[linked], links["rank"]]).astype(np.int64), "n_links": np.concatenate([count[linked].astype(np.int64), np.zeros(len(links), np.int64)]),
        "other": pa.concat_arrays([pa.nulls(len(linked), pa.int64()), pa.array(links["other"].to_numpy(np.int64))]),
    })


def near_duplicates(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    spark = vectors.sparkSession
    every = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"))
    width = every.where("vec is not null").groupBy(F.size("vec").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").first()
    width = width["w"] if width and width["w"] > 0 else 1
    # +0.0 and -0.0 are equal numbers but different bytes
    every = every.withColumn("vec", F.when(usable("vec") & (F.size("vec") == width), F.transform("vec", lambda x: x + F.lit(0.0))))
    # Squares of very large or small components leave the range of numbers: such vectors are first
    # divided by their largest component, which changes no cosine.
    top = F.array_max(F.transform("vec", lambda x: F.abs(x)))
    every = cut(every.withColumn("vec", F.when((top > 1e-100) & (top < 1e100), F.col("vec")).otherwise(F.transform("vec", lambda x: x / top))))
    groups = every.where("vec is not null").groupBy("vec").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
    mean, directions = principal(groups, width)
    epsilon = math.sqrt(max(1e-12, 2 - 2 * least))

    def place(batches):
        for batch in batches:
            if len(batch):
                box = Runs(raw(batch.column(0)), mean, directions).box
                cells = np.floor(box[:, :-1] / epsilon).astype(np.int32)
                kinds = pa.list_(pa.int32()), pa.list_(pa.float64())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(cells), kinds[0]), pa.array(list(box), kinds[1])], names=["vec", "n", "first", "cells", "box"])

    placed = groups.mapInArrow(place, "vec array<double>, n long, first long, cells array<int>, box array<double>")
    order = [*(F.col("cells")[i] for i in range(directions.shape[1])), F.col("box")[0], F.xxhash64("vec"), F.col("vec")]
    ranked = cut(global_rank(placed, order, "rank").withColumn("interval", F.floor(F.col("rank") / INTERVAL)))

    dims = range(directions.shape[1] + 1)
    boxes = ranked.groupBy("interval").agg(*(f(F.col("box")[i]).alias(f"{name}{i}") for i in dims for name, f in (("lo", F.min), ("hi", F.max))))
    # Intervals that can be joined lie in the same or in neighbouring cells of the first direction.
    cell = lambda x: F.floor(x / F.lit(epsilon))
    left = boxes.withColumn("cell", F.explode(F.sequence(cell(F.col("lo0")) - 1, cell(F.col("hi0")) + 1)))
    right = boxes.select(*(F.col(c).alias(f"o_{c}") for c in boxes.columns)).withColumn("cell", F.explode(F.sequence(cell(F.col("o_lo0")), cell(F.col("o_hi0")))))
    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"lo{i}") - F.col(f"o_hi{i}"), F.col(f"o_lo{i}") - F.col(f"hi{i}")), 2) for i in dims), F.lit(0.0))
    near = left.join(right, "cell").where(F.col("interval") <= F.col("o_interval")).where(gap <= epsilon**2 * (1 + 1e-9) + 1e-12)
    pairs = cut(near.select(F.col("interval").alias("i"), F.col("o_interval").alias("j")).distinct())
    sides = pairs.select("i", "j", F.col("i").alias("interval"), F.lit(0).alias("side")).unionByName(pairs.where("i < j").select("i", "j", F.col("j").alias("interval"), F.lit(1).alias("side")))
    tiles = ranked.select("interval", "rank", "n", "vec").join(sides, "interval").select("i", "j", "rank", "n", "vec", "side")
    found = cut(tiles.groupBy("i", "j").applyInArrow(lambda t: tile(t, mean, directions, least), "rank long, n_links long, other long"))

    counts = found.groupBy("rank").agg(F.sum("n_links").alias("n_links"))
    parts = connected_components(found.where("other is not null").select(F.col("rank").alias("src"), F.col("other").alias("dst")))
    named = ranked.select("rank", "vec", "n", "first").join(counts, "rank", "left").join(parts, F.col("rank") == F.col("node"), "left").withColumn("part", F.coalesce("component", "rank"))
    lowest = named.groupBy("part").agg(F.min("first").alias("component_id"))
    known = named.join(lowest, "part").select(F.col("vec").alias("_vec"), (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = every.join(known, every["vec"] == known["_vec"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("_vec").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
