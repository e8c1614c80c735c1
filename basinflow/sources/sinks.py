"""Sinks: result tables as text, rate matrices, saddle lists, paths and drawings.

Text sinks build lines in Spark and write them in order; what is drawn or densified is cut to a
bounded number of minima first.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinflow.operators.graph import rank_within
from basinflow.operators.landscape import ID
from basinflow.operators.post import incidence, leaf_order


def bar_lines(tree: DataFrame, rna: bool = False, saddles: bool = False, flags: bool = False, sizes: DataFrame | None = None) -> DataFrame:
    """Lines of the minima table: number, structure, energy, father, barrier, and on request the
    objectives with their Pareto flag, the saddle (~ for a root) and pool columns."""
    number = "%6.2f" if rna else "%13.5f"
    columns = [F.format_string("%4d", "lmin"), F.col("structure"), F.format_string(number, "energy")]
    if flags:
        columns += [F.array_join(F.transform("pov", lambda x: x.cast("string")), " ")]
    columns += [F.format_string("%4d", "father"), F.format_string(number, "barrier")]
    if flags:
        columns.append(F.when(F.col("is_global"), "*").otherwise("."))
    if saddles:
        columns.append(F.coalesce(F.col("saddle_structure"), F.lit("~")))
    rows = tree
    if sizes is not None:
        rows = rows.join(sizes, [ID, "lmin"], "left")
        columns += [F.format_string("%12d", "pool"), F.format_string("%8.3f", "free_energy")]
    return rows.select(ID, "lmin", F.concat_ws(" ", *columns).alias("value"))


def write_bar(tree: DataFrame, header: str, path: str, **options) -> None:
    lines = bar_lines(tree, **options).select("lmin", "value").unionByName(tree.sparkSession.createDataFrame([(0, "     " + header)], "lmin long, value string"))
    lines.orderBy("lmin").select("value").coalesce(1).write.mode("overwrite").text(path)


def write_saddles(components: DataFrame, states: DataFrame, path: str) -> None:
    met = components.where(F.size("basins") > 1).join(states.select(ID, F.col("rank").alias("comp"), "structure"), [ID, "comp"])
    line = F.concat_ws(" ", F.format_string("%13.5f", "energy"), F.col("size").cast("string"), "structure", F.array_join(F.transform("basins", lambda b: b["lmin"].cast("string")), " "))
    met.select("energy", "comp", line.alias("value")).orderBy("energy", "comp").select("value").write.mode("overwrite").text(path)


def bounded(rates: DataFrame, most: int = 5000) -> int:
    """Number of basins; an error beyond `most`, of which no dense matrix is made."""
    size = rates.agg(F.greatest(F.max("i"), F.max("j"))).first()[0] or 0
    if size > most:
        raise ValueError(f"a matrix of {size} basins is not written densely; the sparse rows are the result")
    return size


def dense(rates: DataFrame, most: int = 5000) -> np.ndarray:
    """The rates of one landscape as a matrix on the driver; an error beyond `most` basins."""
    size = bounded(rates, most)
    out = np.zeros((size, size))
    for r in rates.select("i", "j", "rate").toLocalIterator():
        out[r["i"] - 1, r["j"] - 1] = r["rate"]
    return out


def write_bytes(path: str, parts) -> None:
    """A file at a path or URI, in a folder that the driver reaches."""
    from pyarrow import fs

    to, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    with to.open_output_stream(name) as out:
        for part in parts:
            out.write(part)


def write_landscape(states: DataFrame, header: str, path: str) -> None:
    """states as a landscape's text, in the order of their ranks, for readers.read_landscape(): structure,
    energy, objectives and listed neighbours, behind a header line."""
    extra = [F.array_join(F.transform("pov", lambda x: x.cast("string")), " ")] if "pov" in states.columns else []
    listed = [F.coalesce("listed", F.lit(":"))] if "listed" in states.columns else []
    lines = states.select("rank", F.concat_ws(" ", "structure", F.format_string("%.5f", "energy"), *extra, *listed).alias("value"))
    first = states.sparkSession.createDataFrame([(0, header)], "rank long, value string")
    first.unionByName(lines).orderBy("rank").select("value").write.mode("overwrite").text(path)


def write_text_rates(rates: DataFrame, path: str) -> None:
    """The matrix as text, a row a line: rows are made dense in Spark, and written by it."""
    size = bounded(rates)
    line = F.concat(F.array_join(F.transform("row", lambda x: F.format_string("%10.4g", x)), " "), F.lit(" "))
    rows = rates.sparkSession.range(1, size + 1).withColumnRenamed("id", "i").join(incidence(rates, size).drop(ID), "i", "left")
    rows.withColumn("row", F.coalesce("row", F.array_repeat(F.lit(0.0), size))).orderBy("i").select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_binary_rates(rates: DataFrame, path: str) -> None:
    """int32 dimension, then the matrix column after column."""
    matrix = dense(rates)
    write_bytes(path, [struct.pack("<i", len(matrix)), *(matrix[:, j].astype("<f8").tobytes() for j in range(len(matrix)))])


def write_reorder_map(order: DataFrame, path: str) -> None:
    """The map of old to new numbers (see post.reordered), for later runs."""
    order.select("lmin", "bound", "new_id").orderBy("new_id").coalesce(1).write.mode("overwrite").json(path)


def reordered_bars(minima: DataFrame, order: DataFrame) -> DataFrame:
    """Lines of the minima tables of the unbound (u), bound (b) and of all minima (r) under their new
    numbers: part, new_id, value. Bound ones are numbered from 1 in their own table; fathers follow."""
    ids = order.select(ID, "lmin", "bound", "new_id")
    unbound = ids.groupBy(ID).agg(F.sum(F.when(F.col("bound"), 0).otherwise(1)).alias("_unbound"))
    up = ids.select(ID, F.col("lmin").alias("father"), F.col("new_id").alias("_father"))
    rows = minima.join(ids, [ID, "lmin"]).join(up, [ID, "father"], "left").join(unbound, ID)
    line = lambda n, father: F.concat_ws(" ", F.format_string("%4d", n), "structure", F.format_string("%6.2f", "energy"), F.format_string("%4d", father), F.format_string("%6.2f", "barrier"))
    father = F.coalesce("_father", F.lit(0)).cast("long")
    own = lambda n: F.when(F.col("bound") & (n > 0), n - F.col("_unbound")).otherwise(n)
    every = rows.select(ID, F.lit("r").alias("part"), "new_id", line(F.col("new_id"), father).alias("value"))
    apart = rows.select(ID, F.when(F.col("bound"), "b").otherwise("u").alias("part"), "new_id", line(own(F.col("new_id")), own(father)).alias("value"))
    return every.unionByName(apart)


def map_lines(mapped: DataFrame) -> DataFrame:
    """Lines of Landscape.map_structures(): the minimum's structure, rank, energy, basin and true minimum by
    merging (where these columns are there), and both by descent; a structure that is not in the landscape
    says so."""
    merged = ["basin", "true_basin"] if "basin" in mapped.columns else []
    known = F.concat_ws(" ", "minimum", F.format_string("%6d", "rank"), F.format_string("%6.2f", "energy"), *(F.format_string("%6d", F.coalesce(c, F.lit(0))) for c in (*merged, "lmin", "true_id")))
    return mapped.select(ID, "structure", F.when(F.col("found"), known).otherwise(F.concat_ws(" ", "structure", F.lit("not found"))).alias("value"))


def tree_map_lines(mapped: DataFrame) -> DataFrame:
    """Lines of post.mapped_trees(): source -> target if the structures are equal, source ~> target else."""
    return mapped.select(ID, "source", F.concat_ws(" ", F.format_string("%4d", "source"), F.when(F.col("exact"), "->").otherwise("~>"), F.format_string("%4d", "target")).alias("value"))


def connected_states(states: DataFrame, labels: DataFrame, basins: DataFrame) -> DataFrame:
    """States that belong to a true minimum, numbered anew in their order, with it and their basin:
    landscape_id, number, structure, energy, true_id, lmin."""
    held = states.join(labels.select(ID, "rank", F.col("label").alias("true_id")), [ID, "rank"]).join(basins.select(ID, "rank", "lmin"), [ID, "rank"])
    return rank_within(held, [ID], ["rank"], "number").select(ID, "number", "structure", "energy", "true_id", "lmin")


def write_path(path: DataFrame, to: str) -> None:
    path.orderBy("step").select(F.format_string("%s (%6.2f) %s", "structure", "energy", "mark").alias("value")).coalesce(1).write.mode("overwrite").text(to)


def eps(tree: DataFrame, landscape: str, most: int = 100, width: float = 500.0, height: float = 600.0) -> str:
    """The merge tree of one landscape as an EPS drawing of at most `most` minima."""
    shown = tree.where(F.col(ID) == landscape).orderBy("lmin").limit(most)
    rows = {r["lmin"]: r for r in shown.join(leaf_order(shown), [ID, "lmin"]).collect()}
    if not rows:
        return "%!PS-Adobe-3.0 EPSF-3.0\n%%EOF\n"
    low, high = min(r["energy"] for r in rows.values()), max(r["e_saddle"] for r in rows.values())
    y = lambda e: 40 + (height - 60) * (e - low) / ((high - low) or 1.0)
    at = {i: 20 + (width - 40) * (r["place"] + 0.5) / len(rows) for i, r in rows.items()}
    out = ["%!PS-Adobe-3.0 EPSF-3.0", f"%%BoundingBox: 0 0 {width:.0f} {height:.0f}", "/Helvetica findfont 8 scalefont setfont 0.5 setlinewidth"]
    for i, r in sorted(rows.items(), key=lambda x: (x[1]["e_saddle"], x[0])):
        out.append(f"newpath {at[i]:.2f} {y(r['energy']):.2f} moveto {at[i]:.2f} {y(r['e_saddle']):.2f} lineto stroke")
        out.append(f"{at[i] - 3:.2f} {y(r['energy']) - 10:.2f} moveto ({i}) show")
        if r["father"] in rows:
            out.append(f"newpath {at[i]:.2f} {y(r['e_saddle']):.2f} moveto {at[r['father']]:.2f} {y(r['e_saddle']):.2f} lineto stroke")
    return "\n".join([*out, "showpage", "%%EOF", ""])
