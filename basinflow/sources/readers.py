"""Sources: landscape text files, results of earlier runs, and generated landscapes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basinflow.operators.graph import cut
from basinflow.operators.landscape import ID


@dataclass(frozen=True)
class Header:
    """First line of a landscape file: sequence, objectives (P:d), graph and the rest."""

    sequence: str
    objectives: int = 0
    graph: str = "RNA"
    cut: int = 0
    design: tuple[str, str, int, int] | None = None


def read_header(spark: SparkSession, path: str) -> Header:
    """The header of a file, or of a folder whose files follow each other as in numbered(): Spark itself reads
    large files first, so that the first rows of a table are not always the first lines."""
    first = ["_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id()]
    lines = [r["value"] for r in spark.read.text(path).orderBy(*first).limit(2).collect()]
    tokens = lines[0].split()
    objectives = next((int(t[2:]) for t in tokens[2:] if t.startswith("P:") and t[2:].isdigit()), 0)
    graph = next((t for t in tokens[2:] if t[0] in "RQTPX?S" and not t.startswith("P:")), "RNA")
    design = None
    if graph.startswith("SECIS"):
        _, most, least = graph.split(",")
        structure, protein = lines[1].split()[:2]
        design, graph = (structure, protein, int(most), int(least)), "S"
    sequence = tokens[-1] if graph[0] == "Q" and tokens[-1] != graph else tokens[0]
    if sequence.count("&") > 1:
        raise ValueError("two strand cuts in the header")
    return Header(sequence.replace("&", ""), objectives, graph, sequence.find("&") + 1, design)


def tokens(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(line, r"[ \t]+", " ")), " ")


def numbered(lines: DataFrame) -> DataFrame:
    """Lines of text with a dense number from 1 in file order (of the files of a folder: in the order of
    their names). Lines are written once; only the row count of each block reaches the driver."""
    at = F.monotonically_increasing_id()
    placed = cut(lines.select("value", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), at.alias("_at")))
    part = F.shiftright("_at", 33)
    blocks = placed.groupBy("_file", "_start", part.alias("_part")).agg(F.count("*").alias("n"), F.min("_at").alias("_first")).orderBy("_file", "_start").collect()
    before, total = [], 0
    for r in blocks:
        before.append((r["_file"], r["_start"], r["_first"], total))
        total += r["n"]
    offsets = lines.sparkSession.createDataFrame(before or [("", 0, 0, 0)], "_file string, _start long, _first long, _before long")
    return placed.join(F.broadcast(offsets), ["_file", "_start"]).select("value", (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("line"))


def read_landscape(spark: SparkSession, path: str, name: str = "1", objectives: int | None = None, header: Header | None = None) -> DataFrame:
    """states of a landscape file sorted by energy: structure, energy, then objectives, then a list of
    neighbours separated by colons. Reading ends at the first blank line."""
    head = header or read_header(spark, path)
    d = head.objectives if objectives is None else objectives
    rows = numbered(spark.read.text(path)).where(F.col("line") > (2 if head.design else 1))
    blank = rows.where(F.trim("value") == "").agg(F.min("line")).first()[0]
    if blank is not None:
        rows = rows.where(F.col("line") < blank)
    t = tokens(F.col("value"))
    short = F.when(F.size(t) < 2 + d, F.raise_error(F.concat(F.lit("missing values in line "), F.col("line").cast("string"))))
    out = rows.select(F.lit(name).alias(ID), (F.col("line") - (2 if head.design else 1)).alias("rank"), F.replace(t[0], F.lit("&"), F.lit("")).alias("structure"), F.coalesce(short.cast("double"), t[1].cast("double")).alias("energy"), *([F.transform(F.slice(t, 3, d), lambda x: x.cast("int")).alias("pov")] if d else []), F.get(t, F.lit(2 + d)).alias("listed"))
    return out


def read_bar(spark: SparkSession, path: str, name: str = "1") -> DataFrame:
    """Minima of a .bar file: landscape_id, lmin, structure, energy, father, barrier, e_saddle, bound."""
    t = tokens(F.col("value"))
    return spark.read.text(path).withColumn("t", t).where(F.size("t") >= 5).where(F.col("t")[0].rlike("^[0-9]+$")).select(F.lit(name).alias(ID), F.col("t")[0].cast("long").alias("lmin"), F.col("t")[1].alias("structure"), F.regexp_replace(F.col("t")[2], "[()]", "").cast("double").alias("energy"), F.col("t")[3].cast("long").alias("father"), F.col("t")[4].cast("double").alias("barrier"), F.col("t")[1].endswith("*").alias("bound")).withColumn("e_saddle", F.col("energy") + F.col("barrier"))


def read_saddles(spark: SparkSession, path: str, cut: int = 1000) -> DataFrame:
    """Saddle rows: energy, size, saddle structure and the numbers of the minima up to a cut."""
    t = tokens(F.col("value"))
    return spark.read.text(path).where(F.trim("value") != "").select(t[0].cast("double").alias("energy"), t[1].cast("long").alias("size"), t[2].alias("saddle"), F.filter(F.transform(F.slice(t, F.lit(4), F.size(t)), lambda x: x.cast("long")), lambda x: x <= cut).alias("minima"))


def read_phylo(spark: SparkSession, path: str) -> DataFrame:
    t = tokens(F.col("value"))
    return spark.read.text(path).where(F.size(t) >= 5).select(t[0].cast("long").alias("id"), t[2].cast("double").alias("energy"), t[3].cast("long").alias("father"), t[4].cast("double").alias("lifetime"))


def phylo_tree(rows: DataFrame, name: str = "1") -> DataFrame:
    """read_phylo() rows as a merge tree, for drawings: a negative father is none."""
    return rows.select(F.lit(name).alias(ID), F.col("id").alias("lmin"), "energy", F.greatest("father", F.lit(0)).cast("long").alias("father"), (F.col("energy") + F.col("lifetime")).alias("e_saddle"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """The first token of each line."""
    return spark.read.text(path).where(F.trim("value") != "").select(tokens(F.col("value"))[0].alias("structure"))


def read_binary_rates(spark: SparkSession, path: str) -> DataFrame:
    """A rate matrix file (int32 dimension, then column after column of float64): file, i, j, rate of its
    entries other than zero (NaN stays NaN). Columns are read as arrays, some at a time."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for t in batches:
            for name, content in zip(t.column("path").to_pylist(), t.column("content")):
                data = content.as_buffer()
                n = int(np.frombuffer(data, "<i4", 1)[0])
                step = max(1, (1 << 20) // max(n, 1))
                for j in range(0, n, step):
                    part = np.frombuffer(data, "<f8", min(step, n - j) * n, 4 + 8 * j * n).reshape(-1, n)
                    column, row = np.nonzero(part)
                    yield pa.RecordBatch.from_arrays([pa.repeat(name, len(row)), pa.array(row + 1), pa.array(column + j + 1), pa.array(part[column, row])], ["file", "i", "j", "rate"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, i long, j long, rate double")


def read_reorder_map(spark: SparkSession, path: str) -> DataFrame:
    """A map of old to new numbers as write_reorder_map() leaves it: lmin, bound, new_id."""
    return spark.read.schema("lmin long, bound boolean, new_id long").json(path)


def read_design_results(spark: SparkSession, path: str) -> DataFrame:
    """Scored sequences: sequence, energy, log_probability (null where the probability is 0), score and
    mutations, from data lines of five columns; other lines (parameters) are left out."""
    t = tokens(F.col("value"))
    rows = spark.read.text(path).withColumn("t", t).where(F.col("t")[0].rlike("^[ACGUT]+$")).where(F.size("t") >= 5)
    probability = F.col("t")[2].cast("double")
    return rows.select(F.col("t")[0].alias("sequence"), F.col("t")[1].cast("double").alias("energy"), F.when(probability > 0, F.log(probability)).alias("log_probability"), F.col("t")[3].cast("int").alias("score"), F.col("t")[4].cast("int").alias("mutations"))


def deviations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The population standard deviation of each column, in one row."""
    return rows.agg(*(F.stddev_pop(c).alias(c) for c in columns))


def prepared(rows: DataFrame, objectives: list[str], falling: list[str] = ()) -> DataFrame:
    """Rows as a landscape's input: by energy, then by each objective, the falling ones from the largest."""
    return rows.orderBy("energy", *(F.desc(c) if c in falling else F.asc(c) for c in objectives))


def spins(spark: SparkSession, n: int) -> DataFrame:
    """All 2 ** n strings of + and -, as a distributed range."""
    return spark.range(2**n).select(spin_string(F.col("id"), n).alias("structure"))


def random_strings(rows: DataFrame, alphabet: str, length: int, seed: int) -> DataFrame:
    """rows with a random string each (column structure), the same for the same seed and number (column id)."""
    letter = lambda i: F.element_at(F.array(*map(F.lit, alphabet)), (F.pmod(F.xxhash64(F.lit(seed), "id", i), F.lit(len(alphabet))) + 1).cast("int"))
    return rows.withColumn("structure", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), letter), ""))


def hopfield_landscape(states: DataFrame, patterns: list[list[str]], scale: float = 1.0) -> DataFrame:
    """structure, pov (an energy for each set of patterns) and energy (their scaled sum) of states."""
    each = [hopfield(F.col("structure"), p) for p in patterns]
    return states.withColumn("pov", F.array(*each)).withColumn("energy", F.aggregate("pov", F.lit(0), lambda s, x: s + x) * F.lit(scale))


def spin_string(i: Column, n: int) -> Column:
    return F.translate(F.lpad(F.bin(i), n, "0"), "01", "+-")


def overlap(s: Column, pattern: str) -> Column:
    """Sum over all places of the product of two spins."""
    n = len(pattern)
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0), lambda t, i: t + F.when(F.substring(s, i, F.lit(1)) == F.substring(F.lit(pattern), i, F.lit(1)), 1).otherwise(-1))


def hopfield(s: Column, patterns: list[str]) -> Column:
    """Energy of stored patterns: minus the sum of their squared overlaps."""
    return -sum((overlap(s, p) * overlap(s, p) for p in patterns[1:]), overlap(s, patterns[0]) * overlap(s, patterns[0]))
