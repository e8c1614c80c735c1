"""Iterative graph operators over DataFrames: components and pointer chasing."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the cluster's spark.checkpoint.dir. Where none
    is set: a local folder if all tasks run on this machine, otherwise an error."""
    context = spark.sparkContext
    where = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not where:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        where = "file://" + tempfile.mkdtemp(prefix="basinflow-")
        context.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder: ends the lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by keys to as many tasks as shuffles have: a table of few bytes is read by one or two
    tasks, however much work its rows make. As the number is given, small partitions are not gathered again."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def global_rank(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with a gapless rank from 0 in the given order, without one task seeing all rows.

    Range partitions are sorted and written once; only the row count of each partition meets in a
    table of one row per partition, which is joined back. Rows that are equal in the order share a
    partition, so an order without ties spreads best.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = sorted((r["_part"], r["n"]) for r in placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(starts or [(0, 0)], "_part long, _start long")
    return (
        placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_start", "_at")
    )


def rank_within(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """df with a dense rank from 1 within each value of the keys: the global rank less the first one
    of its keys, so that a large group is ranked by many tasks."""
    placed = global_rank(df, [*keys, *order], "_rank")
    first = placed.groupBy(*keys).agg(F.min("_rank").alias("_first"))
    return placed.join(first, keys).withColumn(name, F.col("_rank") - F.col("_first") + 1).drop("_rank", "_first")


def connected_components(edges: DataFrame, keys: list[str] | None = None, most_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node of edges(*keys, src, dst): *keys, node, component.

    Large-star and small-star steps: per step one pre-aggregated minimum and one equi-join. Loops
    are ignored; nodes without another edge do not appear.
    """
    keys = keys or []

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs
        low = both.groupBy(*keys, "a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        met = both.join(low, [*keys, "a"])
        if large:
            out = met.where("b > a").select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = met.select(*keys, F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(*keys, "a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def mark(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)"))).first())

    now = cut(edges.where("src <> dst").select(*keys, F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    before = mark(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        now = cut(star(star(now, True), False))
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(*keys, F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(*keys, F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def chase(pointers: DataFrame, keys: list[str], most_rounds: int = 60) -> DataFrame:
    """End of every pointer chain in pointers(*keys, node, parent), where an end has parent null:
    *keys, node, top. Pointer doubling: the number of joins is the logarithm of the longest chain."""
    now = cut(pointers.select(*keys, "node", F.coalesce("parent", "node").alias("top"), F.col("parent").isNull().alias("done")))
    for _ in range(most_rounds):
        if now.where(~F.col("done")).isEmpty():
            return now.drop("done")
        step = now.select(*keys, F.col("node").alias("top"), F.col("top").alias("_next"), F.col("done").alias("_done"))
        now = cut(now.where(~F.col("done")).join(step, [*keys, "top"]).select(*keys, "node", F.col("_next").alias("top"), F.col("_done").alias("done")).unionByName(now.where("done")))
    raise RuntimeError("pointers form a cycle")
