"""What several operators of this folder share: tables, folders, batches, and numbers of rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinflow.operators.graph import checkpoint_dir, connected_components, cut, global_rank

__all__ = ["COPY", "ROW", "own_name", "connected_components", "cut", "global_rank", "new_folder", "numbered", "small_batches", "table", "with_rows"]



def own_name(name: str) -> str:
    """Name of a column that stands beside a caller's columns. Tables may have any other names."""
    return f"_basinflow_{name}"


#: Names of the columns that tell rows of one identifier apart, and all rows.
COPY, ROW = own_name("copy"), own_name("row")
#: Rows of one Arrow batch. Whole texts can be long, and each running task holds some batches outside the heap.
BATCH_ROWS = 400
#: Repeated identifiers that are broadcast (8 bytes each); more of them are joined by a shuffle.
FEW_IDS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what one Arrow batch of whole texts holds. Spark reads this setting when a plan runs, after the
    operator has returned, so it stays lowered for the session; it changes no result."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def new_folder(spark: SparkSession, prefix: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{prefix}-{uuid.uuid4().hex}"


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the column COPY: 0 where the identifier occurs once; rows whose identifier is null or
    occurs again get numbers from 1 that no two of them share, in the order of identifier and text.
    So (identifier, COPY) names a row, and only equal rows can change places from call to call.

    Usually no identifier repeats, and this costs a scan of that column. Otherwise only the rows of
    repeated identifiers are ranked and written."""
    if COPY in docs.columns:
        return docs
    key, repeated, at = F.col(id_col).cast("long"), own_name("again"), own_name("at")
    counts = docs.select(key.alias(repeated)).groupBy(repeated).agg(F.count("*").alias("n"))
    again = cut(counts.where(F.col(repeated).isNull() | (F.col("n") > 1)).select(repeated))
    n = again.count()
    if not n:
        return docs.withColumn(COPY, F.lit(0).cast("long"))
    again = F.broadcast(again) if n <= FEW_IDS else again
    same = key.eqNullSafe(F.col(repeated))
    told = docs.join(again, same, "left_semi").withColumn(at, F.monotonically_increasing_id())
    ranked = global_rank(told, [key, F.col(text_col), F.col(at)], COPY).withColumn(COPY, F.col(COPY) + 1).drop(at)
    return docs.join(again, same, "left_anti").withColumn(COPY, F.lit(0).cast("long")).unionByName(ranked)


def with_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the column ROW, a number of its own for every row: the identifier where it occurs once,
    larger numbers than any identifier for all others."""
    told = numbered(docs, id_col, text_col)
    key = F.col(id_col).cast("long")
    top = told.agg(F.max(key)).first()[0] or 0
    if top >= 1 << 62:
        return global_rank(told, [key, F.col(COPY)], ROW).drop(COPY)
    return told.withColumn(ROW, F.when(F.col(COPY) == 0, key).otherwise(F.col(COPY) + F.lit(max(top, 0)))).drop(COPY)
