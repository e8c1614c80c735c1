"""K-d tree sharding by metadata.

The tree starts with all documents and the wanted number of leaves. A node with s leaves is split
on its widest metadata dimension at the weighted quantile that gives floor(s / 2) of s parts of
its bytes to the left, until every leaf has its target of bytes. Law `bytes`: leaf sizes are near
equal; they differ by about `tolerance` of a leaf, or by one document if that is larger.

Every dimension is mapped to [0, 1]: numbers by their range, strings by a hash. Rows are ordered on
a dimension by a 62-bit key: the coordinate and, for ties (a hot source, groups of copies), a hash
of the row, which differs even between equal rows. Weighted medians are found by radix refinement of
byte histograms: each round adds up bytes per node and digit on the map side, and only
(nodes x digits) sums reach the driver, whatever the number of rows. Rows are never shuffled for this,
and each level of the tree is written before the next one starts.

null text: size 8, checksum of the empty text. null metadata: coordinate 0. Repeated rows and null ids
each get a place of their own; a text may lie in several shards. An empty table gives no rows. Extra
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basinflow.llm.common import COPY, cut, numbered, own_name

#: Bits of a key digit, digits of a key, rows that one slot bucket aims at.
DIGIT, DIGITS, BUCKET = 12, 6, 4000


def metadata(docs: DataFrame, id_col: str, text_col: str, dimensions: list[str]) -> tuple[DataFrame, int]:
    """doc_id, copy, size, text_crc32 and keys (one per dimension) of every row, and the dimensions' number."""
    types = dict(docs.dtypes)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.octet_length(text).cast("long") + 8
    raw = [F.col(id_col).cast("long").alias("doc_id"), F.col(COPY).alias("copy"), size.alias("size"), F.crc32(text).alias("text_crc32"), F.log2(size.cast("double")).alias("_d0"), F.coalesce(F.col(id_col).cast("double"), F.lit(0.0)).alias("_d1")]
    names = ["_d0", "_d1"]
    for c in dimensions:
        if c in types:
            names.append(f"_d{len(names)}")
            value = F.col(c)
            unit = F.xxhash64(value).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") / F.lit(float(1 << 52))
            number = types[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") or types[c].startswith("decimal")
            raw.append(F.coalesce(F.nanvl(value.cast("double"), F.lit(None).cast("double")) if number else F.when(value.isNotNull(), unit), F.lit(0.0)).alias(names[-1]))
    rows = cut(docs.select(*raw))
    ends = rows.agg(*(f(n).alias(f"{k}{n}") for n in names for k, f in (("lo", F.min), ("hi", F.max)))).first()
    tie = F.xxhash64("doc_id", "copy", "text_crc32", "size").bitwiseAND(F.lit((1 << 32) - 1))
    keys = []
    for n in names:
        low, high = ends[f"lo{n}"], ends[f"hi{n}"]
        span = (high - low) if low is not None and high > low else 1.0
        unit = (F.col(n) - F.lit(low if low is not None else 0.0)) / F.lit(span)
        keys.append(F.shiftleft(F.floor(unit * F.lit(float((1 << 30) - 1))).cast("long"), 32).bitwiseOR(tie))
    return rows.select("doc_id", "copy", "size", "text_crc32", F.array(*keys).alias("keys")), len(names)


def of_node(values: dict[int, int], kind: str) -> Column:
    """The value that belongs to a row's node, null for other nodes: a literal table by node number."""
    listed = F.array(*(F.lit(values.get(n)).cast(kind) for n in range(max(values) + 1)))
    return F.get(listed, F.col("node"))


def split_points(rows: DataFrame, nodes: dict, tolerance: float) -> dict:
    """For each node (first leaf: leaves, dimension, bytes wanted on the left): the largest key
    that goes left. One aggregation per digit, for all nodes at once."""
    state = {n: [0, 0.0] for n in nodes}  # key prefix, bytes before it
    done: dict = {}
    for digit in range(DIGITS):
        shift = DIGIT * (DIGITS - 1 - digit)
        active = {n: state[n][0] for n in nodes if n not in done}
        if not active:
            break
        met = rows.withColumn("key", F.get(F.col("keys"), of_node({n: nodes[n]["dimension"] for n in active}, "int")))
        inside = met.where(F.shiftright("key", shift + DIGIT) == of_node(active, "long")) if digit else met.where("key is not null")
        sums = inside.groupBy("node", F.shiftright("key", shift).alias("digit")).agg(F.sum("size").alias("bytes"))
        found: dict = {}
        for r in sums.collect():
            found.setdefault(r["node"], []).append((r["digit"], r["bytes"]))
        for n, prefix in active.items():
            before, want = state[n][1], nodes[n]["left"]
            steps = sorted(found.get(n, [])) or [(prefix << DIGIT, 0)]
            for d, size in steps:
                if before + size >= want or d == steps[-1][0]:
                    break
                before += size
            if size <= tolerance or digit == DIGITS - 1:
                take = abs(before + size - want) <= abs(before - want)
                done[n] = ((d + take) << shift) - 1
            else:
                state[n] = [d, before]
    return done


def assign(docs: DataFrame, shards: int = 24, tolerance: float = 1e-4, id_col: str = "doc_id", text_col: str = "text", dimensions: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """doc_id, copy, size, text_crc32, shard and slot (gapless from 0 within the shard) of every row;
    copy tells rows of one identifier apart (see common.numbered)."""
    rows, count = metadata(numbered(docs, id_col, text_col), id_col, text_col, list(dimensions))
    rows = cut(rows.withColumn("node", F.lit(0)))
    nodes = {0: shards}
    while any(s > 1 for s in nodes.values()):
        coordinate = lambda i: F.shiftright(F.col("keys")[i], 32)
        stats = rows.groupBy("node").agg(F.sum("size").alias("bytes"), *((F.max(coordinate(i)) - F.min(coordinate(i))).alias(f"w{i}") for i in range(count)))
        by = {r["node"]: r for r in stats.collect()}
        plan = {}
        for n, s in nodes.items():
            if s > 1:
                widths = [by[n][f"w{i}"] for i in range(count)] if n in by else [0] * count
                plan[n] = {"dimension": max(range(count), key=lambda i: widths[i]), "left": (by[n]["bytes"] if n in by else 0) * (s // 2) / s}
        target = sum(r["bytes"] for r in by.values()) / shards
        points = split_points(rows, plan, tolerance * target)
        key = F.get(F.col("keys"), of_node({n: plan[n]["dimension"] for n in plan}, "int"))
        moved = F.when(key > of_node(points, "long"), of_node({n: n + nodes[n] // 2 for n in plan}, "int")).otherwise(F.col("node"))
        rows = cut(rows.withColumn("node", moved))
        nodes = {k: v for n, s in nodes.items() for k, v in (((n, s // 2), (n + s // 2, s - s // 2)) if s > 1 else ((n, s),))}
    placed = rows.select("doc_id", "copy", "size", "text_crc32", F.col("node").alias("shard"))
    # Slots: each shard's rows are dealt to buckets of bounded size; a bucket starts where the
    # buckets before it end.
    n = placed.count()
    buckets = max(1, -(-n // (shards * BUCKET)))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "copy", "text_crc32"), F.lit(buckets)).cast("int"))
    sizes = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = placed.withColumn("row", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "copy", "text_crc32", "size")) - 1)
    return within.join(starts, ["shard", "bucket"]).select("doc_id", "copy", "size", "text_crc32", "shard", (F.col("start") + F.col("row")).cast("long").alias("slot"))


def write(docs: DataFrame, assigned: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the documents, with all their columns, as one folder of Parquet files per shard. Every row
    is written once: null and repeated identifiers are met by their number of copy."""
    told = numbered(docs, id_col, text_col)
    if "_shard" in docs.columns:
        raise ValueError("folders are named by a column _shard, which the documents have already: rename it")
    one, number = own_name("id"), own_name("number")
    placed = assigned.select(F.col("doc_id").alias(one), F.col("copy").alias(number), F.col("shard").alias("_shard"))
    met = told.join(placed, told[id_col].cast("long").eqNullSafe(placed[one]) & (told[COPY] == placed[number]))
    met.drop(one, number, COPY).write.partitionBy("_shard").parquet(folder)
