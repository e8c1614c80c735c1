"""Landscapes from streams: cells counted as events arrive, and bands of sorted states closed one by
one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.window import Window

from basinflow.operators.graph import checkpoint_dir, cut
from basinflow.operators.landscape import ID


def cells(stream: DataFrame, watermark: str | None = None) -> DataFrame:
    """Weekday and hour cells per event type with their counts, of a stream or a table of events."""
    if watermark:
        stream = stream.withWatermark("ts", watermark)
    return stream.groupBy(F.col("event_type").alias(ID), (F.dayofweek("ts") - 1).alias("q"), F.hour("ts").alias("d")).agg(F.count("*").alias("n"))


def week_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of all events, taken in as a stream of files until none is left. The table of the
    last batch is complete; each batch replaces it in the shared folder."""
    import uuid

    path = f"{sf_dir}/events.parquet"
    folder = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern: the table may be one file
    keep = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/cells")
    query = cells(source).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/cells")


OUT = f"{ID} string, energy double, first_rank long, size long"


def closed_bands(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Bands of equal energy of one landscape's sorted states. A band is given out when a higher energy
    arrives, the last one when a row without an energy ends the landscape. An energy below the open band is
    an error, as the band was closed, and so is one after the end. State: the open band. What a trigger
    brings of a landscape (a file of bounded size) comes in several batches, which have no order."""
    energy, first, size = state.get if state.exists else (None, 0, 0)
    rows, out = pd.concat(list(batches)).sort_values("rank"), []
    for e, rank in rows[["energy", "rank"]].itertuples(index=False):
        if energy is not None and np.isinf(energy):
            raise ValueError(f"landscape {key[0]}: a state after its end")
        e = np.inf if pd.isna(e) else e
        if energy is not None and e < energy:
            raise ValueError(f"landscape {key[0]}: energy {e} after band {energy}")
        if e != energy:
            if energy is not None:
                out.append((key[0], energy, first, size))
            energy, first, size = e, int(rank), 0
        size += 1
    yield pd.DataFrame(out, columns=[ID, "energy", "first_rank", "size"])
    if energy is not None:
        state.update((float(energy), int(first), int(size)))


def band_stream(states: DataFrame) -> DataFrame:
    """Closed bands of a stream of states(landscape_id, rank, energy) whose batches come in order; a row
    without an energy, of the largest rank, ends a landscape."""
    return states.groupBy(ID).applyInPandasWithState(closed_bands, OUT, "energy double, first long, size long", "append", "NoTimeout")


def bands_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bands of the landscape of all orders, whose states arrive as a stream of files, in the order of
    their ranks, and are ended by a row without an energy."""
    import uuid

    from basinflow.plans.strings import order_states

    folder = f"{checkpoint_dir(spark).rstrip('/')}/bands-{uuid.uuid4().hex}"
    states = order_states(spark, sf_dir).select(ID, "rank", "energy")
    last = states.agg(F.max("rank")).first()[0] or 0
    parts = max(4, -(-last // 1_000_000))  # files of bounded size
    for k in range(parts):
        part = states.where((F.col("rank") > last * k // parts) & (F.col("rank") <= last * (k + 1) // parts))
        if k == parts - 1:
            part = part.unionByName(states.select(ID).distinct().select(ID, F.lit(last + 1).alias("rank"), F.lit(None).cast("double").alias("energy")))
        part.coalesce(1).write.mode("append").parquet(f"{folder}/states")
    spark.createDataFrame([], OUT).write.parquet(f"{folder}/bands")
    source = spark.readStream.schema(states.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/states")
    keep = lambda batch, number: batch.write.mode("append").parquet(f"{folder}/bands")
    query = band_stream(source).writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/bands")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = f"{ID} string, kind string, lmin long, rank long, structure string, energy double, father long"


class Flood(StatefulProcessor):
    """Minima and merges of one landscape, whose states(rank, structure, energy) arrive in ascending order of
    energy; a row without an energy ends it.

    State: the open band (a list), all states of closed bands with rank and minimum (a map by structure),
    the father of each merged minimum (a map: the union-find), and the number of minima with the energy of
    the open band. A band is worked off when a higher energy arrives: a state without a lower neighbour is
    a minimum, the others go down to their neighbour of least rank; connected states of the band then merge
    the minima they touch, in the order of their roots when the band began. Rows below the open band or
    after the end are too late and come out as such. What a trigger brings of a landscape is put in
    order first, however it is cut into batches."""

    def __init__(self, neighbours: Callable[[str], list[str]]):
        self.neighbours = neighbours

    def init(self, handle) -> None:
        self.open = handle.getListState("open", "rank long, structure string")
        self.known = handle.getMapState("known", "structure string", "rank long, lmin long")
        self.father = handle.getMapState("father", "lmin long", "father long")
        self.now = handle.getValueState("now", "energy double, minima long, ended boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        energy, minima, ended = self.now.get() if self.now.exists() else (None, 0, False)
        out: list[tuple] = []
        band = [tuple(r) for r in self.open.get()] if self.open.exists() else []
        for rank, structure, e in pd.concat(list(rows)).sort_values("rank")[["rank", "structure", "energy"]].itertuples(index=False):
            if ended or not pd.isna(e) and energy is not None and e < energy:
                out.append(("late", None, int(rank), structure, None if pd.isna(e) else e, None))
                continue
            if pd.isna(e) or e != energy:
                minima = self.close_band(band, energy, minima, out)
                band, energy, ended = [], None if pd.isna(e) else float(e), bool(pd.isna(e))
            if not ended:
                band.append((int(rank), structure))
        if band:
            self.open.put(band)
        else:
            self.open.clear()
        self.now.update((energy, minima, ended))
        yield pd.DataFrame([(key[0], *x) for x in out], columns=[x.split()[0] for x in EVENTS.split(", ")]).astype({"lmin": "Int64", "rank": "Int64", "father": "Int64", "energy": "float64"})

    def root(self, i: int) -> int:
        while self.father.containsKey((i,)):
            i = self.father.getValue((i,))[0]
        return i

    def close_band(self, band: list[tuple], energy: float, minima: int, out: list[tuple]) -> int:
        near = {s: self.neighbours(s) for _, s in band}
        inside, part, touched, found = {s: r for r, s in band}, {}, {}, {}
        for rank, s in band:
            lower = [tuple(self.known.getValue((x,))) for x in near[s] if x not in inside and self.known.containsKey((x,))]
            if lower:
                found[s] = min(lower)[1]
            else:
                minima += 1
                found[s] = minima
                out.append(("minimum", minima, rank, s, energy, None))
            touched[s] = {found[s], *(m for _, m in lower)}
        for _, s in band:  # parts of the band that hang together, by their first state
            todo = [s] if s not in part else []
            while todo:
                x = todo.pop()
                if x not in part:
                    part[x] = inside[s]
                    todo += [y for y in near[x] if y in inside]
        groups: dict[int, set] = {}
        for s, p in part.items():
            groups.setdefault(p, set()).update(touched[s])
        began = {i: self.root(i) for i in set().union(*groups.values())} if groups else {}
        for _, p in sorted((sorted({began[i] for i in ids}), p) for p, ids in groups.items()):
            first, *rest = sorted({self.root(i) for i in groups[p]})
            for i in rest:
                self.father.updateValue((i,), (first,))
                out.append(("merge", i, p, None, energy, first))
        for rank, s in band:
            self.known.updateValue((s,), (rank, found[s]))
        return minima

    def close(self) -> None:
        pass


def flooded(states: DataFrame, neighbours: Callable[[str], list[str]]) -> DataFrame:
    """Events of a stream of states(landscape_id, rank, structure, energy): minima (with rank, structure
    and energy), merges (with the minimum that ends, its father, the energy and the saddle's rank), and late
    rows. The session must keep its streams' state in RocksDB."""
    return states.groupBy(ID).transformWithStateInPandas(statefulProcessor=Flood(neighbours), outputStructType=EVENTS, outputMode="Append", timeMode="None")


def flood_files(spark: SparkSession, folder: str, neighbours: Callable[[str], list[str]]) -> DataFrame:
    """All events of the states in folder/states, one file after another, by a stream in a session of its own,
    whose settings stay there."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    source = own.readStream.schema(f"{ID} string, rank long, structure string, energy double").option("maxFilesPerTrigger", 1).parquet(f"{folder}/states")
    keep = lambda batch, number: batch.write.mode("append").parquet(f"{folder}/events")
    query = flooded(source, neighbours).writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(EVENTS).parquet(f"{folder}/events")


def grid_neighbours(structure: str) -> list[str]:
    q, d = map(int, structure.split(","))
    return [f"{q - 1},{d}", f"{q + 1},{d}", f"{q},{d - 1}", f"{q},{d + 1}"]


def minima_of_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minima and merges of the years' cells, whose states arrive as files in the order of their ranks."""
    import uuid

    from basinflow.plans.grids import order_cells

    folder = f"{checkpoint_dir(spark).rstrip('/')}/flood-{uuid.uuid4().hex}"
    states = cut(order_cells(spark, sf_dir).select(ID, "rank", "structure", "energy"))
    ends = states.groupBy(ID).agg((F.max("rank") + 1).alias("rank")).select(ID, "rank", F.lit(None).cast("string").alias("structure"), F.lit(None).cast("double").alias("energy"))
    files = max(4, -(-states.count() // 1_000_000))  # of bounded size
    dealt = states.unionByName(ends).withColumn("_last", F.max("rank").over(Window.partitionBy(ID))).withColumn("_file", F.floor((F.col("rank") - 1) * files / F.col("_last")))
    for k in range(files):
        dealt.where(F.col("_file") == k).drop("_last", "_file").coalesce(1).write.mode("append").parquet(f"{folder}/states")
    events = flood_files(spark, folder, grid_neighbours)
    merges = events.where("kind = 'merge'").select(ID, "lmin", "father", F.col("energy").alias("e_saddle"))
    return events.where("kind = 'minimum'").select(ID, "lmin", "rank", "structure", "energy").join(merges, [ID, "lmin"], "left").withColumn("father", F.coalesce("father", F.lit(0)))


QUERIES = {"stream_week_cells": week_counts, "stream_bands": bands_of_orders, "stream_minima": minima_of_cells}
SQL = {
    "stream_bands": "WITH st AS (SELECT e, row_number() OVER (ORDER BY e, x) AS n FROM (SELECT o_orderkey % 1048576 AS x, cast(min(-floor(o_totalprice / 1000)) AS bigint) AS e FROM orders GROUP BY ALL)) SELECT 'orders' AS landscape_id, cast(e AS double) AS energy, min(n) AS first_rank, count(*) AS size FROM st GROUP BY ALL",
    "stream_week_cells": "SELECT event_type AS landscape_id, dayofweek(ts) AS q, hour(ts) AS d, count(*) AS n FROM events GROUP BY ALL",
}
