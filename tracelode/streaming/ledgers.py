"""Ledgers of a stream of runs, and streams of events cut into runs.

First sight of a class is kept: each (group, level, class, live?) enters a table once, and
counts are merged batch by batch.  LIVE is only ever set, never taken back, so the explicit
rule needs no more.  The horizon rule is not monotone (a longer trace demotes what did not
reach so far): its changes are told as they come.  Both keep what they must know of earlier
batches in the state store, by parts of a group, and read no table they wrote.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import ledger
from ..operators.tower import Tower


#: Parts of a group's classes, so that a hot group is several tasks.
SHARDS = 16


def class_marks(runs: DataFrame, tower: Tower, ok: Column, group: str) -> DataFrame:
    """group, level, key (16 bytes), live: one row for each run and level; works on streams and tables alike."""
    ids = [f"c{j}" for j in range(1, tower.depth + 1)]
    parts = tower.identified(runs.withColumn("_ok", ok), group, "_ok")
    half = lambda c: F.lpad(F.hex(c), 16, "0")
    levels = F.array(*(F.struct(F.lit(j).alias("level"), F.unhex(F.concat(half(f"{c}.a"), half(f"{c}.b"))).alias("key")) for j, c in enumerate(ids, 1)))
    return parts.select(group, F.col("_ok").alias("live"), F.explode(levels).alias("x")).select(group, "x.level", "x.key", "live")


def first_sights(marks: DataFrame, group: str) -> DataFrame:
    """Each class once, and once more when it is first seen live (stateful de-duplication in a stream)."""
    return marks.dropDuplicates([group, "level", "key", "live"])


def merge_sights(old: DataFrame | None, batch: DataFrame, group: str) -> DataFrame:
    """group, level, key, live after a batch of sights."""
    both = batch if old is None else old.unionByName(batch)
    return both.groupBy(group, "level", "key").agg(F.max("live").alias("live"))


def counts(sights: DataFrame, group: str) -> DataFrame:
    return ledger.counts(merge_sights(None, sights, group), group)


def run_stream(runs: DataFrame, tower: Tower, ok: Column, group: str, table_dir: str, checkpoint: str):
    """Starts a query that appends a stream's first sights to the table under ``table_dir``; ``stream_book`` over it is the ledger.

    What was seen is in the state store, which is asked for the batch's own classes alone: no
    batch reads the table, so a batch costs what is in it however long the stream has run.
    A batch that is run again writes its own folder anew.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table_dir}/batch={number}")

    use_rocksdb(runs.sparkSession)
    fresh = first_sights(class_marks(runs, tower, ok, group), group)
    return fresh.writeStream.foreachBatch(put).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_book(spark, table_dir: str, group: str) -> DataFrame:
    return counts(spark.read.option("basePath", table_dir).parquet(table_dir).select(group, "level", "key", "live"), group)


def prefix_reach(runs: DataFrame, labels: Column, group: str) -> DataFrame:
    """group, level, id, longest of a batch: mergeable state of the horizon rule."""
    return ledger.prefixes(runs, labels, F.lit(False), group).select(group, "level", "id", "longest")


def merge_reach(old: DataFrame | None, batch: DataFrame, group: str) -> DataFrame:
    both = batch if old is None else old.unionByName(batch)
    return both.groupBy(group, "level", "id").agg(F.max("longest").alias("longest"))


def horizon_statuses(reach: DataFrame, group: str, closed: Column | None = None) -> DataFrame:
    """group, level, id, status at the horizon seen so far; UNKNOWN until ``closed`` for what falls short."""
    top = reach.groupBy(group).agg(F.max("level").alias("_h"))
    short = F.lit("TRANSIENT") if closed is None else F.when(closed, "TRANSIENT").otherwise("UNKNOWN")
    return reach.join(top, group).select(group, "level", "id", F.when(F.col("longest") >= F.col("_h"), "LIVE").otherwise(short).alias("status"))


class _Horizon(StatefulProcessor):
    """State of a part of a group: how deep the group has got, and for each class the longest run through it.

    The classes are a map in the state store, so what is held is what the store holds on
    disk; a class that no run has met for ``ttl_ms`` goes.
    """

    def __init__(self, group: str, ttl_ms: int | None):
        self.group, self.ttl_ms = group, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.deepest = handle.getValueState("deepest", "h int")
        self.classes = handle.getMapState("classes", "id binary", "level int, longest int", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803 - names of the interface
        before = self.deepest.get()[0] if self.deepest.exists() else 0
        horizon, met = before, {}
        for frame in rows:
            for ident, level, longest in zip(frame["id"], frame["level"], frame["longest"], strict=True):
                horizon = max(horizon, longest)
                if ident is not None:
                    was = met.get(bytes(ident), (0, 0))
                    met[bytes(ident)] = (level, max(was[1], longest))
        out = []
        if horizon > before and before:
            # what reached so far and does not reach now is demoted
            for (ident,), (level, longest) in self.classes.iterator():
                if longest == before and bytes(ident) not in met:
                    out.append((bytes(ident), level, "TRANSIENT"))
        for ident, (level, longest) in met.items():
            kept = self.classes.getValue((ident,))
            old = kept[1] if kept else None
            now = max(longest, old or 0)
            if old is None or now != old or self.ttl_ms:
                self.classes.updateValue((ident,), (level, now))
            status = "LIVE" if now >= horizon else "TRANSIENT"
            if old is None or status != ("LIVE" if old >= before else "TRANSIENT"):
                out.append((ident, level, status))
        if horizon != before:
            self.deepest.update((horizon,))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=[self.group, "id", "level", "status"])

    def close(self) -> None:
        pass


def _combined(rows: DataFrame, group: str, kind: str) -> DataFrame:
    """The same rows with one, the longest, of each Arrow batch for each class: what the state is told does not grow with the runs alone."""
    names = [group, "shard", "id", "level"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch]).group_by(names).aggregate([("longest", "max")]).rename_columns([*names, "longest"])
                yield from table.combine_chunks().to_batches()

    return rows.select(*names, "longest").mapInArrow(work, f"{group} {kind}, shard int, id binary, level int, longest int")


def horizon_changes(runs: DataFrame, labels: Column, group: str, shards: int = SHARDS, ttl_ms: int | None = None) -> DataFrame:
    """group, id, level, status of a stream of runs: a class when it is first seen, and again whenever the horizon rule changes its mind.

    A longer run demotes what did not reach as far; a class that reaches again is LIVE
    again.  Every run tells its length to all parts of its group, its classes to their own.
    The session must use the RocksDB state store (``use_rocksdb``).
    """
    rows = runs.select(F.col(group), labels.alias("_labels")).withColumn("longest", F.size("_labels"))
    nodes = ledger.chained(rows.filter(F.col("longest") > 0), "_labels")
    own = nodes.select(group, F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", "level", "longest")
    told = rows.filter(F.col("longest") > 0).select(group, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(None).cast("binary").alias("id"), F.lit(0).alias("level"), "longest")
    kind = runs.schema[group].dataType.simpleString()
    return _combined(own.unionByName(told), group, kind).groupBy(group, "shard").transformWithStateInPandas(_Horizon(group, ttl_ms), f"{group} {kind}, id binary, level int, status string", "Update", "ProcessingTime" if ttl_ms else "None")


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_horizon(runs: DataFrame, labels: Column, group: str, table_dir: str, checkpoint: str, shards: int = SHARDS, ttl_ms: int | None = None):
    """Starts a query that appends a stream's changes to the table under ``table_dir``, each with its batch."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table_dir}/batch={number}")

    use_rocksdb(runs.sparkSession)
    return horizon_changes(runs, labels, group, shards, ttl_ms).writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_statuses(spark, table_dir: str, group: str) -> DataFrame:
    """group, id, level, status as the last batch left them."""
    changes = spark.read.option("basePath", table_dir).parquet(table_dir)
    return changes.groupBy(group, "id", "level").agg(F.max_by("status", "batch").alias("status"))


def session_runs(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """user_id, started, steps, last: events (ts, user_id, event_type, event_id) cut into runs by silence.

    With a watermark this is a streaming aggregation whose state is the open sessions only.
    """
    e = events.withWatermark("ts", late) if events.isStreaming else events
    order = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    s = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(order.alias("x"))
    return s.select("user_id", F.col("w.start").alias("started"), F.transform("x", lambda v: v["event_type"]).alias("steps"), F.element_at("x", -1)["event_type"].alias("last"))
