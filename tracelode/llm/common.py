"""What the operators of this subpackage share: batches of bounded bytes, durable intermediate tables."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Text bytes that a Python worker handles at once; a longer single text is a batch of its own.
CHUNK_BYTES = 2 << 20
#: Bytes that go to a Python worker at once where memory is short.
BATCH_BYTES = 1 << 20

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; set here only where it is unset."""
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not given:
        given = sc._jsc.sc().getCheckpointDir().getOrElse(None) if sc._jsc.sc().getCheckpointDir().isDefined() else None
    if not given:
        given = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(given)
    return given.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/tracelode/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def durable(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet under the shared folder and read back.

    This cuts lineage so that the loss of an executor repeats one step and not the
    whole job; the files survive any executor and go when the driver ends.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``durable`` wrote and nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df.scratch_path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of steps whose results are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@atexit.register
def _drop_written() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001, S112 - the session may already be gone; the folder is scratch
            continue


@contextmanager
def bounded_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> Iterator[None]:
    """What is run within sends rows to Python workers in batches of about ``limit`` bytes (Spark: 10,000 rows or 64 MB).

    A batch lies in the executor's direct memory and in the worker's, besides what the worker makes of it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(limit))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def byte_chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose ``column`` holds at most ``limit`` bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array([0 if n is None else n for n in pc.binary_length(batch.column(column)).to_pylist()], dtype=np.int64)
        ends, begin = np.cumsum(sizes), 0
        while begin < batch.num_rows:
            base = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def make_room(cache: dict, needed: Iterable, more: int, limit: int) -> None:
    """If ``cache`` would have over ``limit`` entries with ``more``, only those that are ``needed`` now stay: what recurs most is among them."""
    if len(cache) + more > limit:
        kept = {x: cache[x] for x in needed if x in cache}
        cache.clear()
        cache.update(kept)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def partitions_for(spark: SparkSession, rows: int, per_task: int, least: int = 1) -> int:
    """Tasks so that each has about ``per_task`` rows, without an upper bound."""
    return max(least, -(-rows // per_task))


def ranked(df: DataFrame, order: list[str], label: str, tasks: int, by: str | None = None) -> DataFrame:
    """``df`` with ``pos`` (long, gapless from 0 in the order given, within each ``by``) and ``n`` (rows of that group).

    Rows are dealt by ranges of their order, sorted in their tasks and written, so that a
    place is a part's first place plus a place in the part and no group is ever one task.
    Rows that are equal in the whole order are told apart by where they were read, which
    lets a range end between them.  ``df`` should be cheap to read twice, and ``by`` not null.
    """
    keys = [*([by] if by else []), *order]
    placed = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(tasks, *keys, "_row").sortWithinPartitions(*keys, "_row").drop("_row")
    placed = durable(placed.withColumn("_at", F.monotonically_increasing_id()), label).withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy(*([by] if by else []), "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_size"))
    if by:
        mine = Window.partitionBy(by)
        before = mine.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.select(by, "_part", (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_size").over(mine).alias("n"))
    else:
        # one row for each task that wrote, so the driver may hold them
        rows, done = [], 0
        for r in sorted(parts.collect(), key=lambda r: r["_part"]):
            rows.append((r["_part"], done - r["_first"]))
            done += r["_size"]
        parts = F.broadcast(df.sparkSession.createDataFrame([(p, s, done) for p, s in rows], "_part long, _shift long, n long"))
    return placed.join(parts, [*([by] if by else []), "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")
