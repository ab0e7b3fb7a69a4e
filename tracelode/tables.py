"""Intermediate tables under the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  Where it is unset a local session uses its warehouse; a cluster must name a folder."""
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not given and sc._jsc.sc().getCheckpointDir().isDefined():
        given = sc._jsc.sc().getCheckpointDir().get()
    if not given:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return given.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder there, which goes when the driver ends."""
    path = f"{shared_dir(spark)}/tracelode/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def held(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet and read back: what was computed once is read by all that follows, whatever executors are lost.

    The files go when the driver ends, or with ``discard``.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.held_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``held`` wrote and nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df.held_path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _drop_written() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001, S112 - the session may already be gone; the folder is scratch
            continue
