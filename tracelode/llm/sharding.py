"""Weighted rendezvous hashing of record keys over shards, with gapless slots in each shard.

A record goes to the shard of the highest score -weight / ln(u), u in (0, 1) being drawn by
a hash of key and shard alone.  So one more shard takes records only into itself, and each
record moves with the probability of the new shard's share.

Defined cases: null text has size 8 and the checksum of no bytes; a null doc_id is a key
like any other; repeated rows share the shard and have slots of their own; an empty table
gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0-based int) of ``key``; ties go to the smaller shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, one for each shard")

    def cost(shard: int) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) * F.lit(2.0**-53)
        return -F.ln(u) / F.lit(float(weights[shard]))

    return F.array_min(F.array(*(F.struct(cost(j).alias("cost"), F.lit(j).alias("shard")) for j in range(len(weights)))))["shard"]


def shard(docs: DataFrame, weights: Sequence[float], grown: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (with one more shard of weight ``grown``)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    key = F.col("doc_id").cast("long")
    placed = docs.select(key.alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"))
    placed = placed.select("*", rendezvous(F.col("doc_id"), weights).alias("shard"), rendezvous(F.col("doc_id"), [*weights, grown]).alias("grown_shard"), F.spark_partition_id().alias("part"))
    # written, so that both uses below see the same parts whatever happens to executors
    placed = durable(placed, "shards")
    # a shard's slots are dealt part by part: no task holds more than one part of one shard
    sizes = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32"))
    return placed.withColumn("within", within).join(first, ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("within") - 1).cast("long").alias("slot"), "grown_shard")
