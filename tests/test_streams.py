"""What a stream tells its state."""

from pyspark.sql import functions as F

from tracelode.streaming import ledgers


def test_state_is_told_classes_and_not_runs(spark):
    """Many equal runs tell a part of a group no more than a few do."""
    rows = spark.range(0, 4000, 1, 2).select(F.lit("a").alias("agent"), (F.col("id") % 2).cast("int").alias("shard"), F.when(F.col("id") % 4 > 0, F.encode((F.col("id") % 4).cast("string"), "utf-8")).alias("id"), F.lit(1).alias("level"), (F.col("id") % 100).cast("int").alias("longest"))
    got = ledgers._combined(rows, "agent", "string")
    assert got.count() <= 8
    key = ["agent", "shard", "id", "level"]
    longest = lambda d: sorted(map(str, d.groupBy(*key).agg(F.max("longest")).collect()))
    assert longest(got) == longest(rows)
