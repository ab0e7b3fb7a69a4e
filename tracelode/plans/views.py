"""Views of the driver tables as runs of steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _step(tool, args, error):
    return F.struct(tool.alias("tool"), args.alias("args"), F.when(error, F.lit("error")).alias("error"))


def _sorted_steps(*order: str):
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, "step"))), lambda x: x["step"])


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events of one day, in time order; one aggregation."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", F.to_date("ts").alias("day"), "event_type", "value", _step(F.col("event_type"), F.col("props"), F.col("event_type") == "error").alias("step"))
    runs = e.groupBy("user_id", "day").agg(_sorted_steps("ts", "event_id").alias("steps"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last"), F.min("event_id").alias("ordinal"), F.sum("value").alias("cost"))
    outcome = F.when(F.col("last") == "purchase", "stop").when(F.col("last") == "error", "error").otherwise("toolUse")
    return runs.select("ordinal", F.concat(F.lit("agent-"), (F.col("user_id") % 5).cast("string")).alias("agent"), F.dayofmonth("day").cast("string").alias("task"), outcome.alias("outcome"), "cost", "steps", "user_id", "day")


def order_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines; the agent is the customer's region.  Line numbers are not unique, so ties are broken in full."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    place = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    args = F.concat_ws("|", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_quantity").cast("long").cast("string"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", _step(F.col("l_returnflag"), args, F.col("l_linestatus") == "O").alias("step"))
    runs = lines.groupBy("l_orderkey").agg(_sorted_steps("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").alias("steps"))
    who = c.join(place, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
    outcome = F.when(F.col("o_orderstatus") == "F", "stop").when(F.col("o_orderstatus") == "O", "toolUse").otherwise("length")
    return o.join(runs, F.col("o_orderkey") == F.col("l_orderkey")).join(who, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("ordinal"), F.col("r_name").alias("agent"), F.col("o_orderpriority").alias("task"), outcome.alias("outcome"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), "steps")


def document_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as runs without steps; labels where there are any, else not evaluated (never failure)."""
    d, q = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    label = F.when(F.col("quality") == 1, "success").when(F.col("quality") == 0, "failure")
    return d.join(q, "doc_id", "left").select(F.col("doc_id").alias("ordinal"), F.col("source").alias("agent"), F.col("lang").alias("task"), F.col("n_chars").cast("double").alias("cost"), label.alias("verified_outcome"), "quality", "toxic", "n_chars")


def conversation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", _step(F.col("role"), F.lit(None).cast("string"), F.lit(False)).alias("step"), "role")
    runs = c.groupBy("conv_id").agg(_sorted_steps("turn", "text").alias("steps"), F.max_by("role", F.struct("turn", "text")).alias("last"))
    return runs.select(F.col("conv_id").alias("ordinal"), F.concat(F.lit("agent-"), (F.col("conv_id") % 3).cast("string")).alias("agent"), F.when(F.col("last") == "assistant", "stop").otherwise("open").alias("outcome"), "steps")


def square_map(spark: SparkSession, n: int) -> DataFrame:
    """x, t = (x x + 1) mod n."""
    return spark.range(n).select(F.col("id").alias("x"), ((F.col("id") * F.col("id") + 1) % n).alias("t"))
