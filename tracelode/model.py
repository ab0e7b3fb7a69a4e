"""The data model: runs of steps, their labels, and the constraints on a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEP = T.StructType([T.StructField("tool", T.StringType()), T.StructField("args", T.StringType()), T.StructField("error", T.StringType())])
EVALUATOR = T.StructType([T.StructField("id", T.StringType()), T.StructField("version", T.StringType()), T.StructField("method", T.StringType())])
#: One row for each run.  ``args`` of a step is JSON text; an absent label, cost or token count is null.
RUN = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("ordinal", T.LongType()),
        T.StructField("session", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("project", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("verified_outcome", T.StringType()),
        T.StructField("evaluator", EVALUATOR),
        T.StructField("cost", T.DoubleType()),
        T.StructField("tokens_input", T.LongType()),
        T.StructField("tokens_output", T.LongType()),
        T.StructField("steps", T.ArrayType(STEP)),
    ]
)
# The labels a verifier may give.
VERIFIED = ("success", "failure", "unknown")


def known(value: Column) -> Column:
    """Empty and null names read as "unknown"."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit("unknown"))


def evaluator_text(evaluator: Column) -> Column:
    """``id@version [method]``, leaving out what is empty."""
    part = lambda name, before, after: F.when(F.coalesce(evaluator[name], F.lit("")) != "", F.concat(F.lit(before), evaluator[name], F.lit(after))).otherwise(F.lit(""))
    return F.when(evaluator.isNotNull(), F.concat(F.coalesce(evaluator["id"], F.lit("")), part("version", "@", ""), part("method", " [", "]")))


def checked(runs: DataFrame) -> DataFrame:
    """``runs`` whose rows fail the query if a label is not allowed or has no evaluator."""
    label = F.col("verified_outcome")
    wrong = label.isNotNull() & ~label.isin(*VERIFIED)
    bare = label.isNotNull() & F.col("evaluator").isNull()
    said = F.when(wrong, F.raise_error(F.concat(F.lit("verified_outcome is not allowed: "), label)).cast("string")).when(bare, F.raise_error(F.lit("a label needs its evaluator")).cast("string")).otherwise(label)
    return runs.withColumn("verified_outcome", said)


def steps_long(runs: DataFrame, *keys: str) -> DataFrame:
    """One row for each step: keys, pos (from 0), tool, family, args, error."""
    from .functions.steps import family

    return runs.select(*keys, F.posexplode("steps").alias("pos", "s")).select(*keys, "pos", F.col("s.tool").alias("tool"), family(F.col("s.tool")).alias("family"), F.col("s.args").alias("args"), F.col("s.error").alias("error"))
