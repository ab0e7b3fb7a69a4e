"""Order-dependent joins: run boundaries, and calls with their results.

Results are reduced to one row for each key before they are joined, so a key with very many
results is an aggregation and not a product.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_numbers(events: DataFrame, keys: Sequence[str], order: Sequence[str], boundary: Column) -> DataFrame:
    """``events`` with run: how many boundaries there were up to and with each event of its stream."""
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("run", F.sum(boundary.cast("int")).over(so_far))


def last_known(events: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """``events`` with the last non-null ``value`` so far in its stream."""
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn(name, F.last(value, ignorenulls=True).over(so_far))


def scanned(events: DataFrame, keys: Sequence[str], split: str, order: Sequence[str], boundary: Column, last: dict[str, Column]) -> DataFrame:
    """``events`` with run, as ``run_numbers``, and the last non-null value so far of each of ``last``; a stream may be as long as it likes.

    A stream is cut at ``split``, a column that never falls along its order.  Splits are
    numbered on their own; what each adds to those after it (its boundaries, its last values)
    is one row, and only these rows are gone through in order.  ``events`` are read twice.
    """
    mine = [*keys, split]
    at = F.struct(*order)
    so_far = Window.partitionBy(*mine).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = events.withColumns({"run": F.sum(boundary.cast("int")).over(so_far), **{n: F.last(v, ignorenulls=True).over(so_far) for n, v in last.items()}})
    adds = events.groupBy(*mine).agg(F.sum(boundary.cast("int")).alias("_runs"), *(F.max_by(v, F.when(v.isNotNull(), at)).alias(f"_last_{n}") for n, v in last.items()))
    before = Window.partitionBy(*keys).orderBy(split).rowsBetween(Window.unboundedPreceding, -1)
    come = adds.select(*mine, F.coalesce(F.sum("_runs").over(before), F.lit(0)).alias("_runs"), *(F.last(f"_last_{n}", ignorenulls=True).over(before).alias(f"_last_{n}") for n in last))
    out = own.join(come, mine).withColumns({"run": F.col("run") + F.col("_runs"), **{n: F.coalesce(n, f"_last_{n}") for n in last}})
    return out.drop("_runs", *(f"_last_{n}" for n in last))


def first_result(calls: DataFrame, results: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """``calls`` with ``<value>_first``: the first result of the same key wins; calls without one keep null."""
    first = results.groupBy(*keys).agg(F.min_by(value, order).alias(f"{value}_first"))
    return calls.join(first, list(keys), "left")


def last_error(calls: DataFrame, errors: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """``calls`` with ``<value>_last``: the last error of the same key wins."""
    last = errors.groupBy(*keys).agg(F.max_by(value, order).alias(f"{value}_last"))
    return calls.join(last, list(keys), "left")


def by_name_in_order(calls: DataFrame, results: DataFrame, keys: Sequence[str], name: str, order: str, value: str) -> DataFrame:
    """``calls`` with ``<value>_paired``: without ids, the n-th result of a name belongs to the n-th call of it."""
    nth = F.row_number().over(Window.partitionBy(*keys, name).orderBy(order))
    r = results.withColumn("_n", nth).select(*keys, name, "_n", F.col(value).alias(f"{value}_paired"))
    return calls.withColumn("_n", nth).join(r, [*keys, name, "_n"], "left").drop("_n")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """equal, only_left, only_right: do two tables hold the same distinct rows?"""
    left, right = a.subtract(b), b.subtract(a)
    sides = left.agg(F.count("*").alias("only_left")).crossJoin(right.agg(F.count("*").alias("only_right")))
    return sides.select(((F.col("only_left") == 0) & (F.col("only_right") == 0)).alias("equal"), "only_left", "only_right")
