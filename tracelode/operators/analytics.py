"""Analytics over a ledger (group, level, n, l): exponents, tails, inflation, onset, comparison.

A ledger has a row for each group and level, so windows and joins here are small whatever
the corpus; everything before the final rounding is in integers or plain doubles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tower import LN2

TAIL = 4
#: Relative tolerance of trends and of "same D".
TOLERANCE = 1e-9


def ratios(book: DataFrame, group: str = "agent", eps: Callable[[Column], Column] | None = None) -> DataFrame:
    """group, level, s, d: ln n / -ln eps(level) and the same of l, null where the count is 0; eps is 2^-level unless given."""
    scale = F.col("level") * F.lit(LN2) if eps is None else -F.ln(eps(F.col("level")))
    ratio = lambda c: F.when(F.col(c) > 0, F.ln(F.col(c)) / scale)
    return book.filter("level > 0").select(group, "level", ratio("n").alias("s"), ratio("l").alias("d"))


def exponents(book: DataFrame, group: str = "agent", eps: Callable[[Column], Column] | None = None) -> DataFrame:
    """group, s, s_at, d, d_at, delta, horizon, s_shallow, d_shallow.

    The largest ratio and the first level that attains it; 0 at level 0 if no ratio is positive.
    """
    r = ratios(book, group, eps)

    def best(c: str) -> list[Column]:
        top = F.max(F.when(F.col(c) > 0, F.struct(F.col(c).alias("v"), (-F.col("level")).alias("m"))))
        return [F.coalesce(top["v"], F.lit(0.0)).alias(c), F.coalesce(-top["m"], F.lit(0)).cast("int").alias(f"{c}_at")]

    out = r.groupBy(group).agg(*best("s"), *best("d"), F.max("level").cast("int").alias("horizon"))
    shallow = lambda c: (F.col(f"{c}_at") > 0) & (F.col(f"{c}_at") < F.col("horizon"))
    return out.select(group, "s", "s_at", "d", "d_at", (F.col("s") - F.col("d")).alias("delta"), "horizon", shallow("s").alias("s_shallow"), shallow("d").alias("d_shallow"))


def on_levels(book: DataFrame, levels: list[int], group: str = "agent") -> DataFrame:
    """Exponents over a subset of levels."""
    return exponents(book.filter(F.col("level").isin(levels)), group)


def stop_levels(book: DataFrame, tenths: int = 1, group: str = "agent") -> DataFrame:
    """group, stop_level: the first level whose yield is under tenths/10 (compared in integers), else null."""
    return book.filter("level > 0").groupBy(group).agg(F.min(F.when(10 * F.col("l") < tenths * F.col("n"), F.col("level"))).cast("int").alias("stop_level"))


def trend(values: Column) -> Column:
    """NONE, UNRESOLVED, STABLE, TRENDING_UP or TRENDING_DOWN of an array of doubles."""
    size = F.size(values)
    tolerance = TOLERANCE * F.greatest(F.lit(1.0), F.array_max(F.transform(values, lambda v: F.abs(v))))
    steps = F.zip_with(F.slice(values, F.lit(2), F.greatest(size - 1, F.lit(0))), F.slice(values, F.lit(1), F.greatest(size - 1, F.lit(0))), lambda b, a: b - a)
    return (
        F.when(size <= 0, "NONE")
        .when(size == 1, "UNRESOLVED")
        .when(F.forall(steps, lambda d: F.abs(d) <= tolerance), "STABLE")
        .when(F.forall(steps, lambda d: d >= -tolerance), "TRENDING_UP")
        .when(F.forall(steps, lambda d: d <= tolerance), "TRENDING_DOWN")
        .otherwise("UNRESOLVED")
    )


# What a tail says about the values not seen.
BOUNDS = {"STABLE": "window-exact (tail flat so far)", "TRENDING_UP": "lower bound IF the tail stays monotone", "TRENDING_DOWN": "upper bound IF the tail stays monotone"}
NO_BOUND = "no bound claimed"


def bound_label(status: Column) -> Column:
    return F.coalesce(*(F.when(status == name, F.lit(text)) for name, text in BOUNDS.items()), F.lit(NO_BOUND))


def falsified(observed: DataFrame, continued: DataFrame, k: int = TAIL) -> DataFrame:
    """case, status, value, limsup, violated: is what a tail reports another number once the sequence goes on?

    ``observed`` and ``continued``: case, level, v; the continuation has later levels.  No
    finite beginning settles a limit, so any reported value has a continuation that breaks it.
    """
    last = F.array_sort(F.collect_list(F.struct("level", "v")))
    tail = F.transform(F.slice("seen", -F.least(F.lit(k), F.size("seen")), F.lit(k)), lambda x: x["v"])
    said = observed.groupBy("case").agg(last.alias("seen")).select("case", trend(tail).alias("status"), F.array_max(tail).alias("value"))
    truth = limsup(observed.unionByName(continued), "case", "level", "v")
    return said.join(truth, "case").select("case", "status", "value", "limsup", (F.abs(F.col("limsup") - F.col("value")) > TOLERANCE).alias("violated"))


def gate(book: DataFrame, reference: str, order: DataFrame, earliest: int, tolerance: float, factor: int = 2, group: str = "agent") -> DataFrame:
    """group, onset, inflation (at the first behavioural level), blocked: is an agent's onset before ``earliest``, or its inflation over ``tolerance``?"""
    each = inflation(book, reference, group).join(order, group).filter(F.col(group) != reference)
    out = each.groupBy(group).agg(F.min(F.when((F.col("base") > 0) & (F.col("n") >= factor * F.col("base")), F.col("level"))).cast("int").alias("onset"), F.max(F.when(F.col("level") == 2, F.col("inflation"))).alias("inflation"))
    return out.withColumn("blocked", F.coalesce(F.col("onset") < earliest, F.lit(False)) | F.coalesce(F.col("inflation") > tolerance, F.lit(False)))


def tails(book: DataFrame, k: int = TAIL, group: str = "agent") -> DataFrame:
    """group, kind (s or d), tail, value (its largest), window_sup, tail_from, status, label: over levels with a count."""
    long = ratios(book, group).select(group, "level", F.explode(F.array(F.struct(F.lit("s").alias("kind"), F.col("s").alias("v")), F.struct(F.lit("d").alias("kind"), F.col("d").alias("v")))).alias("x")).select(group, "level", "x.kind", "x.v")
    seen = F.array_sort(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("level", "v"))))
    out = long.groupBy(group, "kind").agg(seen.alias("seen"))
    last = F.slice("seen", -F.least(F.lit(k), F.size("seen")), F.lit(k))
    out = out.withColumn("last", F.when(F.size("seen") > 0, last).otherwise(F.col("seen")))
    tail = F.transform("last", lambda x: x["v"])
    value = F.array_max(tail)
    status = trend(tail)
    label = bound_label(status)
    return out.select(group, "kind", tail.alias("tail"), value.alias("value"), F.array_max(F.transform("seen", lambda x: x["v"])).alias("window_sup"), F.get("last", F.lit(0))["level"].cast("int").alias("tail_from"), status.alias("status"), label.alias("label"))


def envelopes(book: DataFrame, group: str = "agent") -> DataFrame:
    """group, level, s, s_envelope, d, d_envelope: the largest ratio from a level on."""
    after = Window.partitionBy(group).orderBy("level").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return ratios(book, group).select(group, "level", "s", F.max("s").over(after).alias("s_envelope"), "d", F.max("d").over(after).alias("d_envelope"))


def inflation(book: DataFrame, reference: str, group: str = "agent") -> DataFrame:
    """group, level, n, base, inflation: classes against the reference's at the same level; null where it has none."""
    base = book.filter(F.col(group) == reference).select("level", F.col("n").alias("base"))
    return book.join(base, "level", "left").select(group, "level", "n", "base", F.when(F.col("base") > 0, F.col("n") / F.col("base")).alias("inflation"))


def onset(book: DataFrame, reference: str, order: DataFrame, factor: int = 2, group: str = "agent") -> DataFrame:
    """onset_level, onset_agent, behavioural_level, behavioural_agent: the first level where some agent has ``factor`` times the reference's classes.

    ``order`` (group, ordinal) settles which agent is named; the behavioural onset starts at level 2.
    """
    hit = inflation(book, reference, group).join(order, group).filter((F.col(group) != reference) & (F.col("base") > 0) & (F.col("n") >= factor * F.col("base")))
    key = F.struct("level", "ordinal", group)
    first, later = F.min(key), F.min(F.when(F.col("level") >= 2, key))
    return hit.agg(first["level"].cast("int").alias("onset_level"), first[group].alias("onset_agent"), later["level"].cast("int").alias("behavioural_level"), later[group].alias("behavioural_agent"))


def reference_of(book: DataFrame, order: DataFrame, group: str = "agent") -> DataFrame:
    """The group of the smallest S, ties by ordinal."""
    return exponents(book, group).join(order, group).agg(F.min_by(group, F.struct("s", "ordinal")).alias(group))


def compare(book: DataFrame, group: str = "agent") -> DataFrame:
    """group, s, d, delta, waste (delta / S), stop_level, same_d (all groups have one D)."""
    e = exponents(book, group).join(stop_levels(book, group=group), group)
    spread = e.agg((F.max("d") - F.min("d")).alias("_spread"))
    waste = F.when(F.col("s") > 0, F.col("delta") / F.col("s")).otherwise(F.lit(0.0))
    return e.crossJoin(spread).select(group, "s", "d", "delta", waste.alias("waste"), "stop_level", (F.col("_spread") <= TOLERANCE).alias("same_d"))


def worth_refining(n: Column, l: Column, gain: float, cost: float, ambiguity: float = 1.0) -> Column:  # noqa: E741
    return F.when((n == 0) | (l == 0), F.lit(gain * ambiguity >= cost)).otherwise(F.lit(gain * ambiguity) * l / n >= F.lit(cost))


# Depth bands of solver ledgers.
BANDS = ((1, 10), (11, 20), (21, 30), (31, 40), (41, 53))


def band_shares(visits: DataFrame, bands=BANDS, group: str = "agent") -> DataFrame:
    """group, band, share of all visits; ``visits``: group, level, n."""
    number = F.coalesce(*(F.when(F.col("level").between(a, b), F.lit(f"{a}-{b}")) for a, b in bands), F.lit("other"))
    total = F.sum(F.sum("n")).over(Window.partitionBy(group))
    return visits.groupBy(group, number.alias("band")).agg((F.sum("n") / total).alias("share"))


def first_blowup(book: DataFrame, group: str = "agent") -> DataFrame:
    """group, level: the first level with more than 4 times the classes of the one before (at least 1) and more than 50; with the peak level."""
    before = F.coalesce(F.lag("n").over(Window.partitionBy(group).orderBy("level")), F.lit(0))
    rows = book.withColumn("_before", before)
    return rows.groupBy(group).agg(F.min(F.when((F.col("n") > 4 * F.greatest(F.lit(1), F.col("_before"))) & (F.col("n") > 50), F.col("level"))).cast("int").alias("blowup_level"), (-F.max(F.struct("n", (-F.col("level")).alias("m")))["m"]).cast("int").alias("peak_level"))


def limsup(values: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """group, limsup: the least suffix maximum of a finite sequence."""
    after = Window.partitionBy(group).orderBy(order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return values.withColumn("_m", F.max(value).over(after)).groupBy(group).agg(F.min("_m").alias("limsup"))


def mesh_ratios(values: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """group, order, ratio: each value over the one before."""
    before = F.lag(value).over(Window.partitionBy(group).orderBy(order))
    return values.withColumn("_b", before).filter("_b IS NOT NULL").select(group, order, (F.col(value) / F.col("_b")).alias("ratio"))


def shifted(labels: Column, symbol: str = "p") -> Column:
    """Every history with one constant symbol before it."""
    return F.concat(F.array(F.lit(symbol)), labels)
