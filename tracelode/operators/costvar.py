"""Cost-variation shares of a tower's levels, within tasks.

Costs are centred on their task's mean; tasks weigh alike and runs of a task share its
weight.  The selection cohort (runs known at every level) is weighed and centred anew.

Runs are read once, into a book of moments with a row for each finest block of a task, which
is written; cohorts, shares, support and selections are taken from that book.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.steps import canonical_args, collapsed, has_error
from ..tables import held
from .moments import Book

UNKNOWN = "unknown"


def cohort(runs: DataFrame, r_min: int = 2) -> DataFrame:
    """Priced runs of tasks with at least ``r_min`` of them, with mu and centred cost v: the rows themselves."""
    priced = runs.filter("cost IS NOT NULL")
    tasks = priced.groupBy("task").agg(F.count("*").alias("_m"), F.avg("cost").alias("_c")).filter(F.col("_m") >= r_min)
    total = tasks.agg(F.count("*").alias("_tasks"))
    return priced.join(tasks, "task").crossJoin(total).withColumn("mu", 1.0 / (F.col("_tasks") * F.col("_m"))).withColumn("v", F.col("cost") - F.col("_c")).drop("_m", "_c", "_tasks")


def cost_book(runs: DataFrame, levels: Sequence[str]) -> Book:
    """The written book of the priced runs' costs, by task."""
    return Book.of(runs.filter("cost IS NOT NULL").select("task", "cost", *levels), levels, ["cost"], by=["task"])


def weighed(book: Book, r_min: int = 2) -> Book:
    """``book`` without tasks of under ``r_min`` runs, every task of the same mass, costs centred on their task's mean.

    Products about a block's own means stay as they are when costs are centred; only their mass changes.
    """
    tasks = book.blocks.groupBy("task").agg(F.sum("n").alias("_m"), (F.sum("s_cost") / F.sum("mass")).alias("_c"), F.sum("mass").alias("_mass")).filter(F.col("_m") >= r_min)
    total = tasks.agg(F.count("*").alias("_tasks"))
    share = 1.0 / (F.col("_tasks") * F.col("_mass"))
    rows = book.blocks.join(tasks, "task").crossJoin(total)
    rows = rows.select("task", *book.levels, "n", (F.col("mass") * share).alias("mass"), ((F.col("s_cost") - F.col("mass") * F.col("_c")) * share).alias("s_cost"), (F.col("c_cost_cost") * share).alias("c_cost_cost"))
    return replace(book, blocks=rows, pivot=(0.0,))


def _unknown(levels: Sequence[str], unknown: str = UNKNOWN) -> Column:
    out = F.lit(False)
    for c in levels:
        out = out | F.col(c).isNull() | (F.col(c).cast("string") == unknown)
    return out


def known_cohort(book: Book, r_min: int = 2, unknown: str = UNKNOWN) -> Book:
    """Runs of the cohort known at every level, weighed and centred on their own.

    Tasks are those that qualify before and after.  Written, as energies and support both start from it.
    """
    enough = book.blocks.groupBy("task").agg(F.sum("n").alias("_m")).filter(F.col("_m") >= r_min).select("task")
    known = weighed(replace(book, blocks=book.blocks.join(enough, "task", "left_semi").filter(~_unknown(book.levels, unknown))), r_min)
    return replace(known, blocks=held(known.blocks, "known"))


def support(book: Book, k_tasks: int = 2, least: float = 0.5, min_blocks: int = 2) -> DataFrame:
    """level, blocks, mean_size, supported (mass in blocks that at least k_tasks tasks share), admissible; of a weighed book."""
    long = book.blocks.select("task", "n", "mass", F.explode(F.array(*(F.struct(F.lit(j).alias("level"), F.col(c).cast("string").alias("block")) for j, c in enumerate(book.levels)))).alias("x")).select("task", "n", "mass", "x.*")
    per_task = long.groupBy("level", "block", "task").agg(F.sum("n").alias("n"), F.sum("mass").alias("mu"))
    blocks = per_task.groupBy("level", "block").agg(F.sum("n").alias("n"), F.sum("mu").alias("mu"), F.count("*").alias("tasks"))
    out = blocks.groupBy("level").agg(F.count("*").alias("blocks"), F.avg("n").alias("mean_size"), F.coalesce(F.sum(F.when(F.col("tasks") >= k_tasks, F.col("mu"))), F.lit(0.0)).alias("supported"))
    return out.withColumn("admissible", (F.col("blocks") >= min_blocks) & (F.col("supported") >= least))


def shares(runs: DataFrame | Book, levels: Sequence[str], r_min: int = 2, k_tasks: int = 2, least: float = 0.5, min_blocks: int = 2, u_max: float = 0.5) -> DataFrame:
    """level, energy, share (null if there is no variation: the statistic abstains), admissible, excluded (mass not known everywhere).

    The share of level j is of the detail from j to j + 1; a level is admissible by the support of j + 1.
    """
    book = runs if isinstance(runs, Book) else cost_book(runs, levels)
    excluded = weighed(book, r_min).blocks.agg(F.coalesce(F.sum(F.when(_unknown(levels), F.col("mass"))), F.lit(0.0)).alias("excluded"))
    known = known_cohort(book, r_min)
    total = known.variance("cost")
    each = F.array(*(F.struct(F.lit(j).alias("level"), known.of_level(j, "cost").alias("energy")) for j in range(len(levels) - 1)))
    found = known.rolled().select(total.alias("total"), F.explode(each).alias("x")).select("total", "x.*").crossJoin(excluded)
    fit = support(known, k_tasks, least, min_blocks).select((F.col("level") - 1).alias("level"), F.col("admissible"))
    return found.join(fit, "level").select("level", "energy", F.when(F.col("total") > 0, F.col("energy") / F.col("total")).alias("share"), (F.col("admissible") & (F.col("excluded") <= u_max)).alias("admissible"), "excluded")


def best_level(found: DataFrame, s_min: float) -> DataFrame:
    """level, share of the admissible level with the largest share of at least s_min; ties to the coarser."""
    top = F.max(F.when(F.col("admissible") & (F.col("share") >= s_min), F.struct("share", (-F.col("level")).alias("m"))))
    return found.agg(top.alias("t")).select((-F.col("t.m")).cast("int").alias("level"), F.col("t.share").alias("share"))


def described(runs: DataFrame, level: str, r_min: int = 2) -> DataFrame:
    """known, mass, energy: a level's mass and centred second moment in the full cohort, by whether it is known."""
    book = weighed(cost_book(runs, [level]), r_min)
    square = F.col("c_cost_cost") + F.when(F.col("mass") > 0, F.col("s_cost") * F.col("s_cost") / F.col("mass")).otherwise(0.0)
    return book.blocks.groupBy((~_unknown([level])).alias("known")).agg(F.sum("mass").alias("mass"), F.sum(square).alias("energy"))


def localised(book: DataFrame, labelled_tasks: DataFrame, actionable=(2, 3, 4, 5), least: float = 0.2, tasks: int = 5) -> DataFrame:
    """level, median: the actionable level of the largest median transient share over labelled tasks; no row if none qualifies.

    ``book``: task, level, n, l.  Ties to the coarser level.
    """
    tau = book.join(labelled_tasks, "task", "left_semi").filter((F.col("n") > 0) & F.col("level").isin(*actionable)).withColumn("tau", (F.col("n") - F.col("l")) / F.col("n"))
    fit = tau.groupBy("level").agg(F.median("tau").alias("median"), F.count_if(F.col("tau") > 0).alias("c")).filter((F.col("median") >= least) & (F.col("c") >= tasks))
    return fit.orderBy(F.desc("median"), "level").limit(1).select("level", "median")


def attributed(calls: DataFrame) -> DataFrame:
    """Calls (message_id, cost, ...) with the message's cost split equally over its calls; repeated calls of a run flagged.

    Joins aggregates back rather than holding a message or a run in a window.
    """
    each = calls.groupBy("message_id").agg(F.count("*").alias("_n"))
    again = calls.groupBy("run", "tool", "args").agg(F.count("*").alias("_r"))
    return calls.join(each, "message_id").join(again, ["run", "tool", "args"]).withColumn("call_cost", F.col("cost") / F.col("_n")).withColumn("repeated", F.col("_r") > 1).drop("_n", "_r")


# Tools and first words of commands that search or read.
SEARCH_TOOLS = ("grep", "glob", "search", "find", "websearch")
SEARCH_WORDS = ("grep", "rg", "find", "fd", "ls", "ag", "ack")
READ_TOOLS = ("read", "view_file", "read_file")
READ_WORDS = ("cat", "head", "tail", "sed", "less", "more", "nl")
READ_RANGES = ("offset", "limit", "start", "end", "line")


def _first_word(args: Column) -> Column:
    return F.coalesce(F.get(F.split(collapsed(F.coalesce(F.get_json_object(args, "$.command"), F.lit(""))), " "), 0), F.lit(""))


def _parses(args: Column) -> Column:
    return F.coalesce(F.json_object_keys(args).isNotNull(), F.lit(False))


def searches(s: Column) -> Column:
    return s["tool"].isin(*SEARCH_TOOLS) | ((s["tool"] == "bash") & _first_word(s["args"]).isin(*SEARCH_WORDS))


def reads(s: Column) -> Column:
    return s["tool"].isin(*READ_TOOLS) | ((s["tool"] == "bash") & _first_word(s["args"]).isin(*READ_WORDS))


def search_mode(steps: Column) -> Column:
    """none, targeted, broad, or unknown where a search's arguments are no object."""
    found = F.filter(steps, searches)
    scope = lambda s: F.coalesce(*(F.get_json_object(s["args"], f"$.{k}") for k in ("path", "scope", "pattern", "command")), F.lit(""))
    wide = lambda s: F.contains(scope(s), F.lit("*")) | scope(s).isin("/", "")
    return F.when(F.size(found) == 0, "none").when(F.exists(found, lambda s: ~_parses(s["args"])), UNKNOWN).when((F.size(found) >= 2) | F.exists(found, wide), "broad").otherwise("targeted")


def read_scope(steps: Column) -> Column:
    """none, bounded (every read declares a range), whole-file-or-mixed, or unknown."""
    found = F.filter(steps, reads)
    ranged = lambda s: F.coalesce(*(F.get_json_object(s["args"], f"$.{k}") for k in READ_RANGES)).isNotNull()
    return F.when(F.size(found) == 0, "none").when(F.exists(found, lambda s: ~_parses(s["args"])), UNKNOWN).when(F.forall(found, ranged), "bounded").otherwise("whole-file-or-mixed")


def recovery(steps: Column) -> Column:
    """What follows the first error at once: none, retry, changed-action, unresolved, or unknown."""
    failed = F.transform(steps, lambda s: has_error(s["error"]))
    at = F.array_position(failed, True)
    step, after = F.get(steps, (at - 1).cast("int")), F.get(steps, at.cast("int"))
    same = (step["tool"] == after["tool"]) & canonical_args(step["tool"], step["args"]).eqNullSafe(canonical_args(after["tool"], after["args"]))
    return F.when(F.size(steps) <= 0, "none").when(at == 0, "none").when(after.isNull(), F.when(_parses(step["args"]), "unresolved").otherwise(UNKNOWN)).when(~_parses(step["args"]) | ~_parses(after["args"]), UNKNOWN).when(same, "retry").otherwise("changed-action")


def diagnostic_levels(runs: DataFrame) -> DataFrame:
    """``runs`` with l0..l3: a trivial root, then search mode, read scope and recovery, each with the levels before it; unknown stays unknown."""
    found = runs.withColumn("_modes", F.array(search_mode(F.col("steps")), read_scope(F.col("steps")), recovery(F.col("steps"))))
    out = found.withColumn("l0", F.lit("all"))
    for j in (1, 2, 3):
        upto = F.slice("_modes", 1, j)
        out = out.withColumn(f"l{j}", F.when(F.array_contains(upto, UNKNOWN), F.lit(UNKNOWN)).otherwise(F.array_join(upto, "|")))
    return out.drop("_modes")


def by_task_shares(runs: DataFrame | Book, levels: Sequence[str], r_min: int = 2) -> DataFrame:
    """task, level, share of the task's own variation among runs known everywhere; null where it has none."""
    known = known_cohort(runs if isinstance(runs, Book) else cost_book(runs, levels), r_min)
    total = known.variance("cost") * F.col("mass")
    each = F.array(*(F.struct(F.lit(j).alias("level"), (known.of_level(j, "cost") * F.col("mass")).alias("e")) for j in range(len(levels) - 1)))
    return known.rolled(by=["task"]).select("task", total.alias("total"), F.explode(each).alias("x")).select("task", "x.level", F.when(F.col("total") > 1e-12, F.col("x.e") / F.col("total")).alias("share"))


def select_by_share(runs: DataFrame, levels: Sequence[str], s_min: float, k: int = 3, **support_rule) -> DataFrame:
    """level, median: the admissible level of the largest median share over tasks, at least ``s_min`` and above 0 in ``k`` tasks; no row if none is. Ties to the coarser."""
    book = cost_book(runs, levels)
    per = by_task_shares(book, levels).groupBy("level").agg(F.median("share").alias("median"), F.count_if(F.col("share") > 0).alias("present"))
    fit = shares(book, levels, **support_rule).filter("admissible").select("level")
    return per.join(fit, "level").filter((F.col("median") >= s_min) & (F.col("present") >= k)).orderBy(F.desc("median"), "level").limit(1).select("level", "median")


def select_by_cost(calls: DataFrame, runs: DataFrame, margin: float) -> DataFrame:
    """level, mean: the refinement whose events cost most on the mean (0 searches, 1 reads, 2 errors and what follows them).

    ``calls``: run, pos, message_id, tool, args, error, cost (of the message, which its calls
    share alike); ``runs``: run, mu.  No row if the first does not exceed the second by ``margin``.
    """
    after = F.lag(has_error(F.col("error"))).over(Window.partitionBy("run").orderBy("pos"))
    # the window is over calls as they are; what a message's calls share is joined to them after
    each = attributed(calls.withColumn("_after", F.coalesce(after, F.lit(False)))).withColumn("_s", F.struct("tool", "args"))
    kinds = F.array(F.when(searches(F.col("_s")), F.lit(0)), F.when(reads(F.col("_s")), F.lit(1)), F.when(has_error(F.col("error")) | F.col("_after"), F.lit(2)))
    long = each.select("run", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("level"), "call_cost").join(runs.select("run", "mu"), "run")
    rank = long.groupBy("level").agg((F.sum(F.col("mu") * F.col("call_cost")) / F.sum("mu")).alias("mean"))
    top = rank.agg(F.slice(F.sort_array(F.collect_list(F.struct("mean", (-F.col("level")).alias("m"))), asc=False), 1, 2).alias("t"))
    first, second = F.get("t", F.lit(0)), F.get("t", F.lit(1))
    return top.filter(first.isNotNull() & (first["mean"] > F.coalesce(second["mean"], F.lit(0.0)) + margin)).select((-first["m"]).cast("int").alias("level"), first["mean"].alias("mean"))


def cheapest_description(train: Book, held_out: Book, budget: Column, value: str = "v") -> DataFrame:
    """kept (details), train_error, held_error: the fewest details whose pruning error on ``train`` is within ``budget``; the error on ``held_out`` is that of predicting from ``train``.

    All sets of details are rows made of one row of the book.  ``budget`` is over the columns
    ``residual`` and ``variance`` of the training book.  Ties to the smaller error.
    """
    levels, details = train.levels, len(train.levels) - 1
    bounds = train.rolled().select(train.residual(value).alias("residual"), train.variance(value).alias("variance")).select(budget.alias("_budget"))
    best = train.pruning_sets(value).crossJoin(bounds).filter(F.col("error") <= F.col("_budget")).orderBy(F.size("kept"), "error", "mask").limit(1).select("kept", F.col("error").alias("train_error"))
    out = held_out.blocks
    for j in range(details + 1):
        here = [*levels[: j + 1]]
        means = train.means(j, value, f"_p{j}").withColumnsRenamed({c: f"_{c}" for c in here})
        alike = F.lit(True)
        for c in here:
            alike = alike & out[c].eqNullSafe(means[f"_{c}"])
        out = out.join(means, alike, "left").drop(*(f"_{c}" for c in here))
    guess = F.col("_p0")
    for j in range(details):
        # a block that training does not know adds nothing to what is coarser
        guess = guess + F.when(F.array_contains("kept", F.lit(j)), F.coalesce(F.col(f"_p{j + 1}") - F.col(f"_p{j}"), F.lit(0.0))).otherwise(F.lit(0.0))
    off = F.col(f"s_{value}") - F.col("mass") * (guess - held_out.about(value))
    error = F.sum(F.col(f"c_{value}_{value}") + F.when(F.col("mass") > 0, off * off / F.col("mass")).otherwise(0.0)) / F.sum("mass")
    return out.crossJoin(best).groupBy("kept", "train_error").agg(error.alias("held_error"))
