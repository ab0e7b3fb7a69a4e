"""Evaluation protocol: label coverage, matched tasks, splits, task statistics, bootstrap decisions, evaluators."""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.steps import collapsed, labelled
from ..tables import held

# Seed and number of resamples, margins of the decision.
SEED = 20260916
RESAMPLES = 10_000
NON_INFERIORITY_MARGIN = 0.10
LEAST_TASKS = 6


class ProtocolError(ValueError):
    """The runs do not allow the comparison."""


def coverage_report(runs: DataFrame) -> DataFrame:
    label = F.col("verified_outcome")
    out = runs.agg(F.count("*").alias("n"), F.count_if(label == "success").alias("success"), F.count_if(label == "failure").alias("failure"), F.count_if(label == "unknown").alias("unknown"), F.count_if(label.isNull()).alias("unevaluated"))
    known = F.col("success") + F.col("failure")
    return out.withColumn("labelled", known).withColumn("coverage", F.when(F.col("n") > 0, known / F.col("n")).otherwise(F.lit(0.0)))


def labelled_runs(runs: DataFrame) -> DataFrame:
    return runs.filter(labelled(F.col("verified_outcome")))


def require_single_evaluator(runs: DataFrame) -> None:
    found = labelled_runs(runs).select("evaluator").distinct().limit(2).count()
    if found != 1:
        raise ProtocolError("labels must come from one evaluator" if found else "no run is labelled")


def matched_tasks(runs: DataFrame, agents: int = 2) -> DataFrame:
    """task, agents: tasks that at least ``agents`` agents ran."""
    return runs.filter(F.coalesce("task", F.lit("")) != "").groupBy("task").agg(F.count_distinct("agent").alias("agents")).filter(F.col("agents") >= agents)


def require_matched(runs: DataFrame, agents: int = 2, tasks: int = 1) -> None:
    if matched_tasks(runs, agents).limit(tasks).count() < tasks:
        raise ProtocolError(f"fewer than {tasks} tasks were run by {agents} agents")


def task_split(runs: DataFrame, share: float = 0.5, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(training, held-out) runs: distinct tasks in order, shuffled by CPython's generator, the first part held out.

    The shuffle is sequential by definition, so tasks (not runs) come to the driver.
    """
    tasks = [r["task"] for r in runs.select("task").distinct().orderBy("task").collect()]
    random.Random(seed).shuffle(tasks)
    held = tasks[: max(1, round(len(tasks) * share))] if tasks else []
    marked = runs.sparkSession.createDataFrame([(t,) for t in held], "task string")
    return runs.join(marked, "task", "left_anti"), runs.join(marked, "task", "left_semi")


def require_disjoint(train: DataFrame, held: DataFrame) -> None:
    if train.select("task").intersect(held.select("task")).limit(1).count():
        raise ProtocolError("a task is in both parts")


def task_success(runs: DataFrame) -> DataFrame:
    """agent, task, score: successes over labelled runs, null if none is."""
    good, bad = F.count_if(F.col("verified_outcome") == "success"), F.count_if(F.col("verified_outcome") == "failure")
    return runs.groupBy("agent", "task").agg(F.when(good + bad > 0, good / (good + bad)).alias("score"))


def task_cost(runs: DataFrame) -> DataFrame:
    """agent, task, mean_cost: null if any run is not priced."""
    return runs.groupBy("agent", "task").agg(F.when(F.count("cost") == F.count("*"), F.avg("cost")).alias("mean_cost"))


def paired_differences(scores: DataFrame, intervention: str, baseline: str, value: str) -> DataFrame:
    """task, difference where both agents have a value."""
    a = scores.filter(F.col("agent") == intervention).select("task", F.col(value).alias("_a"))
    b = scores.filter(F.col("agent") == baseline).select("task", F.col(value).alias("_b"))
    return a.join(b, "task").filter("_a IS NOT NULL AND _b IS NOT NULL").select("task", (F.col("_a") - F.col("_b")).alias("difference"))


def bootstrap_percentile(values: Sequence[float], q: float, seed: int = SEED, resamples: int = RESAMPLES) -> float:
    """The q-quantile of resampled means by CPython's generator: paired values number one for each task, so they fit a driver."""
    draw, n = random.Random(seed).randrange, len(values)
    means = sorted(sum(values[draw(n)] for _ in range(n)) / n for _ in range(resamples))
    return means[round(q * (resamples - 1))]


#: Draws of a task, and words that are drawn at once.
DRAWS_PER_TASK = 4_000_000
_WORDS = 1 << 20
_RANGES = "n long, first long, resamples long, state binary, place int"


def _generator(key: np.ndarray, place: int) -> np.random.MT19937:
    out = np.random.MT19937()
    out.state = {"bit_generator": "MT19937", "state": {"key": key, "pos": place}}
    return out


def _accepted(generator: np.random.MT19937, n: int, words: int) -> np.ndarray:
    """Of so many words of the generator what CPython's ``randrange(n)`` makes of each; ``n`` or more where it draws again."""
    return (generator.random_raw(words) >> np.uint64(32 - n.bit_length())).astype(np.int64)


def range_starts(n: int, seed: int, resamples: int, per_task: int = DRAWS_PER_TASK) -> Iterator[tuple[int, int, int, bytes, int]]:
    """n, first resample, resamples, and the generator's state there, for ranges of about ``per_task`` draws.

    How many words a draw takes is chance, so a range's start is found by going through the
    words before it: a few nanoseconds each, and nothing of them is kept.
    """
    if not 0 < n < 1 << 32:
        raise ValueError(f"between 1 and 2^32 values can be resampled; got {n}")
    _, state, _ = random.Random(seed).getstate()
    now = _generator(np.array(state[:-1], dtype=np.uint32), state[-1])
    each = max(1, per_task // n)
    for first in range(0, resamples, each):
        here = now.state["state"]
        yield n, first, min(each, resamples - first), here["key"].astype("<u4").tobytes(), int(here["pos"])
        left = each * n
        while left and first + each < resamples:
            before = now.state
            good = np.flatnonzero(_accepted(now, n, _WORDS) < n)
            if len(good) >= left:
                now.state = before
                now.random_raw(int(good[left - 1]) + 1)
                left = 0
            else:
                left -= len(good)


def range_means(values: list[float], n: int, resamples: int, state: bytes, place: int) -> list[float]:
    """The means of ``resamples`` resamples from a generator's state on; sums are CPython's."""
    now = _generator(np.frombuffer(state, dtype="<u4").astype(np.uint32), place)
    own = np.array(values)
    draws, have = [], 0
    while have < n * resamples:
        some = _accepted(now, n, min(_WORDS, 2 * (n * resamples - have) + 64))
        draws.append(some[some < n])
        have += len(draws[-1])
    drawn = np.concatenate(draws)[: n * resamples].reshape(resamples, n)
    return [sum(own[row].tolist()) / n for row in drawn]


def bootstrap_table(differences: DataFrame, q: float, group: str = "kind", value: str = "difference", seed: int = SEED, resamples: int = RESAMPLES, per_task: int = DRAWS_PER_TASK) -> DataFrame:
    """group, n, bound: the q-quantile of resampled means of every group, its values ordered by task first; equal to ``bootstrap_percentile``.

    Ranges of resamples are tasks of their own, each from the generator's state at its
    start.  A task holds a group's values (one for each task that was run), never its draws.
    """
    kind = differences.schema[group].dataType.simpleString()
    values = differences.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("task", F.col(value).alias("v")))), lambda x: x["v"]).alias("_values"))

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = list(range_starts(n, seed, resamples, per_task))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), batch.schema.field(0).type), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32()), strict=True))], names=[group, "n", "first", "resamples", "state", "place"])

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [range_means(r["_values"], r["n"], r["resamples"], r["state"], r["place"]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(group), batch.column("n"), pa.array(found, pa.list_(pa.float64()))], names=[group, "n", "means"])

    ranges = held(values.select(group, F.size("_values").cast("long").alias("n")).mapInArrow(starts, f"{group} {kind}, {_RANGES}"), "resamples")
    # a range is a task's work, so they are dealt one by one
    dealt = ranges.join(values, group).repartition(max(1, min(ranges.count(), 10_000)), group, "first")
    each = dealt.mapInArrow(means, f"{group} {kind}, n long, means array<double>")
    ordered = F.array_sort(F.flatten(F.collect_list("means")))
    return each.groupBy(group, "n").agg(F.get(ordered, F.lit(round(q * (resamples - 1)))).alias("bound"))


def non_inferior(differences: Sequence[float], margin: float = NON_INFERIORITY_MARGIN) -> bool:
    return bool(differences) and bootstrap_percentile(differences, 0.05) >= -margin


def cost_reduced(differences: Sequence[float]) -> bool:
    return bool(differences) and bootstrap_percentile(differences, 0.95) < 0


def classify(n_both: Column, holds: Column, reduced: Column) -> Column:
    """D: too few tasks; B: inferior; A: cheaper and not inferior; else D."""
    return F.when(n_both < LEAST_TASKS, "D").when(~holds, "B").when(reduced, "A").otherwise("D")


def report(runs: DataFrame) -> dict:
    """Coverage, and the first protocol error if there is one."""
    out = {"coverage": coverage_report(runs).first().asDict(), "error": None}
    try:
        require_single_evaluator(runs)
        require_matched(runs)
        require_disjoint(*task_split(runs))
    except ProtocolError as e:
        out["error"] = str(e)
    return out


def exact_match(observed: Column, expected: Column, normalize: bool = True) -> Column:
    """success, failure, or unknown where nothing was observed."""
    a, b = (collapsed(observed), collapsed(expected)) if normalize else (observed, expected)
    return F.when(observed.isNull(), "unknown").when(a == b, "success").otherwise("failure")


def file_contains(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """path, label: whether files (path, content) hold the marker wanted (path, marker); a missing file fails."""
    met = wanted.join(files.select("path", F.col("content").cast("string").alias("_c")), "path", "left")
    return met.select("path", F.when(F.contains("_c", F.col("marker")), "success").otherwise("failure").alias("label"))


def attach(runs: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Runs with labels (key, label, evaluator) set; the outcome stays as it was."""
    named = labels.select(key, F.col("label").alias("_l"), F.col("evaluator").alias("_e"))
    return runs.join(named, key, "left").withColumn("verified_outcome", F.coalesce("_l", "verified_outcome")).withColumn("evaluator", F.coalesce("_e", "evaluator")).drop("_l", "_e")
