"""Published counts that the generated corpora must reproduce."""

import pytest
from pyspark.sql import functions as F

from tracelode.operators import analytics, ledger
from tracelode.plans import generators as G


@pytest.mark.parametrize(
    ("name", "args", "s", "stop"),
    [("shortest", {"monotone": True}, 0.850919, None), ("admissible", {"slack": 0}, 0.850919, None), ("slack 1", {"slack": 1}, 0.850919, None), ("slack 2", {"slack": 2}, 1.010933, None), ("unpruned", {}, 1.079279, 11)],
)
def test_grid_strategies(spark, name, args, s, stop):
    runs = G.grid_walks(spark, **args).withColumn("agent", F.lit(name))
    book = ledger.prefix_ledger(runs, F.col("labels"), F.col("ok"))
    row = analytics.compare(book).first()
    assert row["d"] == pytest.approx(0.850919, abs=1e-6) and row["s"] == pytest.approx(s, abs=1e-6) and row["stop_level"] == stop


def test_solver_counts(spark):
    book = G.solver_ledger(spark, ["easy", "medium"], list(G.STRATEGIES))
    got = {r["agent"]: (r["n"], r["b"]) for r in book.groupBy("agent", "puzzle").agg(F.sum("n").alias("n"), F.max("backtracks").alias("b")).groupBy("agent").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).collect()}
    assert got["first/asc"][0] == 23232 and got["mrv/asc"][0] == 169 and got["first/random"][0] == 3992


def test_distractors_change_what_is_explored_and_not_what_lives(spark):
    both = G.boundary_runs(spark, 6, False).unionByName(G.boundary_runs(spark, 6, True))
    rows = {(r["agent"], r["level"]): (r["n"], r["l"]) for r in ledger.prefix_ledger(both, F.col("labels"), F.lit(False), rule="horizon").collect()}
    for j in range(1, 7):
        assert rows["A", j] == (2**j, 2**j) and rows["B", j][1] == 2**j
        assert rows["B", j][0] == 2**j + (4 ** (j - 1) if 2 <= j <= 5 else 0)


def test_mixed_agents(spark):
    runs = G.mixed_agents(spark)
    assert runs.count() == 4500
    by = {r["agent"]: r for r in ledger.summary(runs, "agent").collect()}
    assert by["disciplined"]["mean_steps"] == 3.0 and by["wanderer"]["mean_steps"] > 9 and by["disciplined"]["successes"] > by["wanderer"]["successes"] > by["looping"]["successes"]
    assert G.graph_instances(spark).select("instance").distinct().count() == 6
