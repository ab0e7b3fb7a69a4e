"""Closed forms and small fixtures."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tracelode.operators import analytics, costvar, dynamics, graphs, ledger, multires, protocol, tower, warrants


def histories(spark, rows):
    return spark.createDataFrame([("t", h, s) for h, s in rows], "agent string, labels array<string>, ok boolean")


def book(spark, rows, rule="explicit", horizon=None):
    found = ledger.prefix_ledger(histories(spark, rows), F.col("labels"), F.col("ok"), rule=rule, horizon=horizon)
    return found, [(r["n"], r["l"]) for r in found.orderBy("level").collect()]


def bits(d):
    return [list(f"{i:0{d}b}") for i in range(1 << d)]


def toy(name, d=6, w=3):
    if name == "all":
        return [(b, True) for b in bits(d)]
    if name == "one":
        return [(b, i == 0) for i, b in enumerate(bits(d))]
    if name == "half":
        return [(b, b[0] == "0") for b in bits(d)]
    if name == "none":
        return [(b, False) for b in bits(d)]
    spine = ["s"] * d
    return [(spine, True)] + [(spine[:j] + [f"f{k}"], False) for j in range(1, d) for k in range(w)]


@pytest.mark.parametrize(
    ("name", "n", "live", "s", "d", "status"),
    [
        ("all", lambda j: 2**j, lambda j: 2**j, 1, 1, ("STABLE", "STABLE")),
        ("one", lambda j: 2**j, lambda j: 1, 1, 0, ("STABLE", "STABLE")),
        ("half", lambda j: 2**j, lambda j: 2 ** (j - 1), 1, 5 / 6, ("STABLE", "TRENDING_UP")),
        ("none", lambda j: 2**j, lambda j: 0, 1, 0, ("STABLE", "NONE")),
        ("spine", lambda j: 1 + 3 * (j > 1), lambda j: 1, None, 0, None),
    ],
)
def test_toys(spark, name, n, live, s, d, status):
    found, counts = book(spark, toy(name))
    assert counts == [(n(j), live(j)) for j in range(1, 7)]
    e = analytics.exponents(found).first()
    if s is not None:
        assert e["s"] == pytest.approx(s) and e["d"] == pytest.approx(d)
        tails = {r["kind"]: r["status"] for r in analytics.tails(found).collect()}
        assert (tails["s"], tails["d"]) == status
    else:
        assert e["s_at"] == 2 and e["s_shallow"] and e["s"] == pytest.approx(1.0) and e["d"] == 0 and e["d_at"] == 0


def test_horizon_and_explicit_rules_may_disagree(spark):
    rows = [(["0", "0", "0"], True), (["1"] * 8, False)]
    assert book(spark, rows)[1][0] == (2, 1)
    assert book(spark, rows, "horizon")[1][0] == (2, 1)
    assert book(spark, rows)[1][7] == (1, 0) and book(spark, rows, "horizon")[1][7] == (1, 1)


def test_same_ledger_but_different_trees(spark):
    a = [["a", "b"], ["a", "c"], ["d", "e"], ["d", "f"]]
    b = [["a", "b"], ["a", "c"], ["a", "d"], ["e", "f"]]
    shape = {}
    for name, rows in (("a", a), ("b", b)):
        found = ledger.prefixes(histories(spark, [(r, True) for r in rows]), F.col("labels"), F.col("ok"))
        assert [(r["n"], r["l"]) for r in ledger.counts(found).orderBy("level").collect()] == [(2, 2), (4, 4)]
        shape[name] = ledger.canonical_trees(found, 2).first()["shape"]
    assert shape == {"a": "((()())(()()))", "b": "((()()())(()))"}


def test_a_tower_that_does_not_nest_is_refused(spark):
    runs = spark.createDataFrame([(i,) for i in range(4)], "i int")
    bad = tower.Tower(("parity", "constant"), [F.col("i") % 2, F.lit(0)], nested=False)
    with pytest.raises(tower.TowerViolation):
        tower.validate(runs, bad)
    assert tower.violating_pairs(runs, bad, "i").count() == 4
    assert tower.validate(runs, tower.Tower(("half", "all"), [F.col("i") % 2, F.col("i")], nested=False)) == 4
    with pytest.raises(ValueError):
        tower.Tower((), [])


def test_seen_counts_and_rollup_keep_null_parts_apart(spark):
    runs = spark.createDataFrame([("a", None, "x", True), ("a", None, "y", False), ("a", "q", None, False)], "agent string, p string, q string, ok boolean")
    t = tower.Tower(("p", "q"), [F.col("p"), F.col("q")])
    found = {(r["level"], r["k1"], r["k2"]): (r["seen"], r["live"]) for r in ledger.classes(runs, t, F.col("ok"), "agent").collect()}
    assert found == {(1, None, None): (2, True), (1, "q", None): (1, False), (2, None, "x"): (1, True), (2, None, "y"): (1, False), (2, "q", None): (1, False)}


def partition(spark, levels, v, mu=None):
    n = len(v)
    rows = [(i, *(lv[i] for lv in levels), float(v[i]), float((mu or [1 / n] * n)[i])) for i in range(n)]
    return spark.createDataFrame(rows, f"item int, {', '.join(f'l{j} int' for j in range(len(levels)))}, v double, mu double"), [f"l{j}" for j in range(len(levels))]


def test_planted_level_and_identity(spark):
    items, levels = partition(spark, [[0] * 8, [0, 0, 0, 0, 1, 1, 1, 1], [0, 0, 1, 1, 2, 2, 3, 3], list(range(8))], [1, 1, 0, 0, 1, 1, 0, 0])
    multires.check_nesting(items, levels)
    e = {r["level"]: r["energy"] for r in multires.energies(items, levels).collect()}
    assert [e[0], e[1], e[2]] == pytest.approx([0, 0.25, 0])
    d = {r["part"]: r["amount"] for r in multires.decomposition(items, levels).collect()}
    assert d["level 0"] + d["level 1"] + d["level 2"] + d["residual"] == pytest.approx(d["variance"])
    assert [r["dim"] for r in multires.dimensions(items, levels).orderBy("level").collect()] == [1, 2, 4, None]


def test_levels_that_do_not_nest_are_refused(spark):
    items, levels = partition(spark, [[0, 0, 1, 1], [0, 1, 0, 1]], [0, 0, 0, 0])
    with pytest.raises(multires.NestingError):
        multires.check_nesting(items, levels, trivial_root=False)
    with pytest.raises(multires.NestingError):
        multires.check_nesting(items, levels)


def cost_fixture(spark, costs=(1, 3, 10, 14), scale=1.0, offset=(0, 0)):
    rows = [(t, float(c) * scale + offset[i // 2], 0, b, d) for i, (t, c, b, d) in enumerate(zip(["t1", "t1", "t2", "t2"], costs, [0, 0, 0, 1], [0, 1, 1, 2], strict=True))]
    return spark.createDataFrame(rows, "task string, cost double, l0 int, l1 int, l2 int")


def test_cost_decomposition(spark):
    runs = cost_fixture(spark)
    items = costvar.cohort(runs)
    d = {r["part"]: r["amount"] for r in multires.decomposition(items, ["l0", "l1"]).collect()}
    assert d["variance"] == pytest.approx(2.5)
    assert d["level 0"] == pytest.approx(4 / 3)
    for other in (cost_fixture(spark, offset=(5, -7)),):
        o = {r["part"]: r["amount"] for r in multires.decomposition(costvar.cohort(other), ["l0", "l1"]).collect()}
        assert o["level 0"] == pytest.approx(d["level 0"]) and o["variance"] == pytest.approx(d["variance"])
    k = {r["part"]: r["amount"] for r in multires.decomposition(costvar.cohort(cost_fixture(spark, scale=3.0)), ["l0", "l1"]).collect()}
    assert k["variance"] == pytest.approx(9 * d["variance"])


def test_equal_costs_abstain(spark):
    found = costvar.shares(cost_fixture(spark, (2, 2, 2, 2)), ["l0", "l1"])
    assert found.filter("share IS NOT NULL").count() == 0
    assert costvar.best_level(found, 0.1).first()["level"] is None


def test_decisions(spark):
    assert protocol.non_inferior([0.0] * 8) and protocol.non_inferior([0.5] * 8) and not protocol.non_inferior([-0.5] * 8)
    assert protocol.cost_reduced([-0.1] * 8) and not protocol.cost_reduced([0.0] * 8) and not protocol.non_inferior([])
    pairs = spark.createDataFrame([("k", f"t{i}", 0.5) for i in range(8)], "kind string, task string, difference double")
    assert protocol.bootstrap_table(pairs, 0.05).first()["bound"] == 0.5


def test_task_split_repeats_and_is_disjoint(spark):
    runs = spark.createDataFrame([(f"t{i % 5}", i) for i in range(20)], "task string, i int")
    a, b = protocol.task_split(runs, 0.5, seed=3)
    tasks = [f"t{i}" for i in range(5)]
    random.Random(3).shuffle(tasks)
    assert {r["task"] for r in b.select("task").distinct().collect()} == set(tasks[: max(1, round(2.5))])
    protocol.require_disjoint(a, b)
    with pytest.raises(protocol.ProtocolError):
        protocol.require_disjoint(a, a)


def test_warrants(spark):
    with pytest.raises(warrants.CapabilityError, match="Analysis refused"):
        warrants.require(["pi", "otel"], "agent_comparison")
    assert warrants.require("canonical", "o4b_cost")["cost"] == "supported"
    with pytest.raises(KeyError):
        warrants.require("pi", "nothing")
    states = {r["semantic"]: r["state"] for r in warrants.reconciled(spark.createDataFrame([("codex",), ("pi",)], "format string")).collect()}
    assert states["terminal_outcome"] == "unknown" and states["tool_errors"] == "inferred" and states["cost"] == "unavailable"


def test_same_core_different_approach(spark):
    t1 = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 0), (4, 0)], "x long, t long")
    t2 = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 4), (4, 0)], "x long, t long")
    for f, profile in ((t1, {0: 3, 1: 2}), (t2, {0: 3, 1: 1, 2: 1})):
        assert {r["x"] for r in dynamics.recurrent_core(f).collect()} == {0, 1, 2}
        assert {r["depth"]: r["states"] for r in dynamics.transient_profile(f).collect()} == profile
    assert dynamics.cycle_lengths(t1).first().asDict() == {"length": 3, "cycles": 1}
    with pytest.raises(ValueError):
        dynamics.inverse(t1)
    inside = spark.createDataFrame([(0,), (1,)], "x long")
    assert dynamics.core_within(t1, inside).count() == 0


def test_search_against_plain_python(spark):
    edges, n = ((0, 1), (1, 2), (2, 3), (3, 0), (1, 3)), 4

    def run(x, bias, steps, keep):
        tabu = []
        for _ in range(steps):
            options = []
            for v in range(n):
                if v not in tabu:
                    y = x ^ (1 << v)
                    cost = lambda z: sum((z >> a & 1) == (z >> b & 1) for a, b in edges)
                    options.append((cost(y) - cost(x), abs(v - bias * (n - 1)), v))
            if not options:
                break
            v = min(options)[2]
            x, tabu = x ^ (1 << v), (tabu + [v])[-keep:]
        return x

    got = {r["x"]: r["t"] for r in dynamics.search(dynamics.states(spark, n), n, edges, 0.3, 3, 2).collect()}
    assert got == {x: run(x, 0.3, 3, 2) for x in range(16)}


def test_graph_invariants(spark):
    two = spark.createDataFrame([("A", *e) for e in ((0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5))] + [("B", i, (i + 1) % 6) for i in range(6)] + [("T", 0, 1), ("T", 1, 2), ("T", 3, 4)], "graph string, u long, v long")
    c = {r["graph"]: [int(x) for x in r["coefficients"]] for r in graphs.bass_determinants(two).collect()}
    assert c["B"] == [1, 0, 0, 0, 0, 0, -2, 0, 0, 0, 0, 0, 1]
    assert c["A"] == [1, 0, 0, -4, 0, 0, 6, 0, 0, -4, 0, 0, 1]
    assert c["T"] == [1, 0, -2, 0, 1]
    cycles = graphs.prime_cycles(two.filter("graph = 'A'").select("u", "v"), 3)
    assert cycles.first().asDict() == {"length": 3, "cycles": 4}
    assert graphs.ihara_from_cycles(cycles, 6).first()["coefficients"] == [1, 0, 0, -4, 0, 0, 6]


def test_mesh(spark):
    from tracelode.functions import mesh

    depths = mesh.burst_depths(4)
    assert depths == [2, 4, 16, 256]
    js = spark.createDataFrame([(j,) for j in (1, 2, 3, 4, 15, 16)], "j int")
    got = {r["j"]: r["r"] for r in js.select("j", mesh.ratio_explored(F.col("j"), depths).alias("r")).collect()}
    assert got == {j: pytest.approx(math.log2(mesh.counts(j, depths)[1]) / j) for j in got}
