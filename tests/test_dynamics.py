"""Published figures of larger instances, and plain loops beside the table operators."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tracelode import model
from tracelode.functions import mesh
from tracelode.functions import steps as S
from tracelode.operators import costvar, dynamics, multires, protocol, tower
from tracelode.sources import sinks


def instance(n):
    return dynamics.find_instance(n, dynamics.ring(n))


def test_grid_of_loops(spark):
    """216 loops on ten vertices: none induces an injective map, quotients have 4 to 33 blocks, the mildest loses two."""
    rows = dynamics.attack(spark, 10, instance(10), dynamics.loop_grid(spark)).collect()
    assert len(rows) == 216 and not any(r["bijective"] for r in rows)
    assert (min(r["blocks"] for r in rows), max(r["blocks"] for r in rows)) == (4, 33)
    mildest = min(rows, key=lambda r: r["surplus"])
    assert (mildest["blocks"], mildest["surplus"]) == (4, 2)


@pytest.mark.parametrize(("tabu", "steps", "states", "blocks", "collisions"), [(1, 4, 2304, 10, 2284), (1, 8, 2304, 8, 2292), (2, 4, 18688, 22, 18632), (2, 8, 18688, 6, 18652)])
def test_memory_in_the_state(spark, tabu, steps, states, blocks, collisions):
    row = dynamics.attack_augmented(spark, 8, instance(8), (0.1, 0.5, 0.9, 0.1), tabu, steps).first()
    assert (row["states"], row["blocks"], row["collisions"], row["bijective"]) == (states, blocks, collisions, False)


@pytest.mark.parametrize(("tabu", "common"), [(2, 332), (3, 369)])
def test_six_loops(spark, tabu, common):
    maps, cores = dynamics.monodromy(spark, 10, instance(10), tabu, 8)
    row = dynamics.monodromy_report(maps, cores).first()
    assert (row["distinct_cores"], row["intersection"], row["composition_holds"], row["inverse_fails"]) == (5, 2, True, True)
    labels = dynamics.branches(dynamics.states(spark, 10), dynamics.optima(spark, 10, instance(10))).withColumnRenamed("branch", "block")
    part, _ = dynamics.coarsest_stable(labels, [maps.filter(F.col("m") == name).select("x", "t") for name in dynamics.LOOPS])
    assert part.select("block").distinct().count() == common


def test_walks_by_a_plain_loop(spark):
    n, edges = 6, instance(6)

    def gain(x, v):
        return sum(-1 if (x >> a & 1) == (x >> b & 1) else 1 for a, b in edges if v in (a, b))

    def walk(x, tabu, biases, steps, length, fresh):
        for bias in biases:
            tabu = [] if fresh else tabu
            for _ in range(steps):
                free = [v for v in range(n) if v not in tabu]
                if not free:
                    break
                v = min(free, key=lambda v: (gain(x, v), abs(v - bias * (n - 1)), v))
                x ^= 1 << v
                tabu = (tabu + [v])[-length:] if length else tabu
        return x, tabu

    for length, steps, biases in ((0, 3, (0.5,)), (2, 4, (0.3, 0.9)), (6, 8, (0.0, 1.0))):
        got = dynamics.transport(spark, n, edges, biases, steps, length).collect()
        assert {r["x"]: r["t"] for r in got} == {x: walk(x, [], biases, steps, length, True)[0] for x in range(1 << n)}
    kept = dynamics.searched(dynamics.states(spark, n), n, edges, 0.4, 5, 3, F.array(F.lit(1), F.lit(4))).collect()
    assert {r["x"]: (r["t"], r["tabu"]) for r in kept} == {x: walk(x, [1, 4], (0.4,), 5, 3, False) for x in range(1 << n)}


def test_smallest_witness_by_enumeration(spark):
    def core(t, inside):
        out = set()
        for x in inside:
            y, seen = t[x], {x}
            while y not in seen and y in inside:
                seen.add(y)
                y = t[y]
            if y == x:
                out.add(x)
        return out

    first = next((n, t, f) for n in (2, 3) for t in itertools.product(range(n), repeat=n) for f in range(1, (1 << n) - 1) if core(t, {x for x in range(n) if f >> x & 1}) != core(t, set(range(n))) & {x for x in range(n) if f >> x & 1})
    row = dynamics.smallest_witness(spark).first()
    n, t, f = first
    assert (row["n"], row["place"], row["f"]) == (n, sum(v * n ** (n - 1 - i) for i, v in enumerate(t)), f)


def test_one_stable_leg_is_needed(spark):
    """A loop that is injective has an injective first leg."""
    edges = instance(6)
    for biases in ((0.5, 0.9, 0.1), (0.9, 0.1)):
        whole = dynamics.collisions(dynamics.transport(spark, 6, edges, biases, 2, 2)).first()["surplus"]
        leg = dynamics.collisions(dynamics.transport(spark, 6, edges, biases[:1], 2, 2)).first()["surplus"]
        assert whole or not leg


# ---------------------------------------------------------------- statistics by plain loops
def resampled(values, q, seed=protocol.SEED, n=protocol.RESAMPLES):
    rng = random.Random(seed)
    means = sorted(sum(values[rng.randrange(len(values))] for _ in values) / len(values) for _ in range(n))
    return means[round(q * (n - 1))]


def test_bootstrap_of_unequal_values(spark):
    values = {"a": [0.5, -1.25, 3.0, 0.0, 2.5, -0.75, 1.0], "b": [-0.4, -0.3, -0.2, -0.5, -0.1, -0.35]}
    rows = [(kind, f"t{i}", v) for kind, own in values.items() for i, v in enumerate(own)]
    table = spark.createDataFrame(rows, "kind string, task string, difference double").repartition(3)
    for q in (0.05, 0.95):
        got = {r["kind"]: (r["n"], r["bound"]) for r in protocol.bootstrap_table(table, q).collect()}
        assert got == {kind: (len(own), resampled(own, q)) for kind, own in values.items()}
    assert protocol.cost_reduced(values["b"]) and not protocol.cost_reduced(values["a"]) and not protocol.cost_reduced([])
    assert not protocol.non_inferior(values["b"]) and protocol.non_inferior([0.0, 0.1, -0.05, 0.2]) and not protocol.non_inferior([])


def test_resamples_in_ranges_are_the_generators(spark):
    """Every range starts where the generator stands after the draws before it, whatever it drew again."""
    for n in (1, 2, 7, 8, 1000):
        rng = random.Random(99)
        want = [rng.randrange(n) for _ in range(n * 30)]
        own, covered = [float(v) for v in range(n)], []
        for size, first, k, state, place in protocol.range_starts(n, 99, 30, per_task=4 * n):
            assert size == n
            assert protocol.range_means(own, n, k, state, place) == [sum(map(float, want[r * n : (r + 1) * n])) / n for r in range(first, first + k)]
            covered += range(first, first + k)
        assert covered == list(range(30))
    values = {"a": [0.5, -1.25, 3.0, 0.1, 2.5, -0.75, 1.0], "b": [0.1 * i * (-1) ** i for i in range(23)]}
    rows = [(kind, f"t{i:02d}", v) for kind, own in values.items() for i, v in enumerate(own)]
    table = spark.createDataFrame(rows, "kind string, task string, difference double").repartition(3)
    got = {r["kind"]: (r["n"], r["bound"]) for r in protocol.bootstrap_table(table, 0.95, seed=5, resamples=500, per_task=600).collect()}
    assert got == {kind: (len(own), protocol.bootstrap_percentile(own, 0.95, seed=5, resamples=500)) for kind, own in values.items()}
    with pytest.raises(ValueError):
        list(protocol.range_starts(0, 1, 10))


def test_split_by_a_plain_shuffle(spark):
    tasks = [f"task{i:02d}" for i in range(15)]
    runs = spark.createDataFrame([(t, i) for t in tasks for i in range(3)], "task string, i int").repartition(4)
    for share, seed in ((0.5, 0), (0.3, 7), (0.01, 1)):
        order = sorted(tasks)
        random.Random(seed).shuffle(order)
        held = set(order[: max(1, round(len(tasks) * share))])
        train, rest = protocol.task_split(runs, share, seed)
        assert {r["task"] for r in rest.collect()} == held and {r["task"] for r in train.collect()} == set(tasks) - held
        protocol.require_disjoint(train, rest)
    with pytest.raises(protocol.ProtocolError):
        protocol.require_disjoint(runs, runs)


# ---------------------------------------------------------------- argument keys
US = "\x1f"
KEYS = [
    ("bash", '{"command": "  a \\n b\\t c "}', "a b c"),
    ("bash", "{}", ""),
    *[("read", f'{{"{p}": "x.py"}}', "x.py") for p in ("path", "file_path", "filePath")],
    ("read", '{"path": "", "file_path": "y"}', "y"),
    *[("read", f'{{"path": "x", "{k}": 5}}', f"x{US}{k}=5") for k in ("offset", "limit", "start", "end", "range", "line", "lines")],
    *[("edit", f'{{"path": "x", "{k}": "ab"}}', f"x{US}{k}#2:ab") for k in ("content", "new_string", "old_string", "new_str", "old_str", "newText", "oldText", "text")],
    ("edit", '{"path": "x", "new_str": "", "limit": null}', f"x{US}new_str#0:"),
    ("write", '{"start_line": 3, "edits": 1, "patch": "p"}', ""),
    ("mcp_x", '{"tool": "t", "args": {"b": 1.0, "a": [{"d": 1, "c": null}]}}', f't{US}{{"a":[{{"c":null,"d":1}}],"b":1}}'),
    ("mcp_x", '{"name": "n", "arguments": 3}', f"n{US}3"),
    ("mcp_x", "{}", "mcp_x"),
    ("other", '{"b": true, "a": "é"}', '{"a":"é","b":true}'),
    ("other", "no json", "no json"),
]


def test_canonical_arguments(spark):
    rows = spark.createDataFrame(KEYS, "tool string, args string, want string")
    got = rows.select("tool", "args", "want", S.canonical_args(F.col("tool"), F.col("args")).alias("key")).collect()
    assert [(r["tool"], r["args"], r["key"]) for r in got if r["key"] != r["want"]] == []
    # edits that differ in one body alone are told apart
    pair = spark.createDataFrame([("edit", '{"path": "p", "new_str": "a"}'), ("edit", '{"path": "p", "new_str": "b"}')], "tool string, args string")
    assert pair.select(S.canonical_args(F.col("tool"), F.col("args"))).distinct().count() == 2


def test_argument_classes(spark):
    rows = [("bash", '{"command": " ls  -l | wc > f"}', "bash|ls|true|true"), ("bash", "{}", "bash||false|false"), ("read", '{"filePath": "/a/.hid/b.tar.gz"}', "read|.gz"), ("edit", '{"path": ".profile"}', "edit|"), ("mcp_q", '{"name": "n"}', "mcp|n"), ("mcp_q", "{}", "mcp|mcp_q"), ("grep", "{}", "grep")]
    got = spark.createDataFrame(rows, "tool string, args string, want string").select(S.arg_class(F.col("tool"), F.col("args")).alias("c"), "want").collect()
    assert [r["c"] for r in got] == [r["want"] for r in got]


# ---------------------------------------------------------------- diagnostic levels, towers
def test_modes(spark):
    step = lambda tool, args, error=None: (tool, args, error)
    cases = [
        ([], ("none", "none", "none")),
        ([step("grep", '{"path": "src", "pattern": "x"}')], ("targeted", "none", "none")),
        ([step("grep", '{"path": "*"}')], ("broad", "none", "none")),
        ([step("bash", '{"command": "rg x"}'), step("find", '{"path": "a"}')], ("broad", "none", "none")),
        ([step("glob", "broken")], ("unknown", "none", "none")),
        ([step("read", '{"path": "a", "offset": 1}'), step("view_file", '{"line": 2}')], ("none", "bounded", "none")),
        ([step("read", '{"path": "a"}'), step("bash", '{"command": "cat a"}')], ("none", "whole-file-or-mixed", "none")),
        ([step("other", "{}", "bad"), step("other", "{}")], ("none", "none", "retry")),
        ([step("other", '{"a": 1, "b": 2}', "bad"), step("other", '{"b": 2, "a": 1}')], ("none", "none", "retry")),
        ([step("other", "{}", "bad"), step("else", "{}")], ("none", "none", "changed-action")),
        ([step("other", "{}"), step("other", "{}", "bad")], ("none", "none", "unresolved")),
        ([step("other", "{}", "bad"), step("other", "broken")], ("none", "none", "unknown")),
    ]
    runs = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(cases)], "i int, steps array<struct<tool:string,args:string,error:string>>")
    steps = F.col("steps")
    got = runs.select("i", costvar.search_mode(steps).alias("s"), costvar.read_scope(steps).alias("r"), costvar.recovery(steps).alias("e")).orderBy("i").collect()
    assert [(r["s"], r["r"], r["e"]) for r in got] == [w for _, w in cases]


def test_registry_of_towers():
    assert tower.build_tower("tool").depth == 6 and tower.build_tower("prefix", F.col("labels"), 4).depth == 4
    with pytest.raises(ValueError, match="known are"):
        tower.build_tower("nothing")


def test_schedules_and_idempotence(spark):
    g = dynamics.loop(0.1, 0.5, 0.9)
    assert g == (0.1, 0.5, 0.9, 0.1) == dynamics.LOOPS["g1"]
    assert dynamics.joined_schedules(g, g[::-1]) == dynamics.LOOPS["g1.g1^-1"] and dynamics.joined_schedules(g, g) == dynamics.LOOPS["g1.g1"]
    with pytest.raises(ValueError, match="meet"):
        dynamics.joined_schedules((0.1, 0.2), (0.3, 0.1))
    f = spark.range(12).select(F.col("id").alias("x"), (F.floor(F.col("id") / 4) * 4).alias("t"))
    assert dynamics.idempotent(f) and not dynamics.idempotent(f.withColumn("t", (F.col("x") + 1) % 12))


def test_mesh_bounds():
    n = {1: 2, 2: 4, 3: 1, 4: 0}
    assert mesh.exponent_with_convention(n, {j: j for j in n}) == 1.0 and mesh.exponent_with_convention({1: 0}, {1: 1}) == 0.0
    assert mesh.sandwich_upper({2: 8, 4: 4}, [2, 4], {2: 2, 4: 4}) == 1.5 and mesh.finite_corpus_bound(64) == 6.0
    assert mesh.counts(16, [2, 4, 16]) == (1 << 16, (1 << 16) + (1 << 32))


def test_long_steps_blocks_and_parquet(spark, tmp_path):
    runs = spark.createDataFrame([(1, [("mcp_a", "{}", None), ("read", "{}", "bad")]), (2, [])], "i int, steps array<struct<tool:string,args:string,error:string>>")
    assert [(r["i"], r["pos"], r["family"], r["error"]) for r in model.steps_long(runs, "i").orderBy("pos").collect()] == [(1, 0, "mcp", None), (1, 1, "read", "bad")]
    items = spark.createDataFrame([(3, "b"), (1, "c"), (2, "b"), (9, "a")], "item int, l string")
    assert {r["l"]: r["k"] for r in multires.block_number(items, "l", "k").collect()} == {"c": 0, "b": 1, "a": 2}
    sinks.write_parquet(items, str(tmp_path / "p"), "l")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 4
