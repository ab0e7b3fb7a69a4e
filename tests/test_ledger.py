"""Classes by ids, nodes by parents, and trees by digests, against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracelode.operators import ledger, tower


def sequences(n=300, seed=3):
    rng = random.Random(seed)
    labels = ["a", "b", "", "null", None, "a,b", "é"]
    return [(rng.choice(["x", "y"]), [rng.choice(labels[: 2 + k % 6]) for k in range(rng.randrange(7))], rng.random() < 0.3) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "agent string, labels array<string>, ok boolean")


def nodes_of(rows):
    """(agent, prefix): [seen, live, longest]"""
    out = {}
    for agent, labels, ok in rows:
        for k in range(1, len(labels) + 1):
            x = out.setdefault((agent, tuple(labels[:k])), [0, False, 0])
            x[:] = x[0] + 1, x[1] or ok, max(x[2], len(labels))
    return out


def test_nodes_of_prefixes(spark):
    rows = sequences()
    want = nodes_of(rows)
    found = ledger.prefixes(frame(spark, rows).repartition(5), F.col("labels"), F.col("ok"))
    got = found.collect()
    assert len(got) == len(want) == len({(r["agent"], bytes(r["id"])) for r in got})
    assert Counter((r["agent"], r["level"], r["seen"], r["live"], r["longest"]) for r in got) == Counter((a, len(p), *x) for (a, p), x in want.items())
    for level in (1, 3, 5):
        paths = {(r["agent"], tuple(r["prefix"])): [r["seen"], r["live"], r["longest"]] for r in ledger.paths(found, level).collect()}
        assert paths == {k: x for k, x in want.items() if len(k[1]) == level}
    kids = Counter((a, p[:-1]) for a, p in want)
    assert {(r["agent"], r["level"], r["degree"]): r["nodes"] for r in ledger.degrees(found).collect()} == Counter((a, len(p), n) for (a, p), n in kids.items())
    assert Counter((r["agent"], r["level"]) for r in ledger.leaves(found).collect()) == Counter((a, len(p)) for a, p in want if (a, p) not in kids)


def test_a_long_run_costs_its_length(spark):
    """100,000 steps: as many nodes of one size each."""
    long = [str(i % 97) for i in range(100_000)]
    found = ledger.prefixes(frame(spark, [("x", long, True), ("x", long[:50_000] + ["end"], False)]), F.col("labels"), F.col("ok"))
    r = found.agg(F.count("*").alias("n"), F.sum(F.octet_length("id") + F.octet_length("parent") + F.octet_length("label")).alias("bytes"), F.count_if(F.col("seen") == 2).alias("shared"), F.max("level").alias("deep")).first()
    assert (r["n"], r["shared"], r["deep"]) == (100_001, 50_000, 100_000) and r["bytes"] < 100_001 * 36


def test_labels_that_are_no_text(spark):
    df = spark.createDataFrame([("x", [(1, "a"), (1, None)], True), ("x", [(1, "a"), (None, None)], True)], "agent string, labels array<struct<n:int,t:string>>, ok boolean")
    assert {r["level"]: r["n"] for r in ledger.prefix_ledger(df, F.col("labels"), F.col("ok")).collect()} == {1: 1, 2: 2}


@pytest.mark.parametrize("seed", [1, 2])
def test_ledger_by_plain_sets(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["x", "y", None]), rng.choice(["p", "q", None]), [rng.choice(["a", "b", None]) for _ in range(rng.randrange(3))], rng.randrange(3), rng.random() < 0.4) for _ in range(400)]
    runs = spark.createDataFrame(rows, "agent string, p string, q array<string>, r int, ok boolean")
    t = tower.Tower(("p", "q", "r"), [F.col("p"), F.col("q"), F.col("r")])
    classes = {}
    for agent, p, q, r, ok in rows:
        parts = (p, tuple(q), r)
        for j in (1, 2, 3):
            x = classes.setdefault((agent, parts[:j]), [0, False])
            x[:] = x[0] + 1, x[1] or ok
    want = {}
    for (agent, parts), (_, live) in classes.items():
        x = want.setdefault((agent, len(parts)), [0, 0])
        x[:] = x[0] + 1, x[1] + live
    got = {(r["agent"], r["level"]): [r["n"], r["l"]] for r in ledger.ledger(runs.repartition(3), t, F.col("ok")).collect()}
    assert got == want
    assert Counter((r["agent"], r["level"], r["seen"], r["live"]) for r in ledger.class_ids(runs, t, F.col("ok")).collect()) == Counter((a, len(p), *x) for (a, p), x in classes.items())
    assert Counter((r["agent"], r["level"], r["seen"], r["live"]) for r in ledger.classes(runs, t, F.col("ok"), "agent").collect()) == Counter((a, len(p), *x) for (a, p), x in classes.items())


def test_no_part_is_shuffled(spark):
    """Exchanges of a ledger carry ids only, whatever the parts are."""
    runs = spark.createDataFrame([("x", "a long part", True)], "agent string, p string, ok boolean")
    plan = ledger.ledger(runs, tower.Tower(("p", "q"), [F.col("p"), F.col("p")]), F.col("ok"))._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "Window" not in plan


def shape_of(prefixes, node=()):
    return "(" + "".join(sorted(shape_of(prefixes, p) for p in prefixes if p[:-1] == node and p)) + ")"


def test_digests_of_trees_are_equal_as_their_shapes(spark):
    rng = random.Random(11)
    rows = []
    for g in range(40):
        rows += [(f"g{g}", [rng.choice("ab") for _ in range(rng.randrange(1, 4))], True) for _ in range(rng.randrange(1, 5))]
    found = ledger.prefixes(frame(spark, rows), F.col("labels"), F.col("ok"))
    trees = {r["agent"]: (bytes(r["digest"]), r["nodes"]) for r in ledger.ranked_trees(found, 3).collect()}
    strings = {r["agent"]: r["shape"] for r in ledger.canonical_trees(found, 3).collect()}
    assert len(trees) == 40 and len(set(strings.values())) == len({d for d, _ in trees.values()}) > 3
    for g, shape in strings.items():
        own = {tuple(labels[:k]) for a, labels, _ in rows if a == g for k in range(1, len(labels) + 1)}
        assert shape == shape_of(own) and trees[g][1] == len(own) + 1
    assert len({(strings[g], d) for g, (d, _) in trees.items()}) == len(set(strings.values()))


def test_horizon_and_sights_over_many_batches(spark, tmp_path):
    """After every batch the table says what the batch rule says of all runs so far; demotions and returns are told once."""
    from tracelode.streaming import ledgers

    rng = random.Random(6)
    batches = [[("x" if rng.random() < 0.8 else "y", [rng.choice("ab") for _ in range(rng.randrange(1, 2 + n))], rng.random() < 0.2) for _ in range(12)] for n in range(4)]
    batches.append([("x", list("aaaaaaaaa"), False), ("x", list("a"), True)])
    t = tower.Tower(("first", "all"), [F.get("labels", F.lit(0)), F.col("labels")])
    rows, last = [], {}
    for n, batch in enumerate(batches):
        rows += batch
        frame(spark, batch).coalesce(1).write.mode("append").parquet(str(tmp_path / "runs"))
        stream = spark.readStream.schema("agent string, labels array<string>, ok boolean").parquet(str(tmp_path / "runs"))
        ledgers.run_horizon(stream, F.col("labels"), "agent", str(tmp_path / "changes"), str(tmp_path / "p1"), shards=2).awaitTermination()
        ledgers.run_stream(stream, t, F.col("ok"), "agent", str(tmp_path / "sights"), str(tmp_path / "p2")).awaitTermination()
        if n not in (1, 4):
            continue
        got = Counter((r["agent"], r["level"], r["status"]) for r in ledgers.latest_statuses(spark, str(tmp_path / "changes"), "agent").collect())
        nodes = nodes_of(rows)
        top = {a: max(len(p) for b, p in nodes if b == a) for a in ("x", "y") if any(b == a for b, _ in nodes)}
        assert got == Counter((a, len(p), "LIVE" if x[2] >= top[a] else "TRANSIENT") for (a, p), x in nodes.items())
        book = {(r["agent"], r["level"]): (r["n"], r["l"]) for r in ledgers.stream_book(spark, str(tmp_path / "sights"), "agent").collect()}
        assert book == {(r["agent"], r["level"]): (r["n"], r["l"]) for r in ledger.ledger(frame(spark, rows), t, F.col("ok")).collect()}
    told = spark.read.option("basePath", str(tmp_path / "changes")).parquet(str(tmp_path / "changes"))
    # nothing is told twice in a row, and some classes were demoted
    for r in told.groupBy("agent", "id").agg(F.array_sort(F.collect_list(F.struct("batch", "status"))).alias("s")).collect():
        last[r["agent"], bytes(r["id"])] = [x["status"] for x in r["s"]]
    assert all(a != b for s in last.values() for a, b in zip(s, s[1:], strict=False)) and any(s[:2] == ["LIVE", "TRANSIENT"] for s in last.values())
    # no class is in the table of sights more often than twice, as seen and as live
    assert spark.read.parquet(str(tmp_path / "sights")).groupBy("agent", "key").count().agg(F.max("count")).first()[0] <= 2
