"""The book of moments against plain loops, and how often its queries read their tables."""

import random
import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tracelode.operators import costvar, moments, multires
from tracelode.plans import queries, queries_traces

LEVELS = ["l0", "l1", "l2"]


def made(spark, n=400, offset=0.0, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a = rng.randrange(3)
        b = rng.randrange(4) if a else 0
        rows.append((i, "all", f"a{a}", None if (a, b) == (1, 1) else f"a{a}b{b}", offset + rng.gauss(a, 1 + b), rng.gauss(b, 2), rng.choice([0.0, 0.5, 1.0, 3.0])))
    return spark.createDataFrame(rows, "item int, l0 string, l1 string, l2 string, v double, u double, mu double"), rows


def plain(rows, value, other, weight):
    """Energies by level, residual and variance of two values, from every item's block means."""
    w = [r[6] if weight else 1.0 for r in rows]
    mass = sum(w)

    def means(j, at):
        sums = {}
        for r, m in zip(rows, w, strict=True):
            s = sums.setdefault(r[1 : 2 + j], [0.0, 0.0])
            s[0] += m
            s[1] += m * r[at]
        return [sums[r[1 : 2 + j]][1] / sums[r[1 : 2 + j]][0] if sums[r[1 : 2 + j]][0] else 0.0 for r in rows]

    x, y = ([means(j, at) for j in range(3)] for at in (value, other))
    inner = lambda a, b: sum(m * p * q for m, p, q in zip(w, a, b, strict=True)) / mass
    less = lambda a, b: [p - q for p, q in zip(a, b, strict=True)]
    energy = [inner(less(x[j + 1], x[j]), less(y[j + 1], y[j])) for j in range(2)]
    own = [r[value] for r in rows]
    return energy, inner(less(own, x[2]), less(own, x[2])), inner(less(own, x[0]), less(own, x[0]))


@pytest.mark.parametrize(("weight", "offset"), [(False, 0.0), (True, 0.0), (False, 1e6)])
def test_energies_by_plain_means(spark, weight, offset):
    items, rows = made(spark, offset=offset)
    items = items if weight else items.drop("mu")
    energy, residual, variance = plain(rows, 4, 4, weight)
    parts = {r["part"]: r["amount"] for r in multires.decomposition(items.repartition(5), LEVELS).collect()}
    near = lambda x: pytest.approx(x, rel=1e-6, abs=1e-9)
    assert [parts["level 0"], parts["level 1"]] == near(energy) and parts["residual"] == near(residual) and parts["variance"] == near(variance)
    crossed = {r["level"]: r["energy"] for r in multires.energies(items, LEVELS, "v", "u").collect()}
    assert [crossed[0], crossed[1]] == near(plain(rows, 4, 5, weight)[0])
    for kept in ([], [0], [1], [0, 1]):
        lost = residual + sum(e for j, e in enumerate(energy) if j not in kept)
        assert multires.kept_levels(items, LEVELS, kept).first()["pruning_error"] == near(lost)
    sets = {tuple(r["kept"]): r["error"] for r in moments.Book.of(items, LEVELS, weight=F.col("mu") if weight else None).pruning_sets("v").collect()}
    assert sets == {k: near(residual + sum(e for j, e in enumerate(energy) if j not in k)) for k in [(), (0,), (1,), (0, 1)]}
    assert multires.band_energy(items, LEVELS, 0, 2).first()["energy"] == near(sum(energy))
    assert sum(r["energy"] for r in multires.parent_energies(items, LEVELS, 1).collect()) == near(energy[1])


def test_books_merge(spark):
    """Two halves' books together are the whole's, and a column kept apart can be dropped later."""
    items, rows = made(spark)
    whole = moments.Book.of(items, LEVELS, ["v", "u"])
    apart = moments.Book.of(items.withColumn("half", F.col("item") % 2), LEVELS, ["v", "u"], by=["half"])
    a, b = (x.rolled().first().asDict() for x in (whole, apart))
    assert a == {k: pytest.approx(v, rel=1e-9, abs=1e-9) for k, v in b.items()}
    for h in (0, 1):
        own = moments.Book.of(items.filter(F.col("item") % 2 == h), LEVELS, ["v", "u"])
        mine, part = ((x.withColumns({"s_v": b.mean("v"), "s_u": b.mean("u")}).drop("half").first().asDict()) for x, b in ((own.rolled(), own), (apart.rolled(by=["half"]).filter(F.col("half") == h), apart)))
        assert mine == {k: pytest.approx(v, rel=1e-9, abs=1e-9) for k, v in part.items()}


def test_lone_children_add_exactly_nothing(spark):
    rows = [(i, "all", f"a{i % 7}", f"a{i % 7}x", 0.1 * i * i) for i in range(100)]
    items = spark.createDataFrame(rows, "item int, l0 string, l1 string, l2 string, v double").repartition(6)
    assert {r["level"]: r["energy"] == 0.0 for r in multires.energies(items, LEVELS).collect()} == {0: False, 1: True}


def test_rebuilt_items(spark):
    items, rows = made(spark)
    for kept in product([False, True], repeat=2):
        which = [j for j, k in enumerate(kept) if k]
        got = multires.reconstruct(items.drop("mu"), LEVELS, which)
        assert got.count() == len(rows)
        lost = multires.kept_levels(items.drop("mu"), LEVELS, which).first()["pruning_error"]
        assert got.agg(F.avg((F.col("v") - F.col("rebuilt")) ** 2).alias("e")).first()["e"] == pytest.approx(lost)


def plain_shares(runs, levels=2):
    """Shares by task and over all of (task, cost, l0, l1, ..) rows known everywhere, two runs a task at least."""
    runs = [r for r in runs if r[1] is not None]
    enough = lambda rows: [r for r in rows if sum(x[0] == r[0] for x in rows) >= 2]
    known = enough([r for r in enough(runs) if all(x not in (None, "unknown") for x in r[2:])])
    tasks = {r[0] for r in known}
    size = {t: sum(r[0] == t for r in known) for t in tasks}
    mean = {t: sum(r[1] for r in known if r[0] == t) / size[t] for t in tasks}
    w = [1 / (len(tasks) * size[r[0]]) for r in known]
    v = [r[1] - mean[r[0]] for r in known]

    def energies(keep):
        def means(j):
            sums = {}
            for r, m, x in zip(known, w, v, strict=True):
                if keep(r):
                    s = sums.setdefault(r[2 : 3 + j], [0, 0])
                    s[0] += m
                    s[1] += m * x
            return [sums[r[2 : 3 + j]][1] / sums[r[2 : 3 + j]][0] if keep(r) else 0 for r in known]

        p = [means(j) for j in range(levels + 1)]
        total = sum(m * (x - a) ** 2 for r, m, x, a in zip(known, w, v, p[0], strict=True) if keep(r))
        return [sum(m * (b - a) ** 2 for m, a, b in zip(w, p[j], p[j + 1], strict=True)) / total for j in range(levels)] if total > 1e-12 else [None] * levels

    return {t: energies(lambda r, t=t: r[0] == t) for t in tasks}, energies(lambda r: True)


def test_shares_from_one_book(spark):
    rng = random.Random(9)
    rows = [(f"t{rng.randrange(6)}", None if rng.random() < 0.05 else 1e5 + rng.gauss(0, 5), "all", rng.choice(["x", "y"]), "") for _ in range(300)]
    rows = [(*r[:4], "unknown" if rng.random() < 0.1 else r[3] + rng.choice("abc")) for r in rows] + [("lone", 3.0, "all", "x", "xa")]
    runs = spark.createDataFrame(rows, "task string, cost double, l0 string, l1 string, l2 string")
    by_task, whole = plain_shares(rows)
    got = {r["level"]: r["share"] for r in costvar.shares(runs, LEVELS).collect()}
    assert [got[0], got[1]] == pytest.approx(whole)
    each = {}
    for r in costvar.by_task_shares(runs, LEVELS).collect():
        each.setdefault(r["task"], {})[r["level"]] = r["share"]
    assert {t: [s[0], s[1]] for t, s in each.items()} == {t: pytest.approx(s) for t, s in by_task.items()}
    assert "lone" not in each


def test_each_table_is_read_once(spark, monkeypatch):
    """Scans of given tables in the plans of what is written and of the result."""
    plans, write = [], moments.held

    def seen(df, label):
        plans.append(df)
        return write(df, label)

    def scans(*frames):
        text = "\n".join(f._jdf.queryExecution().executedPlan().toString() for f in frames)
        return sorted(re.findall(r"/(\w+)\.parquet", "\n".join(re.findall(r"FileScan parquet .*", text))))

    monkeypatch.setattr(moments, "held", seen)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    joined = ["customer", "nation", "orders", "region"]
    for query, want in ((queries.variance_decomposition, joined), (queries_traces.pruned_within_budget, joined), (queries.cost_shares, ["events"]), (queries_traces.selector_by_share, ["events"]), (queries_traces.shares_by_task, ["events"])):
        plans.clear()
        out = query(spark, SF)
        assert scans(out, *plans) == want, query.__name__


def test_restricted_towers_and_other_resolutions(spark):
    from tracelode.operators import analytics

    items, rows = made(spark)
    part = multires.restrict(items, spark.range(0, 400, 3).withColumnRenamed("id", "item"))
    assert part.count() == 134
    multires.check_nesting(part.filter("l2 IS NOT NULL"), LEVELS)
    book = spark.createDataFrame([("x", j, 3**j, 1) for j in (1, 2, 3)], "agent string, level int, n long, l long")
    e = analytics.exponents(book, eps=lambda level: F.pow(F.lit(3.0), -level)).first()
    assert e["s"] == pytest.approx(1.0) and analytics.exponents(book).first()["s"] == pytest.approx(1.584962500721156)
