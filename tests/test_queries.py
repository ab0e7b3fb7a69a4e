"""Every registered query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FROM_LLM = set(entry_module.LLM_QUERIES) | {"pipeline"}
NAMES = sorted(set(entry_module.queries()) - FROM_LLM)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if frame[c].dtype.kind == "f" or str(frame[c].dtype).startswith("Int"):
            frame[c] = frame[c].astype("float64").round(9)
    return list(frame.columns), sorted(map(repr, frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    got = entry_module.queries()[name](spark, SF).toPandas()
    if name in entry_module.oracle_sql():
        want = con.execute(entry_module.oracle_sql()[name]).df()
        a, b = rows(got), rows(want)
        assert a[0] == b[0]
        assert [r.replace(".0,", ",").replace(".0)", ")") for r in a[1]] == [r.replace(".0,", ",").replace(".0)", ")") for r in b[1]]
    else:
        assert len(got) > 0


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() > 0


def test_ledger_does_not_depend_on_partitioning(spark):
    from pyspark.sql import functions as F

    from tracelode.operators import ledger
    from tracelode.plans import queries, views

    runs = views.event_runs(spark, SF)
    want = rows(ledger.ledger(runs, queries.plain_tower(), queries.ok()).toPandas())
    assert rows(ledger.ledger(runs.repartition(7).orderBy(F.rand(3)), queries.plain_tower(), queries.ok()).toPandas()) == want


def test_more_success_changes_l_only(spark):
    from pyspark.sql import functions as F

    from tracelode.operators import ledger
    from tracelode.plans import queries, views

    runs = views.event_runs(spark, SF)
    base = ledger.ledger(runs, queries.plain_tower(), queries.ok()).toPandas().set_index(["agent", "level"])
    full = ledger.ledger(runs, queries.plain_tower(), F.lit(True)).toPandas().set_index(["agent", "level"])
    assert (base.n == full.n.reindex(base.index)).all() and (base.l <= base.n).all() and (full.l == full.n).all()


def test_lookup_goes_down_whole_paths(spark):
    """Each event run against every stored prefix, in plain Python; some are longer than four steps."""
    from pyspark.sql import functions as F

    from tracelode.functions import steps as S
    from tracelode.plans import queries, views

    runs = views.event_runs(spark, SF).select("ordinal", S.tool_sequence(F.col("steps")).alias("labels"), "cost", queries.ok().alias("ok")).collect()
    paid = {}
    for r in runs:
        for k in range(1, len(r["labels"]) + 1 if r["ok"] else 0):
            p = tuple(r["labels"][:k])
            paid[p] = min(paid.get(p, r["cost"]), r["cost"])
    want = {}
    for r in runs:
        met = [(k, paid[p]) for k in range(1, len(r["labels"]) + 1) if (p := tuple(r["labels"][:k])) in paid]
        hit = next(((k, round(v, 6)) for k, v in met if v <= r["cost"]), (None, None))
        want[r["ordinal"]] = (*hit, max((k for k, _ in met), default=None))
    got = {r["query_id"]: (r["level"], r["payload"] and round(r["payload"], 6), r["reached"]) for r in queries.payload_lookup_whole_path(spark, SF).collect()}
    assert got == want and max(x[2] or 0 for x in got.values()) > 4


def test_region_tree_has_every_customer(spark):
    from tracelode.plans import queries, views

    kids = {}
    for r in views.table(spark, SF, "nation").collect():
        kids.setdefault(r["n_regionkey"], {})[r["n_nationkey"]] = 0
    region = {n: r for r, of in kids.items() for n in of}
    customers = views.table(spark, SF, "customer").collect()
    for c in customers:
        kids[region[c["c_nationkey"]]][c["c_nationkey"]] += 1
    names = {r["r_regionkey"]: r["r_name"] for r in views.table(spark, SF, "region").collect()}
    want = {names[r]: "(" + "".join(sorted("(" + "()" * n + ")" for n in of.values())) + ")" for r, of in kids.items()}
    got = {r["agent"]: r["shape"] for r in queries.ahu_tree_all_customers(spark, SF).collect()}
    assert got == want and sum(s.count("(") for s in got.values()) == len(customers) + len(region) + len(names)
