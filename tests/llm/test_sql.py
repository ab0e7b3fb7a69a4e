"""The newer operators against their SQL on whole small tables."""

import duckdb
import pytest

from tests.conftest import SF
from tracelode.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_url_filter", "op13_importance_resampling"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = QUERIES[name](spark, SF)
    want = con.execute(f"select {', '.join(found.columns)} from ({ORACLE[name]})").fetchall()
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want)) and want
