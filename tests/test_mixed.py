"""Files of several formats, made and read when a plan is evaluated in more than one way."""

import duckdb

import __spark_entry__ as entry_module
from tests.conftest import SF


def test_files_keep_their_names_between_evaluations(spark):
    """A row's number in its partition is another one wherever the plan is cut into other partitions."""
    con = duckdb.connect()
    for t in ("conversations", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = dict(con.execute(entry_module.oracle_sql()["load_mixed_folder"]).fetchall())
    few = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1kb", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "12kb"}
    kept = {k: spark.conf.get(k) for k in few}
    try:
        for k, v in few.items():
            spark.conf.set(k, v)
        got = {r["project"]: r["runs"] for r in entry_module.queries()["load_mixed_folder"](spark, SF).collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got == want
