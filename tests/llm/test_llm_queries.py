"""Registered queries against their SQL, and the registration itself."""

import duckdb
import pytest
from labelflow.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    import __spark_entry__

    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert got and sorted(got, key=repr) == sorted(expected, key=repr)
