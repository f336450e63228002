"""Every registered query against its SQL on the test tables."""

import duckdb
import pytest
from labelflow import catalog

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def ordered(rows):
    return sorted([tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows], key=repr)


def test_every_query_has_sql():
    assert set(catalog.ORACLES) == set(catalog.QUERIES)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_matches_sql(spark, duck, folder, name):
    df = catalog.QUERIES[name](spark, folder)
    relation = duck.sql(catalog.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    types = dict(zip(relation.columns, map(str, relation.types), strict=True))
    assert {c: SQL_TYPES[df.schema[c].dataType.simpleString()] for c in columns} == types
    places = [relation.columns.index(c) for c in columns]
    expected = [tuple(r[i] for i in places) for r in duck.execute(catalog.ORACLES[name]).fetchall()]
    got = df.select(*[f"`{c}`" for c in columns]).collect()
    assert got
    assert ordered(got) == ordered(expected)
