"""Every registered query that has SQL gives DuckDB's rows, names and types."""

import os

import duckdb
import pytest

import __spark_entry__
from turnstone import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "BIGINT[]": "array<bigint>"}


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, list) else value


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, oracle, name):
    df = catalog.QUERIES[name](spark, SF)
    want = oracle.sql(catalog.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert {c: TYPES[str(t)] for c, t in zip(want.columns, want.types)} == dict(df.dtypes)
    order = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect()) == sorted(repr(tuple(plain(r[k]) for k in order)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
