"""Every registered query against its DuckDB oracle on the smallest tables, and the registry's own rules."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from conftest import SMALL
from tools.check_oracle import TABLES, rows_of

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    return con


def test_registry():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 170


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and df.columns[0] == "row_id"


@pytest.mark.parametrize("name", [n for n in QUERIES if n[:2] != "op" and n != "pipeline"])
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    got = rows_of(df.columns, df.collect())
    if name not in ORACLES:
        assert got
        return
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(columns, cursor.fetchall())
