"""Every query with SQL against DuckDB at the smallest scale."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tidelog import queries as engine

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_oracle(spark, duck, name):
    got = engine.queries()[name](spark, str(SF)).toPandas()
    want = duck.sql(engine.oracle_sql()[name]).df()
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
