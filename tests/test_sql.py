"""Every registered query with SQL gives the same rows as DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from tools.check_sql import plain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        c.execute(f"create view {file.stem} as select * from '{file}'")
    return c


def test_entry(spark):
    assert contract.entry(spark).columns == ["token", "section_id", "freq", "totfreq", "size", "spec", "log10p"]


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, con, name):
    df = contract.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in contract.oracle_sql():
        assert got
        return
    rel = con.sql(contract.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    place = [rel.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in place) for r in rel.fetchall()), key=repr)
