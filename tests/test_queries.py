"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = sorted(n for n in entry.oracle_sql())


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def plain(v):
    return (None if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    table = entry.queries()[name](spark, SF)
    columns = sorted(table.columns)
    got = sorted(([plain(x) for x in r] for r in table.select(*columns).collect()), key=str)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    assert sorted(names) == columns
    assert got == sorted(([plain(r[names.index(c)]) for c in columns] for r in want), key=str)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
