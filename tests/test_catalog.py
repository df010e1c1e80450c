"""Every registered query against its SQL twin, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import tidy

FOLDER = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    got = tidy(entry.queries()[name](spark, FOLDER).toPandas())
    sql = entry.oracle_sql().get(name)
    assert len(got)
    if sql:
        want = tidy(con.execute(sql).df())
        assert list(got.columns) == list(want.columns)
        assert got.equals(want), got.merge(want, how="outer", indicator=True).query("_merge != 'both'").head()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
