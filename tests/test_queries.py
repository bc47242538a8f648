"""Every registered query against its SQL on the smallest test tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(df: pd.DataFrame) -> list[tuple]:
    def value(v):
        if v is None or v is pd.NaT or isinstance(v, float) and v != v:
            return ""
        return str(int(v)) if isinstance(v, (bool, int, float)) or hasattr(v, "dtype") and v.dtype.kind in "biuf" else str(v)

    return sorted(tuple(map(value, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, con, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_without_sql_gives_the_same_rows_twice(spark, name):
    """Rows that no SQL can check do not depend on how the rows lie: the same again from tables in another order and partitioning."""
    got = plain(entry.queries()[name](spark, DATA).toPandas())
    assert got and len(set(got)) == len(got)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert plain(entry.queries()[name](spark, DATA).toPandas()) == got
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_entry(spark):
    assert entry.entry(spark).count() > 0
