"""Every registered query against its SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", list(entry.QUERIES))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    order = lambda rows: sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))
    got = order(tuple(r[c] for c in columns) for r in df.collect())
    assert got
    if name in entry.oracle_sql():
        cursor = db.execute(entry.oracle_sql()[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        assert got == order(tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
