"""Every query of the registry against its SQL in DuckDB, over the smallest tables."""

import glob
import os

import duckdb
import pytest

from tracklens.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    return round(float(value), 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_rows_without_sql(spark, name):
    """Those that SQL can't say are held against plain versions in tests of their own; here they run."""
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = duck.execute(ORACLES[name])
    theirs_columns = [c[0] for c in result.description]
    assert sorted(theirs_columns) == columns
    places = [theirs_columns.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in places) for r in result.fetchall()), key=repr)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        assert a == pytest.approx(b, abs=2e-5) if all(isinstance(x, (int, float)) for x in a) else a == b


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
