"""The queries over the smallest tables against their SQL."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda x: f"{x:.6g}" if isinstance(x, float) and math.isfinite(x) else str(x)
    return list(frame.columns), sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    assert rows(entry.queries()[name](spark, DATA).toPandas()) == rows(duck.execute(entry.oracle_sql()[name]).df())


def test_names():
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
