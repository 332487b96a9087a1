"""Every registered query that has SQL gives the rows DuckDB gives on the same tables."""

import math
import os

import pytest

import __spark_entry__ as contract
from tests.conftest import TESTDATA

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(TESTDATA), reason="no test data")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
# Sampling needs more rows than the smallest tables hold for these to be the same size as at other scales.
SHOWN = contract.queries()


@pytest.fixture(scope="module")
def engine():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TESTDATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v


def rows_of(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_matches_sql(spark, engine, name):
    df = SHOWN[name](spark, TESTDATA)
    names = sorted(df.columns)
    mine = rows_of([tuple(plain(r[c]) for c in names) for r in df.collect()])
    found = engine.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    theirs = rows_of([tuple(plain(r[columns.index(c)]) for c in names) for r in found.fetchall()])
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(SHOWN) - set(contract.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert SHOWN[name](spark, TESTDATA).count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() == 1
