"""Every SQL-checked catalog query equals its DuckDB twin at sf0.01 (rows, columns, value hash)."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pytest

import __spark_entry__ as E
from tabulon import catalog
from oracle_check import duck, frame_hash

SF = "/root/testdata/sf0.01"
SQL = catalog.oracle_sql()  # the training-data operators are checked in tests/llm
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, con, name):
    got = E.queries()[name](spark, SF).toPandas()
    want = con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert frame_hash(got) == frame_hash(want[list(got.columns)])


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and df.columns[:2] == ["segment", "n"]
    assert sum(r.n for r in rows) == spark.read.parquet("/root/testdata/sf0.001/orders.parquet") \
        .select("o_custkey").distinct().count()


def test_every_query_has_sql_or_is_a_model():
    rows_only = set(catalog.queries()) - set(SQL)
    assert all(n[0] in "mtnks" for n in rows_only), rows_only
