"""Queries with SQL: the same rows as DuckDB on the driver's tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle_check import duck, frame_hash

from tabulon.llm import queries as Q

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_same_rows_as_sql(spark, name):
    got = Q.QUERIES[name](spark, SF).toPandas()
    want = duck(SF).execute(Q.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert frame_hash(got) == frame_hash(want[list(got.columns)])


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.QUERIES) == list(range(1, 14))
