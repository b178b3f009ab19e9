"""Every query with SQL against DuckDB over the smallest tables; every other one runs."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from oracle import differences

TABLES = os.environ.get("STREAMLOOM_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
NAMES = [n for n, f in entry.queries().items() if ".llm." not in f.__module__]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    df = entry.queries()[name](spark, TABLES)
    if name in entry.oracle_sql():
        assert not differences(df, entry.oracle_sql()[name], TABLES)
    else:
        raise AssertionError(f"{name} has neither SQL nor a test of its own")


def test_entry(spark):
    assert entry.entry(spark).count() > 0
