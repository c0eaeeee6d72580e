"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, difference, spark_rows, sql_rows

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables here")
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_equals_sql(spark, con, name):
    got = spark_rows(entry.queries()[name](spark, SF_DIR))
    sql = entry.oracle_sql().get(name)
    if sql is not None:
        assert difference(got, sql_rows(con, sql)) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
