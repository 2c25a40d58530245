"""Every registered query against its SQL on the smallest test tables."""

import os

import pytest

import __spark_entry__ as entry
from bindings.queries import QUERIES
from bindings.sql import CHECKS
from tests.oracle_check import compare, connect

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the test tables")


@pytest.fixture(scope="module")
def tables():
    return connect(SF_DIR)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)


def test_entry_registers_them():
    assert set(QUERIES) <= set(entry.queries()) and set(CHECKS) <= set(entry.oracle_sql())


def test_flagship_runs(spark):
    assert entry.entry(spark).columns == ["tool_id", "sensor", "bucket", "avg", "min", "max", "n"]


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_sql(spark, tables, name):
    assert compare(spark, tables, name, QUERIES[name], CHECKS[name], SF_DIR) is None
