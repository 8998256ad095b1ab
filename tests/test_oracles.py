"""Every registered query against its SQL statement on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, oracle_connection

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not present")


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, connection, name):
    problem, n_rows, _ = compare(spark, connection, name, entry.queries()[name], entry.oracle_sql().get(name), SF_DIR)
    assert problem is None, problem
    assert n_rows > 0


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
