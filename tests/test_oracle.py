"""Every registered query against its SQL counterpart on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_module
from compare import compare, duck

FOLDER = os.environ.get("CLUSTERLENS_SF_DIR", "/root/testdata/sf0.001")

# Queries that may be empty on the smallest tables.
MAY_BE_EMPTY = {"unused_entries"}


@pytest.fixture(scope="module")
def connection():
    with duck(FOLDER) as found:
        yield found


def test_every_query_has_sql():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(entry_module.queries()))
def test_query(spark, connection, name):
    sql = entry_module.oracle_sql().get(name)
    function = entry_module.queries()[name]
    if sql is None:
        assert function(spark, FOLDER).count() > 0
        return
    difference = compare(spark, name, function, sql, FOLDER, connection)
    if name in MAY_BE_EMPTY and difference == f"{name}: no rows":
        return
    assert difference is None


def test_entry(spark):
    assert entry_module.entry(spark).limit(1).count() == 1
