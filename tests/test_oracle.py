"""Every registered query against its SQL on the given tables."""

import os

import pytest

import __spark_entry__ as entry
from shelfmark.checks import compare
from shelfmark.checks.registry import ORACLES, QUERIES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    cols, rows = compare.spark_rows(entry.queries()[name](spark, SF))
    want_cols, want = compare.duck_rows(con, entry.oracle_sql()[name])
    assert cols == want_cols
    assert rows == want
