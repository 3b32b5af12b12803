"""Every registered query against SQL on the given tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from catalog.check import compare, connect

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables not present")
pytest.importorskip("duckdb")

NAMES = list(entry.CATALOG)


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SF_DIR), con, entry.oracle_sql()[name]) == ""


def test_every_query_has_sql():
    assert set(entry.CATALOG) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
