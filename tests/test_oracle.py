"""Every registered query against its SQL text on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from tests.oracle import check, connect

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert check(spark, con, name, QUERIES, ORACLES, SF_DIR) is None


def test_every_text_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["Cluster", "Portfolio_MAPE", "Portfolio_WMAPE"]
