"""Every query with a SQL counterpart gives the same rows on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle import compare, duck

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    assert compare(spark, con, entry.queries()[name], ORACLES[name], SF) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
