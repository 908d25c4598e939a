"""Registered queries against their SQL at the smallest scale; `python tests/compare.py <sf_dir>` does so at others."""

import pytest

from compare import difference, duck
from sitegraph.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, small, name):
    assert difference(spark, con, small, QUERIES[name], ORACLES[name]) is None


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 281
    assert set(entry.oracle_sql()) <= set(entry.queries())
