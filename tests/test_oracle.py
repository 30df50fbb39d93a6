"""Every named query against its SQL, on the smallest data."""

import pytest
from compare import connect, difference
from conftest import DATA

from tallyspark import catalog

QUERIES, CHECKS = catalog.callables(), catalog.checks()


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_matches_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, DATA), CHECKS[name], duck) is None


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(CHECKS)
