"""Every registered query against its checking SQL on the smallest tables."""

import pytest

import checking
from netloom.suite.catalog import CHECKS, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    return checking.duck(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    if name in CHECKS:
        difference = checking.compare(df, CHECKS[name], duck)
        assert difference is None, difference
    else:
        assert df.count() > 0


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)
