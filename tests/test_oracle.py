"""Every registered query equals its SQL on the given tables."""

from __future__ import annotations

import pytest
from compare import connect, differences

from flightops.plans.oracle import oracle_sql
from flightops.plans.queries import QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert differences(QUERIES[name](spark, sf_dir), duck, oracle_sql()[name]) is None
