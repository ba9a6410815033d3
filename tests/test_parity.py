"""Every registered query against its SQL on the smallest data."""

import pytest

from passageworks.queries import ORACLES, QUERIES
from tests.parity import compare, database


@pytest.fixture(scope="module")
def con(small):
    return database(small)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, small, name):
    problem, _ = compare(spark, con, name, small)
    assert problem == ""
