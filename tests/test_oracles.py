"""Every registered query against its independent answer, on the smallest tables."""

import pytest

import __spark_entry__ as entry_point
from spanloom.plans.oracles import ORACLES
from spanloom.plans.queries import QUERIES
from tests.conftest import SF_DIR
from tests.oracle import connect, difference

# Nothing of these is left (or old enough) in the smallest tables.
EMPTY_HERE = {"unexpired_scores", "stored_scores", "conversation_lookup"}


@pytest.fixture(scope="module")
def duck():
    with connect(SF_DIR) as connection:
        yield connection


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_point.queries()) and set(ORACLES) <= set(entry_point.oracle_sql())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    problem = difference(spark, duck, name, QUERIES[name], ORACLES[name], SF_DIR)
    assert problem is None or (problem.endswith("both empty") and name in EMPTY_HERE)
