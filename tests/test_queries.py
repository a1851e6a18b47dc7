import pytest

from eventrail.plans.oracle import ORACLE_SQL
from eventrail.plans.queries import QUERIES
from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_twin(spark, connection, name):
    assert differences(QUERIES[name](spark, FOLDER), connection, ORACLE_SQL[name]) is None
