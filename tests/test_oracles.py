"""Every query with an SQL counterpart, compared on the smallest tables."""

import pytest

from oracle_check import database, difference
from queries.oracles import ORACLES
from queries.spark_queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return database(FOLDER)


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, connection, name):
    ours = QUERIES[name](spark, FOLDER).toPandas()
    assert difference(ours, connection.execute(ORACLES[name]).fetchdf()) == ""
