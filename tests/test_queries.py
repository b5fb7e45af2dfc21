"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from registry.compare import difference, duck
from tests.conftest import SF

ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert difference(queries()[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()) is None


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(queries())
