import pytest
from oracle import check

from driftloom import registry

SQL = registry.oracle_sql()


def test_every_sql_has_its_query():
    assert set(SQL) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, name):
    check(spark, registry.queries()[name], SQL[name], data)
