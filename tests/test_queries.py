import pytest

from tessella.queries import registry
from tests.oracle import assert_same, connection

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_agrees_with_sql(spark, con, name):
    frame = registry.queries()[name](spark, SF)
    if name in registry.oracle_sql():
        assert_same(frame, con, registry.oracle_sql()[name])
    else:
        assert frame.columns and frame.count() >= 0


def test_every_sql_belongs_to_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
