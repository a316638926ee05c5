import pytest
from sheaf.plans.registry import ORACLES, QUERIES

from tests.conftest import SF
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_has_oracle_and_agrees(spark, name):
    check(QUERIES[name], ORACLES[name], spark, SF)


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(ORACLES) <= set(e.oracle_sql())
    assert e.entry(spark).limit(1).count() == 1
