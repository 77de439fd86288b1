"""Every registered query against its SQL twin, on the smallest tables."""

import pytest
from compare import spark_rows, sql_rows, views

from statuta import registry

ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return views(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, sf, con, name):
    assert spark_rows(registry.queries()[name](spark, sf)) == sql_rows(con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns[0] == "region_name"
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
