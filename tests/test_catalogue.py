"""Every query against its SQL, and the driver's entry points."""

import pytest
from compare import compare, connect

from sightline.plans import catalogue


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, sf, con, name):
    compare(catalogue.QUERIES[name](spark, sf), catalogue.ORACLES[name], con)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_runs(spark, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
