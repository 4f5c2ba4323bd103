"""Queries with SQL against it."""

import pytest
from compare import compare, connect

from sightline.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    compare(registry.queries()[name](spark, sf), registry.oracle_sql()[name], connect(sf))
