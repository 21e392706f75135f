"""Queries of the corpus operators that SQL can express."""

import pytest

from tessel.llm import registry
from tests.compare import from_duckdb, from_spark


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, small, name):
    assert from_spark(registry.queries()[name](spark, small)) == from_duckdb(registry.oracle_sql()[name], small)
