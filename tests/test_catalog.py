"""Every query with SQL gives DuckDB's rows; flagship and entry points work."""

import pytest

from tessel.plans import catalog
from tests.compare import from_duckdb, from_spark


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, small, name):
    columns, rows = from_spark(catalog.queries()[name](spark, small))
    expected_columns, expected = from_duckdb(catalog.oracle_sql()[name], small)
    assert columns == expected_columns
    assert rows == expected


def test_flagship_has_rows(spark, small):
    assert catalog.flagship(spark, small).count() == 5
