"""Properties of the plans: what reaches the scan, and what must not be in them."""

import re

import pytest
from pyspark.sql import functions as F

from tessel.operators import permute
from tessel.plans import catalog

#: Queries whose semantics need Python: custom aggregates, the IPC source and its hand-over.
PYTHON = {"lifecycle_count", "lifecycle_custom", "lifecycle_global", "lifecycle_empty", "lifecycle_empty_by_key", "ipc_file_roundtrip", "ipc_stream_roundtrip", "ipc_dictionary_delta", "ipc_batch_at"}


def plan(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_no_nested_loops_and_no_python_without_need(spark, small, name):
    text = plan(catalog.queries()[name](spark, small))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", text)
    assert name in PYTHON or not re.search("MapInArrow|MapInPandas|ArrowEvalPython|BatchEvalPython|FlatMapGroupsIn", text)


def test_filters_and_columns_reach_the_scan(spark, small):
    orders = spark.read.parquet(f"{small}/orders.parquet").select("o_orderkey", "o_totalprice")
    text = plan(permute.filter_rows(orders, F.col("o_totalprice") > 1000.0))
    assert "GreaterThan(o_totalprice,1000.0)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text


def test_row_wise_operators_do_not_shuffle(spark, small):
    for name in ("filter_drop_nulls", "filter_emit_nulls", "choose", "concat", "add_wrapping", "divide_truncating", "cast_unsafe", "list_flatten", "union_value", "validate_rows", "null_like"):
        assert "Exchange" not in plan(catalog.queries()[name](spark, small)), name
