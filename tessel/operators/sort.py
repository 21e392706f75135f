"""Sort options as sort keys; sorting, its permutation and the first rows.

Cases: nulls and NaN stand where their placement says, whatever the order; equal rows keep the
table's order in a stable sort and in sort_indices and have any order otherwise; an empty table
gives an empty result; helper columns take names that the table doesn't have.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.operators.ordinal import fresh, with_ordinal
from tessel.options import Order, Placement, SortOptions


def sort_keys(column: str | Column, options: SortOptions = SortOptions(), tie: Column | None = None) -> list[Column]:
    """Keys for one column. Placement of nulls and NaN is absolute, not turned by the order."""
    c = F.col(column) if isinstance(column, str) else column
    missing = c.isNull()
    keys = [missing.desc() if options.null_placement is Placement.AT_START else missing.asc()]
    if options.nan_placement is not None:
        odd = F.coalesce(F.isnan(c), F.lit(False))
        keys.append(odd.desc() if options.nan_placement is Placement.AT_START else odd.asc())
    keys.append(c.desc() if options.order is Order.DESCENDING else c.asc())
    if options.stable and tie is not None:
        keys.append(tie.asc())
    return keys


def sort(df: DataFrame, column: str, options: SortOptions = SortOptions()) -> DataFrame:
    """Stable sorts mark the rows first, since a distributed sort may swap equal ones.

    The marks ascend in the table's own order, so nothing has to be counted or written for them.
    """
    if not options.stable:
        return df.orderBy(*sort_keys(column, options))
    (at,) = fresh(df, "__at")
    return df.withColumn(at, F.monotonically_increasing_id()).orderBy(*sort_keys(column, options, F.col(at))).drop(at)


def sort_indices(df: DataFrame, column: str, options: SortOptions = SortOptions(), order_by: Sequence[str | Column] | None = None) -> DataFrame:
    """position, index: the permutation that sorts; take with it gives the sorted table. Equal rows keep their order."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order_by or ()]
    names = [f"k{n}" for n in range(len(keys))]
    narrow = df.select(F.col(column).alias("v"), *(k.alias(n) for k, n in zip(keys, names)))
    numbered = with_ordinal(narrow, names or None, "index").select("v", "index")
    ranked = with_ordinal(numbered, sort_keys("v", options, F.col("index")) + [F.col("index").asc()], name="position")
    return ranked.select("position", "index")


def top(df: DataFrame, column: str, n: int, options: SortOptions = SortOptions(), tie: Sequence[str] = ()) -> DataFrame:
    """The first n rows of the sort, found without sorting the rest."""
    return df.orderBy(*sort_keys(column, options), *tie).limit(n)
