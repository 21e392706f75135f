"""Arguments of compute functions: columns of a table, or scalars."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from tessel.errors import named


@dataclass(frozen=True)
class Datum:
    """A column with its type and the number of rows it is known to have, or a scalar."""

    column: Column
    data_type: DataType
    scalar: bool = False
    length: int | None = None

    @classmethod
    def of(cls, df: DataFrame, name: str, length: int | None = None) -> Datum:
        if name not in df.columns:
            raise named("UnknownField", name)
        return cls(F.col(f"`{name}`"), df.schema[name].dataType, length=length)

    @classmethod
    def literal(cls, value: Any, data_type: DataType) -> Datum:
        return cls(F.lit(value).cast(data_type), data_type, scalar=True, length=1)


# What kernels ask of their arguments.
def has_arity(args: list[Datum], n: int) -> bool:
    return len(args) == n


def same_types(args: list[Datum]) -> bool:
    return all(a.data_type == args[0].data_type for a in args[1:])


def all_numeric(args: list[Datum]) -> bool:
    from tessel.types import spark_is_numeric

    return all(spark_is_numeric(a.data_type) for a in args)


def unary_column(args: list[Datum]) -> bool:
    return len(args) == 1 and not args[0].scalar


def unary_scalar(args: list[Datum]) -> bool:
    return len(args) == 1 and args[0].scalar


def unary_numeric(args: list[Datum]) -> bool:
    return len(args) == 1 and all_numeric(args)


def binary_same_numeric(args: list[Datum]) -> bool:
    """No promotion: both of one numeric type."""
    return len(args) == 2 and all_numeric(args) and same_types(args)


# How arguments of several lengths go together.
def execution_length(args: list[Datum]) -> int | None:
    """Rows of the result: scalars fit any length, and alone make one row; None if no length is known."""
    if not args:
        raise named("InvalidArity")
    if all(a.scalar for a in args):
        return 1
    lengths = {a.length for a in args if not a.scalar and a.length is not None}
    if len(lengths) > 1:
        raise named("InvalidInput", f"lengths {sorted(lengths)}")
    return lengths.pop() if lengths else None


def any_null(args: list[Datum]) -> Column:
    """Whether a null goes in, in which case null comes out."""
    out = F.lit(False)
    for a in args:
        out = out | a.column.isNull()
    return out


def propagate_nulls(args: list[Datum], result: Column) -> Column:
    return F.when(~any_null(args), result)


def align(left: DataFrame, right: DataFrame, order_left: list | None = None, order_right: list | None = None) -> DataFrame:
    """Two tables of equal length side by side, row by row, however they are partitioned."""
    from tessel.operators.ordinal import RID, with_ordinal

    if left.count() != right.count():
        raise named("InvalidInput", "tables of different lengths")
    return with_ordinal(left, order_left).join(with_ordinal(right, order_right), RID).drop(RID)


def run_lengths(*chunks: list[int]) -> list[int]:
    """Lengths of the runs within which no argument crosses one of its chunk borders."""
    borders = set()
    totals = []
    for lengths in chunks:
        at = 0
        for n in lengths:
            at += n
            borders.add(at)
        totals.append(at)
    if len(set(totals)) > 1:
        raise named("InvalidInput", f"lengths {totals}")
    points = sorted(borders | {0})
    return [b - a for a, b in zip(points, points[1:]) if b > a]


def aligned_chunks(*columns: pa.ChunkedArray) -> Iterator[tuple[int, list[pa.Array]]]:
    """Row number of the first row and a slice of every column, for each run within which no column has a chunk border."""
    at = 0
    for n in run_lengths(*([len(c) for c in column.chunks] for column in columns)):
        yield at, [next(c for c in column.slice(at, n).chunks if len(c)) for column in columns]
        at += n


def scalar_of(df: DataFrame) -> Any:
    """The value of a table of one row and one column."""
    rows = df.limit(2).collect()
    if len(rows) != 1 or len(df.columns) != 1:
        raise named("InvalidInput", "not a single value")
    return rows[0][0]


