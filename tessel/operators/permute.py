"""Row permutations: slice, take, filter, row-wise select, concat, typed empty and null tables.

Cases: nulls travel with their rows; rows that tie in ``order_by`` are numbered in any order among
themselves; equal rows each count; empty tables give empty results, and every index into them is
out of range; helper columns take names that the table doesn't have, and a table with a column of
a result's own name (position) is InvalidInput.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, StructType

from tessel.errors import marker, named
from tessel.operators.ordinal import RID, first_ordinals, fresh, unclaimed, with_ordinal
from tessel.options import FilterOptions
from tessel.schema import same_schema

Order = Sequence[str | Column] | None
#: The order of the result of a take.
POSITION = "position"


def slice_rows(df: DataFrame, offset: int, length: int, order_by: Order = None) -> DataFrame:
    """Rows offset to before offset + length; beyond the table is an error, not a shorter result."""
    n = df.count()
    if offset < 0 or length < 0 or offset + length > n:
        raise named("SliceOutOfBounds", f"{offset} + {length} of {n}")
    (rid,) = fresh(df, RID)
    return first_ordinals(df, offset + length, order_by, rid).where((F.col(rid) >= offset) & (F.col(rid) < offset + length)).drop(rid)


def slice_empty(df: DataFrame) -> DataFrame:
    return df.where(F.lit(False))


def take(df: DataFrame, indices: DataFrame, order_by: Order = None, nullable: bool = False) -> DataFrame:
    """Row k of the result is the input's row indices[k]; a null index, where allowed, gives nulls.

    indices: position and index, both whole numbers. The result keeps position, by which it
    is in order; rows out of range are InvalidInput when the result is computed.
    """
    unclaimed(df, POSITION)
    (rid,) = fresh(df, RID)
    return _taken(with_ordinal(df, order_by, rid), rid, indices, nullable, POSITION)


def _taken(rows: DataFrame, rid: str, indices: DataFrame, nullable: bool, position: str) -> DataFrame:
    """The numbered rows that the indices name, beside their position."""
    columns = [c for c in rows.columns if c != rid]
    at, index = fresh(rows, "__position", "__index")
    asked = indices.select(F.col(POSITION).cast("long").alias(at), F.col("index").cast("long").alias(index))
    joined = asked.join(rows, F.col(index) == F.col(rid), "left")
    lost = F.col(rid).isNull() if not nullable else F.col(index).isNotNull() & F.col(rid).isNull()
    checked = F.when(lost, F.raise_error(F.lit(marker("InvalidInput"))).cast("long")).otherwise(F.col(at))
    return joined.select(checked.alias(position), *(F.col(f"`{c}`") for c in columns))


def take_list(df: DataFrame, indices: Sequence[int | None], order_by: Order = None) -> DataFrame:
    """take with the indices in hand; a null among them makes it nullable. Only rows up to the greatest index are numbered."""
    return _take_list(df, indices, order_by, unclaimed(df, POSITION))


def _take_list(df: DataFrame, indices: Sequence[int | None], order_by: Order, position: str) -> DataFrame:
    asked = df.sparkSession.createDataFrame([(k, i) for k, i in enumerate(indices)], f"{POSITION} long, index long")
    (rid,) = fresh(df, RID)
    rows = first_ordinals(df, max((i for i in indices if i is not None), default=-1) + 1, order_by, rid)
    return _taken(rows, rid, asked, any(i is None for i in indices), position)


def take_scalar(value: Column, indices: DataFrame) -> DataFrame:
    """A scalar has the same value at every index, whatever the index."""
    return indices.select(POSITION, value.alias("value"))


def element_at(df: DataFrame, index: int, order_by: Order = None) -> DataFrame:
    (position,) = fresh(df, "__position")
    return _take_list(df, [index], order_by, position).drop(position)


def _boolean(df: DataFrame, predicate: Column) -> None:
    if not isinstance(df.select(predicate.alias("p")).schema["p"].dataType, BooleanType):
        raise named("InvalidInput", "a predicate has to be boolean")


def filter_rows(df: DataFrame, predicate: Column, options: FilterOptions = FilterOptions()) -> DataFrame:
    """True keeps a row, false drops it, null drops it or, with drop_nulls off, leaves an all-null row in its place."""
    _boolean(df, predicate)
    if options.drop_nulls:
        return df.where(predicate)
    (keep,) = fresh(df, "__keep")
    marked = df.withColumn(keep, predicate).where(F.col(keep).isNull() | F.col(keep))
    return marked.select(*(F.when(F.col(keep), F.col(f"`{c}`")).alias(c) for c in df.columns))


def selection_indices(df: DataFrame, predicate: Column, options: FilterOptions = FilterOptions(), order_by: Order = None) -> DataFrame:
    """rid, index: the row numbers a filter selects; a null index stands for an emitted null row."""
    _boolean(df, predicate)
    keys = [F.col(c) if isinstance(c, str) else c for c in order_by or ()]
    names = [f"k{n}" for n in range(len(keys))]
    rows = with_ordinal(df.select(predicate.alias("keep"), *(k.alias(n) for k, n in zip(keys, names))), names or None)
    kept = rows.where(F.col("keep") if options.drop_nulls else F.col("keep").isNull() | F.col("keep"))
    return kept.select(F.col(RID).alias("rid"), F.when(F.col("keep"), F.col(RID)).alias("index"))


def choose(index: Column, values: Sequence[Column], nullable: bool = False) -> Column:
    """The value whose number the index gives, row by row; literals serve as scalars. Out of range is InvalidInput."""
    if not values:
        raise named("InvalidArity")
    out = F.when(index == 0, values[0])
    for k, value in enumerate(values[1:], 1):
        out = out.when(index == k, value)
    if nullable:
        out = out.when(index.isNull(), F.lit(None))
    return out.otherwise(F.raise_error(F.lit(marker("InvalidInput"))))


def choose_from(df: DataFrame, index: str, values: Sequence[str | Column], name: str = "value", nullable: bool = False) -> DataFrame:
    """choose over a table's columns, whose types have to be the same."""
    columns = [F.col(v) if isinstance(v, str) else v for v in values]
    kinds = [df.select(c.alias("v")).schema["v"].dataType for c in columns]
    if any(k != kinds[0] for k in kinds):
        raise named("InvalidInput", "values of several types")
    return df.withColumn(name, choose(F.col(index), columns, nullable))


def concat(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of parts of one schema; nothing is coerced."""
    if not parts:
        raise named("InvalidInput", "nothing to concatenate")
    for p in parts[1:]:
        if not _concatenates(parts[0].schema, p.schema):
            raise named("InvalidInput", f"{parts[0].schema.simpleString()} and {p.schema.simpleString()}")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def concat_ordered(parts: Sequence[DataFrame], order_by: Order = None) -> DataFrame:
    """concat with part and rid, which give the parts' order."""
    if not parts:
        raise named("InvalidInput", "nothing to concatenate")
    return concat([with_ordinal(p, order_by).withColumn("part", F.lit(k)).withColumnRenamed(RID, "rid") for k, p in enumerate(parts)])


def _concatenates(a: StructType, b: StructType) -> bool:
    loose = lambda s: [(f.name, f.dataType) for f in s.fields]
    return same_schema(a, b) or loose(a) == loose(b)


def chunked(parts: Sequence[DataFrame]) -> DataFrame:
    """One logical column of several chunks: concat under the chunk's own error."""
    try:
        return concat(parts)
    except Exception as error:
        raise named("InvalidChunkType", str(error)) from error


def null_like(df: DataFrame) -> DataFrame:
    """As many rows, all null, of the same types."""
    return df.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields))


def empty_like(spark: SparkSession, schema: StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def null_of(t: DataType) -> Column:
    return F.lit(None).cast(t)
