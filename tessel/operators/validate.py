"""Logical validation: rows that a column's declared form doesn't allow."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from tessel.errors import named, translate
from tessel.operators import nested


def non_null(c: str) -> tuple[str, Column]:
    return "NullInNonNullableField", F.col(c).isNull()


def union_tags(c: str, tags: Sequence[int]) -> tuple[str, Column]:
    return "InvalidTypeId", ~F.coalesce(F.col(c)["type_id"].isin(*tags), F.lit(False))


def union_members(c: str, members: Mapping[int, str]) -> tuple[str, Column]:
    """Members other than the chosen one have to be unset."""
    extra = [F.col(c)[name].isNotNull() & (F.col(c)["type_id"] != code) for code, name in members.items()]
    return "InvalidChildren", F.coalesce(reduce(Column.__or__, extra), F.lit(False))


def list_length(c: str, n: int) -> tuple[str, Column]:
    return "InvalidChildLength", F.col(c).isNotNull() & (F.size(c) != n)


def byte_width(c: str, n: int) -> tuple[str, Column]:
    return "BufferTooSmall", F.col(c).isNotNull() & (F.octet_length(c) != n)


def precision(c: str, p: int, s: int) -> tuple[str, Column]:
    return "InvalidInput", F.col(c).isNotNull() & F.col(c).try_cast(DecimalType(p, s)).isNull()


def view_bounds(offset: str, size: str, length: int) -> tuple[str, Column]:
    o, s = F.col(offset), F.col(size)
    return "InvalidOffsets", (o < 0) | (s < 0) | (o + s > length)


def unique_keys(entries: str) -> tuple[str, Column]:
    keys = F.transform(F.col(entries), lambda e: e["key"])
    return "InvalidEntriesType", F.exists(keys, lambda k: k.isNull()) | (F.size(F.array_distinct(keys)) != F.size(keys))


def violations(df: DataFrame, checks: Sequence[tuple[str, Column]], keep: Sequence[str] = ()) -> DataFrame:
    """error and the kept columns, a row for every broken check of every row."""
    found = F.filter(F.array(*(F.when(bad, F.lit(name)) for name, bad in checks)), lambda e: e.isNotNull())
    return df.select(*keep, F.explode(found).alias("error"))


def index_violations(df: DataFrame, index: str, words: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Rows whose dictionary index the dictionary doesn't have."""
    lost = df.where(F.col(index).isNotNull()).join(words.select(F.col("index").alias("__i")), F.col(index) == F.col("__i"), "left_anti")
    return lost.select(*keep, F.lit("IndexOutOfRange").alias("error"))


def run_end_violations(runs: DataFrame, order: str) -> DataFrame:
    """Runs whose end isn't above the end before it, or above 0."""
    rows, ranges = nested._ranges(runs.select(F.col("run_end").alias("value"), F.col(order).alias("at")), ["at"])
    inner = Window.partitionBy("part").orderBy("local")
    before = F.coalesce(F.lag("value").over(inner), F.when(F.col("local") == 0, F.col("tail_before")), F.lit(0))
    seen = rows.join(F.broadcast(ranges), "part").select("at", "value", before.alias("before"))
    return seen.where(F.col("value") <= F.col("before")).select(F.col("at").alias(order), F.col("value").alias("run_end"), F.lit("InvalidRunEnds").alias("error"))


def check(df: DataFrame, checks: Sequence[tuple[str, Column]]) -> None:
    """Raises the named error of the first violation found."""
    found = violations(df, checks).limit(1).collect()
    if found:
        raise named(found[0]["error"])


def check_array(a: pa.Array, full: bool = True) -> None:
    """Layout checks of an Arrow array: buffers, offsets, children; with full also their contents and UTF-8."""
    try:
        a.validate(full=full)
    except pa.ArrowInvalid as error:
        text = str(error).lower()
        for words, name in (("run end", "InvalidRunEnds"), ("dictionary", "MissingDictionary"), ("offset", "InvalidOffsets"), ("null_count", "InvalidNullCount"), ("null count", "InvalidNullCount"), ("type code", "InvalidChildren"), ("type_id", "InvalidChildren"), ("union", "InvalidChildren"), ("child", "InvalidChildren"), ("buffer", "BufferTooSmall")):
            if words in text:
                raise named(name, str(error)) from error
        raise translate(error) from error
