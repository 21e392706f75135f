"""Row numbers for unordered tables: the ground of slices and takes.

Cases: rows that tie in the order given are numbered in some order among themselves, so an order
that has to be the same every time needs a unique key; equal rows each get a number; nulls come
first, as in any ascending Spark sort; an empty table stays empty. Helper columns take names that
the table doesn't have; a result name that it has is InvalidInput.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.errors import named
from tessel.work import Written

RID = "__rid"
#: Rows that are numbered in one sorted prefix instead of over the whole table.
PREFIX = 100_000


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Names like the stems that no column of the table has, whatever its case."""
    used, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        while stem.lower() in used:
            stem = f"_{stem}"
        used.add(stem.lower())
        out.append(stem)
    return out


def unclaimed(df: DataFrame, name: str) -> str:
    """The name of a result column, which the table may not have yet."""
    if any(c.lower() == name.lower() for c in df.columns):
        raise named("InvalidInput", f"the table has a column {name} already")
    return name


def numbered_parts(df: DataFrame, order_by: Sequence[str | Column] | None, part: str, local: str) -> DataFrame:
    """The table written with each row's partition and its number therein.

    The order is that of the table or of a range partitioning. It is written, since a plan that
    runs twice may be partitioned otherwise the second time.
    """
    rows = df
    if order_by:
        keys = [F.col(c) if isinstance(c, str) else c for c in order_by]
        rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    # The upper bits of the id are the partition's number, the lower 33 count its rows.
    numbered = rows.withColumns({part: F.shiftright(at, 33).cast("int"), local: at.bitwiseAND(F.lit((1 << 33) - 1))})
    return Written(numbered, "numbered").df


def with_ordinal(df: DataFrame, order_by: Sequence[str | Column] | None = None, name: str = RID) -> DataFrame:
    """Adds the row number from 0, by the order given or else in the table's own order.

    In two passes: rows are numbered within their partition, and the counts of the partitions
    before are added. The counts are a row for each partition, so they are small whatever the
    table's size.
    """
    unclaimed(df, name)
    part, local, n, start = fresh(df, "__part", "__local", "__n", "__start")
    numbered = numbered_parts(df, order_by, part, local)
    counts = numbered.groupBy(part).agg(F.count(F.lit(1)).alias(n))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(part), F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    return numbered.join(F.broadcast(starts), part).withColumn(name, (F.col(start) + F.col(local)).cast("long")).drop(part, local, start)


def first_ordinals(df: DataFrame, wanted: int, order_by: Sequence[str | Column] | None = None, name: str = RID) -> DataFrame:
    """with_ordinal, but only the rows numbered below ``wanted``, at least.

    Up to PREFIX of them come from a sorted prefix: every partition sends its first ones, and
    neither the rest nor the columns of the rest are moved or written.
    """
    if wanted > PREFIX:
        return with_ordinal(df, order_by, name)
    unclaimed(df, name)
    if order_by:
        keys = [F.col(c) if isinstance(c, str) else c for c in order_by]
        head = df.orderBy(*keys).limit(max(wanted, 0))
        return head.withColumn(name, (F.row_number().over(Window.orderBy(*keys)) - 1).cast("long"))
    (at,) = fresh(df, "__at")
    # The ids ascend in the table's own order.
    head = df.withColumn(at, F.monotonically_increasing_id()).orderBy(at).limit(max(wanted, 0))
    return head.withColumn(name, (F.row_number().over(Window.orderBy(at)) - 1).cast("long")).drop(at)


def chunk_of(df: DataFrame, lengths: Sequence[int], index: str) -> DataFrame:
    """Adds chunk and offset of a logical row number, for chunks of the given lengths; out of range is InvalidInput."""
    from tessel.errors import marker

    ends, total = [], 0
    for n in lengths:
        total += n
        ends.append(total)
    bounds = F.array(*(F.lit(e) for e in ends)) if ends else F.array().cast("array<bigint>")
    chunk = F.size(F.filter(bounds, lambda e: e <= F.col(index)))
    starts = F.array(F.lit(0), *(F.lit(e) for e in ends))
    inside = (F.col(index) >= 0) & (F.col(index) < F.lit(total))
    bad = F.raise_error(F.lit(marker("InvalidInput"))).cast("int")
    return df.withColumn("chunk", F.when(inside | F.col(index).isNull(), chunk.cast("int")).otherwise(bad)).withColumn("offset", (F.col(index) - F.get(starts, "chunk")).cast("long"))
