"""Lists, structs, maps, unions, dictionaries and run-end encoded columns.

Cases: null lists and structs give nulls or no elements, as each function says; repeated values are
one word of a dictionary and one run where they are neighbours; nulls are no words, and equal as
neighbours; empty tables give empty results; helper columns take names that the table doesn't have,
and a result name that it has already is InvalidInput.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.errors import marker, named
from tessel.operators.ordinal import RID, fresh, numbered_parts, unclaimed, with_ordinal
from tessel.operators.permute import element_at
from tessel.work import Written


def _raise(name: str, t: str) -> Column:
    return F.raise_error(F.lit(marker(name))).cast(t)


# Lists.
def list_value(c: Column, index: int) -> Column:
    """One element; beyond the list is null."""
    return F.get(c, F.lit(index))


def list_at(df: DataFrame, column: str, row: int, order_by: Sequence | None = None) -> DataFrame:
    """The elements of one row's list, in order, as rows (position, value)."""
    one = element_at(df.select(column, *(order_by or ())), row, order_by)
    return one.select(F.posexplode(column).alias("position", "value"))


def list_flatten(df: DataFrame, column: str, keep: Sequence[str] = ()) -> DataFrame:
    """All elements with their place: the child values, null and empty lists giving none."""
    kept = df.select(*keep)
    return df.select(*keep, F.posexplode(column).alias(unclaimed(kept, "position"), unclaimed(kept, "value")))


def list_slice(c: Column, offset: int, length: int) -> Column:
    return F.slice(c, offset + 1, length)


def list_from_view(values: Column, offset: Column, size: Column) -> Column:
    """A list from a view on shared values; views may overlap and stand in any order."""
    return F.slice(values, (offset + 1).cast("int"), size.cast("int"))


def view_from_list(df: DataFrame, column: str, order_by: Sequence | None = None) -> DataFrame:
    """rid, offset and size of every list in the flattened values; a null list has size 0."""
    sized = with_ordinal(df.select(column, *(order_by or ())), order_by).select(RID, F.coalesce(F.when(F.col(column).isNotNull(), F.size(column)), F.lit(0)).alias("size"))
    return prefix_sum(sized, RID, "size", "offset").select(F.col(RID).alias("rid"), "offset", "size")


def prefix_sum(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Sum of all values before each row in the order of a unique key, in two passes over ranges."""
    unclaimed(df, name)
    part, total, start = fresh(df, "__p", "__t", "__s")
    ranged = df.repartitionByRange(key).sortWithinPartitions(key).withColumn(part, F.spark_partition_id())
    ranged = Written(ranged, "ranged").df
    totals = ranged.groupBy(part).agg(F.sum(value).alias(total))
    starts = totals.select(part, F.coalesce(F.sum(total).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(start))
    inner = Window.partitionBy(part).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn(name, F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return local.join(F.broadcast(starts), part).withColumn(name, (F.col(name) + F.col(start)).cast("long")).drop(part, start)


# Structs.
def struct_field(c: Column, name: str, raw: Column | None = None) -> Column:
    """A field. Under a null parent it is null, unless the raw child column is kept beside the struct and given here."""
    return c.getField(name) if raw is None else raw


def split_struct(df: DataFrame, column: str) -> DataFrame:
    """A struct's validity and children as columns of their own, as the columnar layout has them."""
    fields = df.schema[column].dataType.fields
    return df.select("*", F.col(column).isNotNull().alias(f"{column}.valid"), *(F.col(column).getField(f.name).alias(f"{column}.{f.name}") for f in fields))


def join_struct(valid: Column, **children: Column) -> Column:
    """The struct of raw children, null where it isn't valid."""
    return F.when(valid, F.struct(*(c.alias(n) for n, c in children.items())))


# Maps. As arrays of entries they keep their order and any repeated or null keys.
def map_entries(c: Column) -> Column:
    return F.map_entries(c)


def entries_value(entries: Column, key: Column) -> Column:
    """The value of the first entry with the key; null keys match null."""
    return F.get(F.filter(entries, lambda e: e["key"].eqNullSafe(key)), F.lit(0))["value"]


def map_from_entries(entries: Column) -> Column:
    """A map of entries whose keys are unique and not null; others are InvalidEntriesType."""
    keys = F.transform(entries, lambda e: e["key"])
    bad = F.exists(keys, lambda k: k.isNull()) | (F.size(F.array_distinct(keys)) != F.size(keys))
    return F.map_from_entries(F.when(~bad, entries).otherwise(F.raise_error(F.lit(marker("InvalidEntriesType")))))


# Unions, as a tag and one member per type.
def make_union(type_id: Column, members: Mapping[int, tuple[str, Column]]) -> Column:
    """A tagged struct in which only the chosen member is set."""
    parts = [F.when(type_id == code, c).alias(name) for code, (name, c) in members.items()]
    return F.struct(type_id.cast("tinyint").alias("type_id"), *parts)


def union_value(c: Column, members: Mapping[int, str], to: str = "string") -> Column:
    """The chosen member as one type; an unknown tag is InvalidChildren."""
    tag, out = c["type_id"], None
    for code, name in members.items():
        out = (F if out is None else out).when(tag == code, c[name].cast(to))
    return out.otherwise(_raise("InvalidChildren", to))


def dense_union_value(type_id: Column, offset: Column, children: Mapping[int, Column], to: str = "string") -> Column:
    """The same for children kept as arrays, addressed by offset."""
    out = None
    for code, values in children.items():
        inside = (offset >= 0) & (offset < F.size(values))
        out = (F if out is None else out).when((type_id == code) & inside, F.get(values, offset).cast(to))
    return out.otherwise(_raise("InvalidChildren", to))


# Dictionaries: a table of (index, value), indices by first occurrence.
def dictionary_of(df: DataFrame, column: str, order: str) -> DataFrame:
    """index, value of every distinct value but null, numbered by the first row that has it."""
    first = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(order).alias("first"))
    return with_ordinal(first, ["first"], name="index").select("index", "value")


def dictionary_encode(df: DataFrame, column: str, order: str, name: str = "index") -> tuple[DataFrame, DataFrame]:
    """The table with indices in place of values, and the dictionary; nulls stay null.

    The join is left to Spark, which broadcasts a dictionary it measures as small.
    """
    words = dictionary_of(df, column, order)
    unclaimed(df.drop(column), name)
    index, word = fresh(df, "__index", "__word")
    encoded = df.join(words.select(F.col("index").alias(index), F.col("value").alias(word)), F.col(f"`{column}`") == F.col(word), "left")
    return encoded.drop(column, word).withColumnRenamed(index, name), words


def dictionary_decode(df: DataFrame, words: DataFrame, index: str, name: str) -> DataFrame:
    """Values in place of indices; an index that the dictionary doesn't have is IndexOutOfRange."""
    unclaimed(df.drop(index), name)
    at, word, out = fresh(df, "__w", "__v", "__out")
    joined = df.join(words.select(F.col("index").alias(at), F.col("value").alias(word)), F.col(f"`{index}`") == F.col(at), "left")
    t = words.schema["value"].dataType.simpleString()
    value = F.when(F.col(f"`{index}`").isNotNull() & F.col(at).isNull(), _raise("IndexOutOfRange", t)).otherwise(F.col(word))
    return joined.withColumn(out, value).drop(index, at, word).withColumnRenamed(out, name)


def emission(previous: DataFrame | None, current: DataFrame) -> tuple[str, DataFrame]:
    """What a stream sends for a dictionary after another: ("skip" | "delta" | "full", the rows to send).

    The same values: nothing. The same values and more behind them: those. Anything else: all. 0.0 and -0.0 differ,
    as their bytes do; all NaN are one value.
    """
    if previous is None:
        return "full", current
    p = previous.select(F.col("index").alias("pi"), F.col("value").alias("pv"))
    both = current.join(p, F.col("index") == F.col("pi"), "full")
    same = F.col("value").eqNullSafe(F.col("pv"))
    if current.schema["value"].dataType.typeName() in ("float", "double"):
        same &= F.col("value").cast("string").eqNullSafe(F.col("pv").cast("string"))
    differs = F.coalesce((F.col("index").isNotNull() & F.col("pi").isNotNull() & ~same) | F.col("index").isNull(), F.lit(False))
    found = both.agg(F.coalesce(F.max(differs), F.lit(False)).alias("differs"), F.count("index").alias("now"), F.count("pi").alias("before")).first()
    if found["differs"] or found["now"] < found["before"]:
        return "full", current
    if found["now"] == found["before"]:
        return "skip", current.where(F.lit(False))
    return "delta", current.where(F.col("index") >= found["before"])


def apply_emission(previous: DataFrame | None, kind: str, rows: DataFrame) -> DataFrame:
    """The dictionary after an emission; a delta needs one to add to."""
    if kind == "full":
        return rows
    if previous is None:
        raise named("InvalidMetadata", "a delta without a dictionary")
    return previous if kind == "skip" else previous.unionByName(rows)


# Run-end encoding: rows (run_end, value) in order.
def run_end_encode(df: DataFrame, column: str, order: str) -> DataFrame:
    """run_end (exclusive, from the first row), value of every run of equal values; nulls are equal.

    Rows are sorted into ranges, in each of which neighbours meet by a window; the last row of a
    range meets the first one of the next range by a table of a row for each range.
    """
    rows, starts = _ranges(df.select(F.col(column).alias("value"), F.col(order).alias("at")), ["at"])
    inner = Window.partitionBy("part").orderBy("local")
    seen = rows.select("part", "local", "value", F.lead("local").over(inner).isNull().alias("ends_range"), F.lead("value").over(inner).alias("next"))
    ends = seen.join(F.broadcast(starts), "part")
    differs = F.when(F.col("ends_range"), F.col("is_last") | ~F.col("value").eqNullSafe(F.col("head_after"))).otherwise(~F.col("value").eqNullSafe(F.col("next")))
    return ends.where(differs).select((F.col("start") + F.col("local") + 1).alias("run_end"), "value")


def _ranges(df: DataFrame, order_by: Sequence) -> tuple[DataFrame, DataFrame]:
    """Rows (part, local and the columns) in sorted ranges, and of each range start, head_before, head_after (values), is_last."""
    rows = numbered_parts(df, order_by, "part", "local")
    counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max_by("value", "local").alias("tail"), F.min_by("value", "local").alias("head"))
    by_part = Window.orderBy("part")
    start = F.coalesce(F.sum("n").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows, counts.select("part", start.alias("start"), F.lag("tail").over(by_part).alias("tail_before"), F.lead("head").over(by_part).alias("head_after"), F.lead("part").over(by_part).isNull().alias("is_last"))


#: Rows of a run that are spread out at once; longer runs go in pieces.
PIECE = 1 << 20


def _spread(spans: DataFrame, begin: str, end: str, name: str) -> DataFrame:
    """A row for every whole number from begin to before end, in place of those. Long spans are cut into pieces, which are dealt out."""
    piece, longest = fresh(spans, "__piece")[0], spans.agg(F.max(F.col(end) - F.col(begin))).first()[0] or 0
    cut = spans.where(F.col(end) > F.col(begin)).withColumn(piece, F.explode(F.sequence(F.col(begin), F.col(end) - 1, F.lit(PIECE).cast("long"))))
    if longest > PIECE:
        cut = cut.repartition(piece)
    return cut.withColumn(name, F.explode(F.sequence(F.col(piece), F.least(F.col(piece) + PIECE, F.col(end)) - 1))).drop(begin, end, piece)


def run_end_decode(runs: DataFrame, length: int | None = None) -> DataFrame:
    """rid, value of every row; rows beyond the last run are InvalidRunEnds."""
    rows, ranges = _ranges(runs.select(F.col("run_end").cast("long").alias("value"), F.col("value").alias("word")), ["value"])
    inner = Window.partitionBy("part").orderBy("local")
    before = F.coalesce(F.lag("value").over(inner), F.when(F.col("local") == 0, F.col("tail_before")), F.lit(0))
    spans = rows.join(F.broadcast(ranges), "part").select(before.alias("start"), F.col("value").alias("run_end"), F.col("word").alias("value"))
    if length is not None:
        if (runs.agg(F.max("run_end")).first()[0] or 0) < length:
            raise named("InvalidRunEnds", str(length))
        spans = spans.withColumn("run_end", F.least("run_end", F.lit(length).cast("long")))
    return _spread(spans, "start", "run_end", "rid").select("rid", "value")


def run_end_value(runs: DataFrame, index: int) -> DataFrame:
    """The value of one row: that of the first run that ends after it."""
    found = runs.where(F.col("run_end") > index).orderBy("run_end").limit(1).select("value")
    if index < 0 or found.isEmpty():
        raise named("InvalidRunEnds", str(index))
    return found
