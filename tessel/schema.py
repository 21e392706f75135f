"""Field look-up, projection and assembly over schemas and DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessel.errors import named
from tessel.types import loadable_table, spark_schema

#: Columns whose name occurred before get this between the name and a number.
AGAIN = "#"
ORIGINAL = "arrow:name"


def field_index(schema: StructType, name: str) -> int | None:
    """Case-sensitive; of equal names the first."""
    originals = [f.metadata.get(ORIGINAL, f.name) for f in schema.fields]
    return originals.index(name) if name in originals else None


def column(df: DataFrame, name: str) -> Column | None:
    """The first column of that name, or None."""
    at = field_index(df.schema, name)
    return None if at is None else F.col(_quoted(df.columns[at]))


def column_at(df: DataFrame, index: int) -> Column:
    if not 0 <= index < len(df.columns):
        raise named("IndexOutOfBounds", str(index))
    return F.col(_quoted(df.columns[index]))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def select(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns in the order asked for; a repeated name gives the column again under a numbered name."""
    at = []
    for name in names:
        if (k := field_index(df.schema, name)) is None:
            raise named("UnknownField", name)
        at.append(k)
    if not at:
        return df.select().where(F.lit(False))
    return project(df, at)


def project(df: DataFrame, indices: Sequence[int]) -> DataFrame:
    """Columns by position, nullability and metadata kept."""
    out, seen = [], {}
    for k in indices:
        if not 0 <= k < len(df.columns):
            raise named("IndexOutOfBounds", str(k))
        field = df.schema.fields[k]
        name = field.name
        n = seen[name] = seen.get(name, 0) + 1
        meta = dict(field.metadata)
        if n > 1:
            meta.setdefault(ORIGINAL, name)
            name = f"{name}{AGAIN}{n}"
        out.append(F.col(_quoted(field.name)).alias(name, metadata=meta))
    return df.select(*out)


def unique_names(names: Sequence[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for name in names:
        n = seen[name] = seen.get(name, 0) + 1
        out.append(name if n == 1 else f"{name}{AGAIN}{n}")
    return out


def from_arrow(spark: SparkSession, table: pa.Table) -> DataFrame:
    """A DataFrame of an Arrow table of any types, with its field metadata."""
    names = unique_names(table.schema.names)
    schema = spark_schema(table.schema)
    plain = loadable_table(table.rename_columns(names))
    df = spark.createDataFrame(plain, schema=StructType([type(f)(n, f.dataType, f.nullable) for n, f in zip(names, schema.fields)]))
    for name, field in zip(names, schema.fields):
        meta = dict(field.metadata) | ({ORIGINAL: field.name} if name != field.name else {})
        df = df.withMetadata(name, meta)
    return df


def assemble(spark: SparkSession, schema: pa.Schema, columns: Sequence[pa.Array]) -> DataFrame:
    """One batch from columns: their number, lengths, types and nulls have to fit the schema."""
    if len(columns) != len(schema):
        raise named("InvalidColumnCount", f"{len(columns)} for {len(schema)} fields")
    for field, c in zip(schema, columns):
        if len(c) != len(columns[0]):
            raise named("InvalidColumnLength", field.name)
        if not c.type.equals(field.type, check_metadata=True):
            raise named("InvalidColumnType", field.name)
        if not field.nullable and c.null_count:
            raise named("NullInNonNullableField", field.name)
    return from_arrow(spark, pa.Table.from_arrays(list(columns), schema=schema))


class BatchBuilder:
    """Sets columns by position or name, then finishes once; reset and clear open it again."""

    def __init__(self, spark: SparkSession, schema: pa.Schema):
        self.spark, self.schema = spark, schema
        self.reset()

    def reset(self) -> None:
        self._columns: dict[int, pa.Array] = {}
        self._finished = False

    clear = reset

    def set_column(self, index: int, values: pa.Array) -> None:
        if self._finished:
            raise named("AlreadyFinished")
        if not 0 <= index < len(self.schema):
            raise named("InvalidColumnIndex", str(index))
        if index in self._columns:
            raise named("ColumnAlreadySet", self.schema.field(index).name)
        self._columns[index] = values

    def set_column_by_name(self, name: str, values: pa.Array) -> None:
        if name not in self.schema.names:
            raise named("UnknownField", name)
        self.set_column(self.schema.names.index(name), values)

    def finish(self) -> DataFrame:
        if self._finished:
            raise named("AlreadyFinished")
        if missing := [f.name for k, f in enumerate(self.schema) if k not in self._columns]:
            raise named("MissingColumn", ", ".join(missing))
        out = assemble(self.spark, self.schema, [self._columns[k] for k in range(len(self.schema))])
        self._finished = True
        return out


def with_metadata(df: DataFrame, metadata: Mapping[str, Mapping[str, str]]) -> DataFrame:
    return reduce(lambda d, item: d.withMetadata(item[0], dict(item[1])), metadata.items(), df)


def same_schema(a: StructType, b: StructType, metadata: bool = False) -> bool:
    """Order, names, types and nullability; metadata if asked for."""
    if metadata:
        return a == b and [f.metadata for f in a] == [f.metadata for f in b]
    return [(f.name, f.dataType, f.nullable) for f in a] == [(f.name, f.dataType, f.nullable) for f in b]
