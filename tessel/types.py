"""The 45 logical types, their Arrow and Spark forms, predicates and strict equality."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.types as pt
from pyspark.sql import types as T

from tessel.errors import named


@dataclass(frozen=True)
class LogicalType:
    id: int
    name: str
    family: str
    spark: str
    is_arrow: Callable[[pa.DataType], bool]
    bits: int | None = None


def _decimal(width: int) -> Callable[[pa.DataType], bool]:
    return lambda t: pt.is_decimal(t) and t.bit_width == width


def _union(mode: str) -> Callable[[pa.DataType], bool]:
    return lambda t: pt.is_union(t) and t.mode == mode


# Type ids and names of the columnar format, with the Spark type that holds each.
TYPES = [
    LogicalType(0, "null", "null", "void", pt.is_null),
    LogicalType(1, "bool", "bool", "boolean", pt.is_boolean, 1),
    LogicalType(2, "uint8", "integer", "smallint", pt.is_uint8, 8),
    LogicalType(3, "int8", "integer", "tinyint", pt.is_int8, 8),
    LogicalType(4, "uint16", "integer", "int", pt.is_uint16, 16),
    LogicalType(5, "int16", "integer", "smallint", pt.is_int16, 16),
    LogicalType(6, "uint32", "integer", "bigint", pt.is_uint32, 32),
    LogicalType(7, "int32", "integer", "int", pt.is_int32, 32),
    LogicalType(8, "uint64", "integer", "decimal(20,0)", pt.is_uint64, 64),
    LogicalType(9, "int64", "integer", "bigint", pt.is_int64, 64),
    LogicalType(10, "halffloat", "floating", "float", pt.is_float16, 16),
    LogicalType(11, "float", "floating", "float", pt.is_float32, 32),
    LogicalType(12, "double", "floating", "double", pt.is_float64, 64),
    LogicalType(13, "utf8", "string", "string", pt.is_string),
    LogicalType(14, "binary", "string", "binary", pt.is_binary),
    LogicalType(15, "fixed_size_binary", "string", "binary", lambda t: pt.is_fixed_size_binary(t) and not pt.is_decimal(t)),
    LogicalType(16, "date32", "temporal", "date", pt.is_date32, 32),
    LogicalType(17, "date64", "temporal", "date", pt.is_date64, 64),
    LogicalType(18, "timestamp", "temporal", "timestamp", pt.is_timestamp, 64),
    LogicalType(19, "time32", "temporal", "time(6)", pt.is_time32, 32),
    LogicalType(20, "time64", "temporal", "time(6)", pt.is_time64, 64),
    LogicalType(21, "month_interval", "temporal", "int", lambda t: False, 32),
    LogicalType(22, "day_time_interval", "temporal", "struct<days:int,ms:int>", lambda t: False, 64),
    LogicalType(23, "decimal128", "decimal", "decimal", _decimal(128), 128),
    LogicalType(24, "decimal256", "decimal", "decimal", _decimal(256), 256),
    LogicalType(25, "list", "nested", "array", pt.is_list),
    LogicalType(26, "struct", "nested", "struct", pt.is_struct),
    LogicalType(27, "sparse_union", "nested", "struct", _union("sparse")),
    LogicalType(28, "dense_union", "nested", "struct", _union("dense")),
    LogicalType(29, "dictionary", "encoded", "values", pt.is_dictionary),
    LogicalType(30, "map", "nested", "map", pt.is_map),
    LogicalType(31, "extension", "encoded", "storage", lambda t: isinstance(t, pa.BaseExtensionType)),
    LogicalType(32, "fixed_size_list", "nested", "array", pt.is_fixed_size_list),
    LogicalType(33, "duration", "temporal", "interval day to second", pt.is_duration, 64),
    LogicalType(34, "large_utf8", "string", "string", pt.is_large_string),
    LogicalType(35, "large_binary", "string", "binary", pt.is_large_binary),
    LogicalType(36, "large_list", "nested", "array", pt.is_large_list),
    LogicalType(37, "month_day_nano_interval", "temporal", "struct<months:int,days:int,nanos:bigint>", pt.is_interval, 128),
    LogicalType(38, "run_end_encoded", "encoded", "values", pt.is_run_end_encoded),
    LogicalType(39, "utf8_view", "string", "string", pt.is_string_view),
    LogicalType(40, "binary_view", "string", "binary", pt.is_binary_view),
    LogicalType(41, "list_view", "nested", "array", pt.is_list_view),
    LogicalType(42, "large_list_view", "nested", "array", pt.is_large_list_view),
    LogicalType(43, "decimal32", "decimal", "decimal", _decimal(32), 32),
    LogicalType(44, "decimal64", "decimal", "decimal", _decimal(64), 64),
]
BY_NAME = {t.name: t for t in TYPES}

INTERVAL = pa.struct([("months", pa.int32()), ("days", pa.int32()), ("nanos", pa.int64())])


def logical(t: pa.DataType) -> LogicalType:
    for kind in TYPES:
        if kind.is_arrow(t):
            return kind
    raise named("UnsupportedType", str(t))


def physical(t: pa.DataType) -> pa.DataType:
    """The type of the values behind dictionaries and extensions."""
    while True:
        if pt.is_dictionary(t):
            t = t.value_type
        elif isinstance(t, pa.BaseExtensionType):
            t = t.storage_type
        else:
            return t


def _family(*families: str) -> Callable[[pa.DataType], bool]:
    return lambda t: logical(physical(t)).family in families


is_integer = _family("integer")
is_floating = _family("floating")
is_decimal = _family("decimal")
is_numeric = _family("integer", "floating", "decimal")
is_string_like = _family("string")
is_temporal = _family("temporal")


def is_nested(t: pa.DataType) -> bool:
    """Doesn't look through encodings, and counts them as nested."""
    return logical(t).family in ("nested", "encoded")


def bit_width(t: pa.DataType) -> int | None:
    return logical(physical(t)).bits


def equal(a: pa.Field, b: pa.Field) -> bool:
    """Names, types with all parameters, nullability and metadata, at every depth."""
    return a.equals(b, check_metadata=True)


# Spark types: the same predicates, for columns of a DataFrame.
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def spark_is_integer(t: T.DataType) -> bool:
    return isinstance(t, _INTEGRAL)


def spark_is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def spark_equal(a: T.DataType, b: T.DataType) -> bool:
    """Strict: no width, precision, name or nullability may differ."""
    return a == b


# Arrow tables that Spark can't take as they are.
def loadable_type(t: pa.DataType) -> pa.DataType:
    """The type that Spark's Arrow reader takes in place of t."""
    kind = logical(t).name
    simple = {
        "uint8": pa.int16(), "uint16": pa.int32(), "uint32": pa.int64(), "uint64": pa.decimal128(20, 0), "halffloat": pa.float32(), "date64": pa.date32(), "time32": pa.time64("ns"),
        "utf8_view": pa.string(), "binary_view": pa.binary(), "large_utf8": pa.string(), "large_binary": pa.binary(), "fixed_size_binary": pa.binary(), "month_day_nano_interval": INTERVAL,
    }
    if kind in simple:
        return simple[kind]
    if kind == "dictionary":
        return loadable_type(t.value_type)
    if kind == "extension":
        return loadable_type(t.storage_type)
    if kind == "run_end_encoded":
        return loadable_type(t.value_type)
    if kind == "timestamp":
        return pa.timestamp("us", t.tz)
    if kind == "time64":
        return pa.time64("ns")
    if kind == "duration":
        return pa.duration("us")
    if kind == "decimal256":
        return pa.decimal128(t.precision, t.scale) if t.precision <= 38 else pa.string()
    if kind in ("decimal32", "decimal64"):
        return pa.decimal128(t.precision, t.scale)
    if kind in ("list", "large_list", "fixed_size_list", "list_view", "large_list_view"):
        return pa.list_(pa.field("element", loadable_type(t.value_type), t.value_field.nullable))
    if kind == "struct":
        return pa.struct([pa.field(t.field(k).name, loadable_type(t.field(k).type), t.field(k).nullable) for k in range(t.num_fields)])
    if kind == "map":
        return pa.map_(loadable_type(t.key_type), loadable_type(t.item_type))
    if kind in ("sparse_union", "dense_union"):
        return pa.struct([pa.field("type_id", pa.int8()), *(pa.field(t.field(k).name, loadable_type(t.field(k).type)) for k in range(t.num_fields))])
    return t


def loadable(a: pa.Array) -> pa.Array:
    """The same values in the type that Spark takes; encodings are resolved, unions become tagged structs."""
    t, to = a.type, loadable_type(a.type)
    kind = logical(t).name
    if kind == "dictionary":
        return loadable(a.dictionary_decode())
    if kind == "extension":
        return loadable(a.storage)
    if kind == "run_end_encoded":
        return loadable(pc.run_end_decode(a))
    if kind in ("sparse_union", "dense_union"):
        children = []
        codes = a.type_codes.to_numpy()
        for k, code in enumerate(t.type_codes):
            mine = pa.array(codes == code)
            child = a.field(k)
            if kind == "dense_union":
                child = child.take(pc.if_else(mine, a.offsets, pa.scalar(None, pa.int32())))
            children.append(pc.if_else(mine, loadable(child), pa.scalar(None, loadable_type(t.field(k).type))))
        return pa.StructArray.from_arrays([pa.array(codes, pa.int8()), *children], fields=list(to))
    if kind == "month_day_nano_interval":
        values = [None if v is None else {"months": v.months, "days": v.days, "nanos": v.nanoseconds} for v in a.to_pylist()]
        return pa.array(values, to)
    if kind == "duration" and t != to or kind == "timestamp" and t != to or kind == "time64" and t != to:
        return a.cast(to, safe=True)  # a remainder below a microsecond is an error
    if kind in ("list_view", "large_list_view", "fixed_size_list", "large_list", "list"):
        if t == to:
            return a
        lengths = pc.fill_null(pc.list_value_length(a), 0).to_numpy().astype(np.int64)
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        if kind in ("list_view", "large_list_view"):  # views may overlap and stand in any order
            within = np.arange(offsets[-1]) - np.repeat(offsets[:-1], lengths)
            children = a.values.take(pa.array(np.repeat(a.offsets.to_numpy().astype(np.int64), lengths) + within))
        else:
            children = a.flatten()  # without what lies under nulls
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), loadable(children), type=to, mask=a.is_null() if a.null_count else None)
    if kind == "struct" and t != to:
        mask = a.is_null()
        parts = [pc.if_else(mask, pa.scalar(None, to.field(k).type), loadable(a.field(k))) if a.null_count else loadable(a.field(k)) for k in range(t.num_fields)]
        return pa.StructArray.from_arrays(parts, fields=list(to), mask=mask if a.null_count else None)
    if kind == "decimal256" and t.precision > 38:
        return pa.array([None if v is None else str(v) for v in a.to_pylist()], pa.string())
    return a if t == to else a.cast(to)


def loadable_table(table: pa.Table) -> pa.Table:
    """A table that createDataFrame and a data source take; field names must be unique by now."""
    columns, fields = [], []
    for field, column in zip(table.schema, table.columns):
        to = loadable_type(field.type)
        chunks = [loadable(c) for c in column.chunks]
        columns.append(pa.chunked_array(chunks, to))
        fields.append(pa.field(field.name, to, field.nullable))
    return pa.table(columns, schema=pa.schema(fields))


def spark_schema(schema: pa.Schema) -> T.StructType:
    """Field names, types, nullability and metadata of an Arrow schema; what Spark lacks is noted in the metadata."""
    from pyspark.sql.pandas.types import from_arrow_type

    out = []
    for f in schema:
        notes = {k.decode(): v.decode("utf-8", "replace") for k, v in (f.metadata or {}).items()}
        kind = logical(f.type).name
        notes["arrow:type"] = kind
        if kind == "fixed_size_binary":
            notes["arrow:byte_width"] = str(f.type.byte_width)
        if kind == "fixed_size_list":
            notes["arrow:list_size"] = str(f.type.list_size)
        if kind == "extension" and getattr(f.type, "extension_name", None):
            notes["ARROW:extension:name"] = f.type.extension_name
        out.append(T.StructField(f.name, from_arrow_type(loadable_type(f.type), prefer_timestamp_ntz=True), f.nullable, notes))
    return T.StructType(out)
