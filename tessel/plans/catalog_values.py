"""Registered queries of builders, registered functions, contexts, single messages and tensors, over tables.

Builders and messages hold their rows in the driver, so they take `nation`, whose size is fixed.
"""

from __future__ import annotations

from dataclasses import replace
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.ipc as pa_ipc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tessel import errors
from tessel.functions import kernels
from tessel.functions.datum import Datum, aligned_chunks, all_numeric, scalar_of
from tessel.functions.registry import Context, Kernel, Signature
from tessel.operators import validate
from tessel.options import CustomOptions, EngineConfig, OverflowMode
from tessel.plans.catalog import query, t
from tessel.schema import BatchBuilder, from_arrow
from tessel.sources import builders, ipc, tensors
from tessel.work import put, shared_dir


def _nation(spark: SparkSession, d: str) -> pa.Table:
    return t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").toArrow()


def _built(builder: builders.ColumnBuilder, values: list) -> pa.Array:
    builder.extend(values)
    return builder.finish()


@query(
    """SELECT cast(n_nationkey AS bigint) AS id, CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey % 2 = 0 END AS even, cast(n_nationkey AS double) / 4 AS quarter, CASE WHEN n_nationkey % 5 <> 0 THEN n_name END AS name,
    n_name AS large_name, n_name AS view, lower(hex(encode(n_name))) AS raw, lower(hex(encode(lpad(cast(n_nationkey AS varchar), 4, '0')))) AS fixed, cast(n_nationkey AS decimal(9, 2)) AS price, date '1970-01-01' + n_nationkey AS day FROM nation"""
)
def built_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns of plain types built value by value and set into a batch by name."""
    rows = _nation(spark, d).to_pylist()
    values = {
        "id": (pa.int64(), lambda k, name: k),
        "even": (pa.bool_(), lambda k, name: k % 2 == 0 if k % 3 else None),
        "quarter": (pa.float64(), lambda k, name: k / 4),
        "name": (pa.string(), lambda k, name: name if k % 5 else None),
        "large_name": (pa.large_string(), lambda k, name: name),
        "view": (pa.string_view(), lambda k, name: name),
        "raw": (pa.binary(), lambda k, name: name.encode()),
        "fixed": (pa.binary(4), lambda k, name: b"%04d" % k),
        "price": (pa.decimal128(9, 2), lambda k, name: Decimal(k)),
        "day": (pa.date32(), lambda k, name: k),
    }
    batch = BatchBuilder(spark, pa.schema([(name, kind) for name, (kind, _) in values.items()]))
    for name, (kind, value) in values.items():
        batch.set_column_by_name(name, _built(builders.ColumnBuilder(kind), [value(r["n_nationkey"], r["n_name"]) for r in rows]))
    return batch.finish().withColumns({c: F.lower(F.hex(c)) for c in ("raw", "fixed")})


@query(
    """SELECT n_nationkey AS id, n_nationkey % 3 AS n_list, CASE WHEN n_nationkey % 3 > 0 THEN n_name END AS first, n_nationkey + n_regionkey AS pair_sum, n_regionkey AS region, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS name,
    n_nationkey % 2 AS n_entries, CASE WHEN n_nationkey % 2 = 1 THEN n_regionkey END AS entry, n_nationkey // 2 AS view_first FROM nation"""
)
def built_nested(spark, d):
    """Lists, fixed lists, structs, maps and list views, read back by their parts."""
    rows = _nation(spark, d).to_pylist()
    struct = pa.struct([pa.field("region", pa.int32(), False), pa.field("name", pa.string())])
    keys = [(r["n_nationkey"], r["n_name"], r["n_regionkey"]) for r in rows]
    table = pa.table(
        {
            "id": _built(builders.ColumnBuilder(pa.int32()), [k for k, _, _ in keys]),
            "l": _built(builders.ColumnBuilder(pa.list_(pa.string())), [[name] * (k % 3) for k, name, _ in keys]),
            "p": _built(builders.ColumnBuilder(pa.list_(pa.int32(), 2)), [[k, region] for k, _, region in keys]),
            "s": _built(builders.ColumnBuilder(struct), [{"region": region, "name": None if k % 2 else name} for k, name, region in keys]),
            "m": _built(builders.ColumnBuilder(pa.map_(pa.string(), pa.int32())), [{name: region} if k % 2 else {} for k, name, region in keys]),
            "v": _built(builders.ListViewBuilder(pa.array([k for k, _, _ in keys], pa.int32())), [(k // 2, 1) for k, _, _ in keys]),
        }
    )
    return from_arrow(spark, table).select(
        "id", F.size("l").alias("n_list"), F.get("l", F.lit(0)).alias("first"), (F.col("p")[0] + F.col("p")[1]).alias("pair_sum"), "s.region", "s.name",
        F.size("m").alias("n_entries"), F.get(F.map_values("m"), F.lit(0)).alias("entry"), F.get("v", F.lit(0)).alias("view_first"),
    )


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 7 <> 0 THEN r_name END AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def built_dictionary(spark, d):
    """Indices into the names of regions, some of them null."""
    words = t(spark, d, "region").orderBy("r_regionkey").toArrow()["r_name"].combine_chunks()
    rows = _nation(spark, d).to_pylist()
    index = _built(builders.DictionaryBuilder(pa.int8(), words), [r["n_regionkey"] if r["n_nationkey"] % 7 else None for r in rows])
    return from_arrow(spark, pa.table({"id": pa.array([r["n_nationkey"] for r in rows], pa.int32()), "region": index}))


def _sum(context: Context, args: list[Datum], options) -> Column:
    out = args[0].column
    for a in args[1:]:
        out = out + a.column
    return out


def _scaled(context: Context, args: list[Datum], options: CustomOptions) -> Column:
    return args[0].column * options.payload


def _registered() -> Context:
    """A context with functions of a caller: three overloads of one name, and one with options of its own."""
    context = kernels.context()
    r = context.registry
    r.scalar("spread", Kernel(Signature.at_least(1, type_check=all_numeric), lambda c, args, o: _sum(c, args, o) * 100))
    r.scalar("spread", Kernel(Signature.range(2, 3, type_check=all_numeric), lambda c, args, o: _sum(c, args, o) * 10))
    r.scalar("spread", Kernel(Signature.binary(type_check=all_numeric), _sum))
    r.scalar("scaled", Kernel(Signature.unary(options_check=lambda o: isinstance(o, CustomOptions) and o.name == "scale"), _scaled))
    return context


@query(
    """SELECT l_orderkey, l_linenumber, l_orderkey * 100 AS one, l_orderkey + l_partkey AS two, (l_orderkey + l_partkey + l_suppkey) * 10 AS three, (2 * l_orderkey + l_partkey + l_suppkey) * 100 AS four, l_suppkey * 7 AS scaled FROM lineitem"""
)
def registered_functions(spark, d):
    """Overloads of 1 and more, 2 to 3, and exactly 2 arguments: the most specific that fits is used."""
    df, context = t(spark, d, "lineitem"), _registered()
    a, b, c = (Datum.of(df, name) for name in ("l_orderkey", "l_partkey", "l_suppkey"))
    calls = {"one": [a], "two": [a, b], "three": [a, b, c], "four": [a, b, c, a]}
    scaled = context.scalar("scaled", [c], CustomOptions("scale", 7))
    return df.select("l_orderkey", "l_linenumber", *(context.scalar("spread", args).alias(name) for name, args in calls.items()), scaled.alias("scaled"))


@query(
    """SELECT o_orderkey, cast(CASE WHEN o_orderkey > 100 THEN o_orderkey::hugeint + 9223372036854775707 - 18446744073709551616 ELSE o_orderkey + 9223372036854775707 END AS bigint) AS wrapping,
    cast(least(o_orderkey::hugeint + 9223372036854775707, 9223372036854775807) AS bigint) AS saturating, 2 * o_orderkey AS checked FROM orders"""
)
def context_defaults(spark, d):
    """Overflow as the context's defaults have it where a call gives no options."""
    df, base = t(spark, d, "orders"), kernels.context()
    key, near = Datum.of(df, "o_orderkey"), Datum.literal(2**63 - 101, LongType())

    def under(mode: OverflowMode) -> Context:
        return replace(base, config=EngineConfig(overflow_mode=mode))

    return df.select(
        "o_orderkey",
        under(OverflowMode.WRAPPING).vector("add_i64", [key, near]).alias("wrapping"),
        under(OverflowMode.SATURATING).vector("add_i64", [key, near]).alias("saturating"),
        under(OverflowMode.CHECKED).vector("add_i64", [key, key]).alias("checked"),
    )


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = (SELECT max(o_custkey) FROM orders)")
def scalar_extracted(spark, d):
    """The one value of an aggregate, as an argument of the next plan."""
    df = t(spark, d, "orders").select("o_orderkey", "o_custkey")
    return df.where(F.col("o_custkey") == scalar_of(df.agg(F.max("o_custkey"))))


@query("SELECT 'count_rows' AS name, true AS has_lifecycle, count(*) AS result FROM orders UNION ALL SELECT 'greatest', false, max(o_orderkey) FROM orders")
def lifecycle_support(spark, d):
    """Aggregates with and without a lifecycle; both can be called as a whole."""
    df, context = t(spark, d, "orders"), kernels.context()
    context.registry.aggregate("greatest", Kernel(Signature.unary(), lambda c, args, o: F.max(args[0].column)))
    args = [Datum.of(df, "o_orderkey")]
    names = ("count_rows", "greatest")
    whole = df.agg(*(context.aggregate(name, args).alias(name) for name in names))
    rows = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(context.supports_lifecycle(name, args)).alias("has_lifecycle"), F.col(name).alias("result")) for name in names))
    return whole.select(F.inline(rows))


@query("SELECT (n_nationkey // 5) * 5 + CASE WHEN n_nationkey % 5 > 2 THEN 3 ELSE 0 END AS begins, min(n_nationkey) AS first, sum(n_nationkey + n_regionkey)::bigint AS total FROM nation GROUP BY begins")
def chunk_aligned(spark, d):
    """Two columns in chunks of different lengths (3, 2, 3, 2, ... and 5, 5, ...), taken together run by run."""
    table = _nation(spark, d).combine_chunks()
    key, region = (table[c].combine_chunks() for c in ("n_nationkey", "n_regionkey"))
    short = pa.chunked_array([part for at in range(0, len(key), 5) for part in (key[at : at + 3], key[at + 3 : at + 5]) if len(part)], key.type)
    even = pa.chunked_array([region[at : at + 5] for at in range(0, len(region), 5)], region.type)
    rows = [(at, a[0].as_py(), sum(a.to_pylist()) + sum(b.to_pylist())) for at, (a, b) in aligned_chunks(short, even)]
    return spark.createDataFrame(rows, "begins int, first int, total long")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey BETWEEN 8 AND 15")
def ipc_message_decode(spark, d):
    """One record batch decoded from its own message, with a schema from the schema's message."""
    table = _nation(spark, d).select(["n_nationkey", "n_name"]).combine_chunks()
    batches = table.to_batches(max_chunksize=8)
    ipc.decode_schema(table.schema.serialize().to_pybytes())
    return ipc.decode_batch(spark, batches[1].serialize().to_pybytes(), table.schema)


_VALUES = "(VALUES ('cut file', 'InvalidFile'), ('no message', 'InvalidMessage'), ('cut batch', 'InvalidMetadata'), ('batch beyond the last', 'InvalidFile'), ('falling offsets', 'InvalidOffsets'), ('unknown type code', 'InvalidChildren'))"


@query(f'SELECT * FROM {_VALUES} v("case", error)')
def malformed_input(spark, d):
    """The names of what is wrong with damaged files, messages and arrays that hold a table's rows."""
    table = _nation(spark, d).combine_chunks()
    names = table["n_name"].combine_chunks().cast(pa.string())
    sink = pa.BufferOutputStream()
    with pa_ipc.new_file(sink, table.schema) as w:
        w.write_table(table)
    data = sink.getvalue().to_pybytes()
    message = table.to_batches()[0].serialize().to_pybytes()
    whole, cut = put(spark, "whole.arrow", data), put(spark, "cut.arrow", data[:-20])
    falling = pa.array([0, 9, 4, 12], pa.int32()).buffers()[1]
    tries = {
        "cut file": lambda: ipc.batch_count(cut),
        "no message": lambda: ipc.decode_schema(b"\x00" * 16),
        "cut batch": lambda: ipc.decode_batch(spark, message[: len(message) // 2], table.schema),
        "batch beyond the last": lambda: ipc.read_batch(spark, whole, 99),
        "falling offsets": lambda: validate.check_array(pa.Array.from_buffers(pa.list_(names.type), 3, [None, falling], children=[names])),
        "unknown type code": lambda: validate.check_array(pa.UnionArray.from_sparse(pa.array([9] * len(names), pa.int8()), [names], ["name"], [5])),
    }
    rows = []
    for case, attempt in tries.items():
        try:
            attempt()
            rows.append((case, None))
        except errors.TesselError as error:
            rows.append((case, error.name))
    return spark.createDataFrame(rows, "case string, error string")


@query("SELECT 1 AS ordinal, cast(n_nationkey AS bigint) AS row, c AS col, cast(CASE WHEN c = 0 THEN n_regionkey ELSE n_nationkey END AS double) AS value FROM nation, (VALUES (0::bigint), (1::bigint)) v(c)")
def tensor_by_index(spark, d):
    """The second of two tensors of a stream, by its number."""
    table = _nation(spark, d)
    key, region = (table[c].to_numpy().astype(np.int64) for c in ("n_nationkey", "n_regionkey"))
    path = f"{shared_dir(spark)}/two-tensors.arrows"
    tensors.write_tensors(path, [pa.Tensor.from_numpy(key), pa.Tensor.from_numpy(np.ascontiguousarray(np.stack([region, key], axis=1)))])
    found = tensors.entries(tensors.tensor_at(tensors.read_tensors(spark, path), 1))
    return found.select("ordinal", F.col("coords")[0].alias("row"), F.col("coords")[1].alias("col"), "value")
