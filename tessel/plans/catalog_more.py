"""Further registered queries: what works on small, fixed inputs, with their SQL as values."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.ipc as pa_ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType

from tessel import errors
from tessel.functions import kernels
from tessel.functions.datum import Datum, run_lengths
from tessel.functions.registry import Kind
from tessel.operators import nested, permute, sort
from tessel.options import ArithmeticOptions, CastOptions, NoOptions, Order, Placement, SortOptions
from tessel.plans.catalog import query, t
from tessel.schema import from_arrow
from tessel.sources import builders, interchange, ipc, tensors
from tessel.work import put, shared_dir


def _values(rows: str, columns: str) -> str:
    return f"SELECT * FROM (VALUES {rows}) v({columns})"


@query(_values("(0, 1), (1, 1), (2, 3)", "run, length"))
def chunk_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs in which neither of two misaligned chunkings has a border."""
    return spark.createDataFrame(list(enumerate(run_lengths([2, 3], [1, 4]))), "run int, length int")


@query(_values("('first', 5::bigint), ('second', 2::bigint)", "session, n_rows"))
def aggregate_sessions(spark, d):
    context, arg = kernels.context(), [Datum.literal(0, IntegerType())]
    a, b = context.begin("count_rows", arg), context.begin("count_rows", arg)
    a.update([1, 2, 3], arg)
    b.update([10, 20], arg)
    a.merge(b)
    return spark.createDataFrame([("first", a.finalize()), ("second", b.finalize())], "session string, n_rows long")


_CASES = {
    "divide by zero": ("divide_i64", (1, 0), ArithmeticOptions()),
    "divide lowest by -1": ("divide_i64", (-(2**63), -1), ArithmeticOptions()),
    "add beyond the highest": ("add_i64", (2**63 - 1, 1), ArithmeticOptions()),
    "cast out of range": ("cast_i64_to_i32", (2**31,), CastOptions()),
    "cast to a string": ("cast_i64_to_i32", (1,), CastOptions(to_type=StringType())),
    "unknown function": ("subtract_i64", (1, 2), NoOptions()),
    "too few arguments": ("add_i64", (1,), NoOptions()),
    "options of another family": ("add_i64", (1, 2), CastOptions()),
}


@query(
    _values(
        """('divide by zero', 'DivideByZero'), ('divide lowest by -1', 'Overflow'), ('add beyond the highest', 'Overflow'), ('cast out of range', 'InvalidCast'), ('cast to a string', 'InvalidCast'),
        ('unknown function', 'FunctionNotFound'), ('too few arguments', 'InvalidArity'), ('options of another family', 'InvalidOptions')""",
        '"case", error',
    )
)
def named_errors(spark, d):
    """The names under which calls fail, at plan time or when the plan runs."""
    rows = []
    for case, (name, values, options) in _CASES.items():
        df = spark.createDataFrame([values], ", ".join(f"a{k} long" for k in range(len(values))))
        try:
            with errors.naming():
                df.select(kernels.context().vector(name, [Datum.of(df, c) for c in df.columns], options)).collect()
            rows.append((case, None))
        except errors.TesselError as error:
            rows.append((case, error.name))
    return spark.createDataFrame(rows, "case string, error string")


@query(
    _values(
        """('add_i64', 1, 'no kernel matched exact arity'), ('add_i64', 2, 'kernel resolution should succeed'), ('add_i64', 3, 'no kernel matched exact arity'), ('subtract_i64', 2, 'function not found')""",
        "name, n_args, said",
    )
)
def registry_diagnostics(spark, d):
    r, arg = kernels.standard(), Datum.literal(0, LongType())
    rows = [(name, n, r.explain(name, Kind.VECTOR, [arg] * n)) for name, n in (("add_i64", 1), ("add_i64", 2), ("add_i64", 3), ("subtract_i64", 2))]
    return spark.createDataFrame(rows, "name string, n_args int, said string")


@query(
    _values(
        """(0::bigint, 255, 'red', 100, 'short', 5::tinyint, 100, NULL::boolean), (1::bigint, NULL, NULL, 100, NULL, 7::tinyint, NULL, true), (2::bigint, 1, 'red', 200, 'this string is longer than twelve', 5::tinyint, 200, NULL)""",
        "k, unsigned, word, run, view, tag, i, b",
    )
)
def encoded_columns_load(spark, d):
    """Unsigned, dictionary, run-end, view and union columns of an Arrow table."""
    union = builders.UnionBuilder(pa.union([pa.field("i", pa.int32()), pa.field("b", pa.bool_())], "dense", type_codes=[5, 7]))
    union.extend([(5, 100), (7, True), (5, 200)])
    runs = builders.RunEndBuilder(pa.int32(), pa.int32())
    runs.extend([(2, 100), (3, 200)])
    table = pa.table(
        {
            "k": pa.array([0, 1, 2]), "unsigned": pa.array([255, None, 1], pa.uint16()), "word": pa.array(["red", None, "red"]).dictionary_encode(), "run": runs.finish(),
            "view": pa.array(["short", None, "this string is longer than twelve"], pa.string_view()), "u": union.finish(),
        }
    )
    return from_arrow(spark, table).select("k", "unsigned", "word", "run", "view", F.col("u.type_id").alias("tag"), "u.i", "u.b")


def _stream(schema: pa.Schema, batches: list[pa.RecordBatch], file: bool = False, **options) -> bytes:
    sink = pa.BufferOutputStream()
    with (pa_ipc.new_file if file else pa_ipc.new_stream)(sink, schema, options=pa_ipc.IpcWriteOptions(**options)) as w:
        for b in batches:
            w.write_batch(b)
    return sink.getvalue().to_pybytes()


@query(_values("('red'), ('blue'), ('green')", "color"))
def ipc_dictionary_delta(spark, d):
    """A stream whose second batch adds to the dictionary of the first."""
    ipc.register(spark)
    schema = pa.schema([pa.field("color", pa.dictionary(pa.int32(), pa.string()), False)])
    one = pa.DictionaryArray.from_arrays(pa.array([0, 1], pa.int32()), pa.array(["red", "blue"]))
    two = pa.DictionaryArray.from_arrays(pa.array([2], pa.int32()), pa.array(["red", "blue", "green"]))
    data = _stream(schema, [pa.RecordBatch.from_arrays([a], schema=schema) for a in (one, two)], emit_dictionary_deltas=True)
    return spark.read.format("arrow_ipc").option("path", put(spark, "delta.arrows", data)).load()


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 10 OFFSET 10")
def ipc_batch_at(spark, d):
    """The second record batch of a file, by its number."""
    ipc.register(spark)
    path = f"{shared_dir(spark)}/ipc-batches"
    rows = t(spark, d, "nation").select("n_nationkey", "n_name").coalesce(1).sortWithinPartitions("n_nationkey")
    rows.write.format("arrow_ipc").mode("overwrite").options(container="file", batch_rows="10").option("path", path).save()
    return ipc.read_batch(spark, ipc.list_files(path)[0], 1)


@query(_values("(0, 'schema'), (1, 'dictionary'), (2, 'record batch')", "ordinal, kind"))
def ipc_messages(spark, d):
    table = pa.table({"a": [1, 2], "w": pa.array(["x", "y"]).dictionary_encode()})
    return ipc.messages(spark, put(spark, "messages.arrows", _stream(table.schema, table.to_batches()))).select("ordinal", "kind")


@query("SELECT 0 AS ordinal, i AS row, j AS col, (3 * i + j)::double AS value FROM range(2) a(i), range(3) b(j)")
def tensor_dense(spark, d):
    path = f"{shared_dir(spark)}/tensor.arrows"
    tensors.write_tensors(path, [pa.Tensor.from_numpy(np.arange(6, dtype=np.int32).reshape(2, 3), dim_names=["rows", "cols"])])
    return tensors.entries(tensors.read_tensors(spark, path)).select("ordinal", F.col("coords")[0].alias("row"), F.col("coords")[1].alias("col"), "value")


@query(_values("(1::bigint, 'a'), (2::bigint, NULL)", "id, name"))
def array_handover(spark, d):
    """A struct array taken over through the C data interface, its fields as columns."""
    return interchange.import_array(spark, pa.array([{"id": 1, "name": "a"}, {"id": 2, "name": None}]))


@query(
    """SELECT o AS "order", p AS placement, cast(row_number() OVER (PARTITION BY o, p ORDER BY (v IS NULL) = (p = 'at_start') DESC, CASE WHEN o = 'ascending' THEN v ELSE -v END, c_custkey) - 1 AS bigint) AS position, c_custkey
    FROM (SELECT c_custkey, nullif(cast(c_custkey % 10 AS bigint), 3) AS v FROM customer), (VALUES ('ascending'), ('descending')) x(o), (VALUES ('at_start'), ('at_end')) y(p)"""
)
def sort_null_placement(spark, d):
    """Both orders with both placements of nulls, which the order doesn't turn."""
    base = t(spark, d, "customer").select("c_custkey", F.nullif((F.col("c_custkey") % 10).cast("long"), F.lit(3).cast("long")).alias("v"))
    parts = []
    for order in Order:
        for placement in Placement:
            moved = sort.sort_indices(base, "v", SortOptions(order, placement), ["c_custkey"])
            taken = permute.take(base, moved, ["c_custkey"])
            parts.append(taken.select(F.lit(order.value).alias("order"), F.lit(placement.value).alias("placement"), "position", "c_custkey"))
    return permute.chunked(parts)


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS word, n_regionkey AS first FROM nation")
def struct_split_and_join(spark, d):
    """A struct's children beside its validity, and the struct made from them again."""
    s = nested.join_struct(F.col("n_nationkey") % 2 == 0, word=F.col("n_name"))
    df = t(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("first"), s.alias("s"))
    parts = nested.split_struct(df, "s")
    again = nested.join_struct(F.col("`s.valid`"), word=F.col("`s.word`"))
    return parts.select("n_nationkey", again["word"].alias("word"), "first")
