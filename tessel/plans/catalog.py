"""Registered queries of the columnar operators, each with its counterpart in SQL."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from tessel import types
from tessel.functions import kernels
from tessel.functions.datum import Datum, align
from tessel.functions.registry import Lifecycle
from tessel.operators import aggregate, nested, permute, sort, validate
from tessel.operators.ordinal import RID, chunk_of, with_ordinal
from tessel.options import ArithmeticOptions, CastOptions, FilterOptions, Order, Placement, SortOptions
from tessel.schema import assemble, column, project, select
from tessel.sources import interchange, ipc, tensors
from tessel.work import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    from tessel.plans import catalog_more, catalog_values  # noqa: F401  register their own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter with emitted nulls, then a take by row number, over three projected columns."""
    orders = select(t(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"])
    kept = permute.filter_rows(orders, F.nullif("o_totalprice", F.lit(0.0)) > 1000.0, FilterOptions(drop_nulls=False))
    return permute.take_list(kept, [0, 5, 3, None, 3], ["o_orderkey"])


# Projection, slices, access.
@query("SELECT l_quantity, l_orderkey, l_tax FROM lineitem")
def project_by_name(spark, d):
    return select(t(spark, d, "lineitem"), ["l_quantity", "l_orderkey", "l_tax"])


@query('SELECT o_totalprice, o_orderkey, o_totalprice AS "o_totalprice#2" FROM orders')
def project_repeated(spark, d):
    return select(t(spark, d, "orders"), ["o_totalprice", "o_orderkey", "o_totalprice"])


@query("SELECT c_mktsegment, c_custkey FROM customer")
def project_by_index(spark, d):
    return project(t(spark, d, "customer"), [4, 0])


@query("SELECT s_name FROM supplier")
def column_by_name(spark, d):
    df = t(spark, d, "supplier")
    return df.select(column(df, "s_name"))


@query("SELECT event_id, user_id, value FROM events ORDER BY event_id LIMIT 50 OFFSET 100")
def slice_rows(spark, d):
    return permute.slice_rows(t(spark, d, "events").select("event_id", "user_id", "value"), 100, 50, ["event_id"])


@query("SELECT c_custkey, c_name FROM customer WHERE false")
def slice_empty(spark, d):
    return permute.slice_empty(t(spark, d, "customer").select("c_custkey", "c_name"))


@query("SELECT (SELECT count(*) FROM orders) AS n_rows, cast(6 AS int) AS n_columns")
def table_shape(spark, d):
    df = t(spark, d, "orders")
    return aggregate.count_rows(df).withColumn("n_columns", F.lit(len(df.columns)))


@query("SELECT cast(x AS bigint) AS id, ok FROM (VALUES (1, true), (2, NULL), (3, false)) v(x, ok)")
def batch_assemble(spark, d):
    schema = pa.schema([pa.field("id", pa.int64(), False), pa.field("ok", pa.bool_())])
    return assemble(spark, schema, [pa.array([1, 2, 3], pa.int64()), pa.array([True, None, False])])


@query("SELECT cast(row_number() OVER (ORDER BY o_orderkey) - 1 AS bigint) AS rid, o_orderkey FROM orders")
def row_ordinals(spark, d):
    return with_ordinal(t(spark, d, "orders").select("o_orderkey"), ["o_orderkey"]).withColumnRenamed(RID, "rid")


# Filters.
@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE nullif(l_quantity, 10.0) > 25.0")
def filter_drop_nulls(spark, d):
    df = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return permute.filter_rows(df, F.nullif("l_quantity", F.lit(10.0)) > 25.0)


@query(
    """SELECT CASE WHEN p THEN l_orderkey END AS l_orderkey, CASE WHEN p THEN l_quantity END AS l_quantity, CASE WHEN p THEN l_shipdate END AS l_shipdate
    FROM (SELECT *, nullif(l_quantity, 10.0) > 25.0 AS p FROM lineitem) WHERE p IS NULL OR p"""
)
def filter_emit_nulls(spark, d):
    df = t(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_shipdate")
    return permute.filter_rows(df, F.nullif("l_quantity", F.lit(10.0)) > 25.0, FilterOptions(drop_nulls=False))


@query(
    """SELECT rid, CASE WHEN p THEN rid END AS "index" FROM
    (SELECT cast(row_number() OVER (ORDER BY c_custkey) - 1 AS bigint) AS rid, nullif(c_mktsegment, 'BUILDING') < 'HOUSEHOLD' AS p FROM customer) WHERE p IS NULL OR p"""
)
def filter_selection_indices(spark, d):
    return permute.selection_indices(t(spark, d, "customer"), F.nullif("c_mktsegment", F.lit("BUILDING")) < "HOUSEHOLD", FilterOptions(drop_nulls=False), ["c_custkey"])


# Takes.
_NUMBERED = "(SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders)"


@query(f"SELECT cast(p AS bigint) AS position, o_orderkey, o_totalprice FROM (VALUES (0, 1), (1, 2), (2, 4), (3, 0), (4, 4)) v(p, i) JOIN {_NUMBERED} ON i = r")
def take(spark, d):
    return permute.take_list(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), [1, 2, 4, 0, 4], ["o_orderkey"])


@query(f"SELECT cast(p AS bigint) AS position, o_orderkey, o_totalprice FROM (VALUES (0, 3), (1, NULL), (2, 0)) v(p, i) LEFT JOIN {_NUMBERED} ON i = r")
def take_nullable(spark, d):
    return permute.take_list(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), [3, None, 0], ["o_orderkey"])


@query(
    f"""SELECT e AS position, o_orderkey FROM (SELECT event_id AS e, user_id % 500 AS i FROM events) JOIN {_NUMBERED} ON i = r"""
)
def take_by_table(spark, d):
    asked = t(spark, d, "events").select(F.col("event_id").alias("position"), (F.col("user_id") % 500).alias("index"))
    return permute.take(t(spark, d, "orders").select("o_orderkey"), asked, ["o_orderkey"])


@query("SELECT event_id AS position, 7.5::double AS value FROM events")
def take_scalar(spark, d):
    return permute.take_scalar(F.lit(7.5), t(spark, d, "events").select(F.col("event_id").alias("position"), F.col("user_id").alias("index")))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 1 OFFSET 17")
def element_at(spark, d):
    return permute.element_at(t(spark, d, "customer").select("c_custkey", "c_name"), 17, ["c_custkey"])


@query(
    """SELECT i AS "index", cast(CASE WHEN i < 400 THEN 0 WHEN i < 400 + 350 THEN 1 ELSE 2 END AS int) AS chunk, i - CASE WHEN i < 400 THEN 0 WHEN i < 750 THEN 400 ELSE 750 END AS "offset"
    FROM (SELECT c_custkey % 1000 AS i FROM customer)"""
)
def chunk_coordinates(spark, d):
    return chunk_of(t(spark, d, "customer").select((F.col("c_custkey") % 1000).alias("index")), [400, 350, 250], "index")


# Row-wise select.
@query("SELECT l_orderkey, l_linenumber, CASE cast(l_linenumber % 3 AS int) WHEN 0 THEN l_quantity WHEN 1 THEN l_extendedprice WHEN 2 THEN 99.0::double END AS value FROM lineitem")
def choose(spark, d):
    df = t(spark, d, "lineitem").withColumn("i", (F.col("l_linenumber") % 3).cast("int"))
    return permute.choose_from(df, "i", ["l_quantity", "l_extendedprice", F.lit(99.0)]).select("l_orderkey", "l_linenumber", "value")


@query("SELECT o_orderkey, CASE nullif(cast(o_orderkey % 3 AS int), 1) WHEN 0 THEN o_custkey WHEN 2 THEN 88::bigint END AS value FROM orders")
def choose_nullable(spark, d):
    df = t(spark, d, "orders").withColumn("i", F.nullif((F.col("o_orderkey") % 3).cast("int"), F.lit(1)))
    return permute.choose_from(df, "i", ["o_custkey", F.lit(0).cast("long"), F.lit(88).cast("long")], nullable=True).select("o_orderkey", "value")


# Concatenation.
@query("SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def concat(spark, d):
    return permute.concat([t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), t(spark, d, "region").select("r_regionkey", "r_name").toDF("k", "name")])


@query(
    """SELECT n_name AS name, cast(row_number() OVER (ORDER BY n_name) - 1 AS bigint) AS rid, cast(0 AS int) AS part FROM nation
    UNION ALL SELECT r_name, cast(row_number() OVER (ORDER BY r_name) - 1 AS bigint), cast(1 AS int) FROM region"""
)
def concat_ordered(spark, d):
    parts = [t(spark, d, "nation").select(F.col("n_name").alias("name")), t(spark, d, "region").select(F.col("r_name").alias("name"))]
    return permute.concat_ordered(parts, ["name"])


@query("SELECT a.o_orderkey, b.by_price FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) r FROM orders) a JOIN (SELECT o_orderkey AS by_price, row_number() OVER (ORDER BY o_totalprice, o_orderkey) r FROM orders) b USING (r)")
def align_tables(spark, d):
    """Two orders of a whole table."""
    left = t(spark, d, "orders").select("o_orderkey")
    right = t(spark, d, "orders").select(F.col("o_orderkey").alias("by_price"), F.col("o_totalprice"))
    return align(left, right, ["o_orderkey"], ["o_totalprice", "by_price"]).select("o_orderkey", "by_price")


# Functions through the registry.
def _call(df: DataFrame, name: str, args: list[str], options) -> F.Column:
    return kernels.context().vector(name, [Datum.of(df, a) for a in args], options)


@query("SELECT l_orderkey, l_linenumber, l_orderkey + cast(nullif(l_linenumber, 3) AS bigint) AS total FROM lineitem")
def add_null_propagate(spark, d):
    df = t(spark, d, "lineitem").withColumn("n", F.nullif("l_linenumber", F.lit(3)).cast("long"))
    return df.select("l_orderkey", "l_linenumber", _call(df, "add_i64", ["l_orderkey", "n"], ArithmeticOptions()).alias("total"))


_BIG = "9223372036854775807"


@query(f"SELECT o_orderkey, cast((({_BIG} - o_orderkey)::hugeint + o_custkey + 9223372036854775808::hugeint) % 18446744073709551616::hugeint - 9223372036854775808::hugeint AS bigint) AS total FROM orders")
def add_wrapping(spark, d):
    df = t(spark, d, "orders").withColumn("a", F.lit(int(_BIG)) - F.col("o_orderkey"))
    return df.select("o_orderkey", _call(df, "add_i64", ["a", "o_custkey"], ArithmeticOptions(check_overflow=False)).alias("total"))


@query(f"SELECT o_orderkey, cast(least(({_BIG} - o_orderkey)::hugeint + o_custkey, {_BIG}::hugeint) AS bigint) AS total FROM orders")
def add_saturating(spark, d):
    df = t(spark, d, "orders").withColumn("a", F.lit(int(_BIG)) - F.col("o_orderkey"))
    return df.select("o_orderkey", _call(df, "add_i64", ["a", "o_custkey"], ArithmeticOptions(check_overflow=False, saturate=True)).alias("total"))


@query("SELECT l_orderkey, l_linenumber, (l_orderkey - 30000) // cast(l_linenumber AS bigint) AS quotient FROM lineitem")
def divide_truncating(spark, d):
    df = t(spark, d, "lineitem").withColumns({"a": F.col("l_orderkey") - 30000, "b": F.col("l_linenumber").cast("long")})
    return df.select("l_orderkey", "l_linenumber", _call(df, "divide_i64", ["a", "b"], ArithmeticOptions()).alias("quotient"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 0::bigint ELSE l_orderkey // cast(l_linenumber % 2 AS bigint) END AS quotient FROM lineitem")
def divide_zero_relaxed(spark, d):
    df = t(spark, d, "lineitem").withColumn("b", (F.col("l_linenumber") % 2).cast("long"))
    return df.select("l_orderkey", "l_linenumber", _call(df, "divide_i64", ["l_orderkey", "b"], ArithmeticOptions(divide_by_zero_is_error=False)).alias("quotient"))


@query("SELECT o_orderkey, cast(o_custkey AS int) AS narrow FROM orders")
def cast_safe(spark, d):
    df = t(spark, d, "orders")
    return df.select("o_orderkey", _call(df, "cast_i64_to_i32", ["o_custkey"], CastOptions(to_type=IntegerType())).alias("narrow"))


@query("SELECT o_orderkey, cast(((o_orderkey * 1000003 + 2147483648) & 4294967295) - 2147483648 AS int) AS narrow FROM orders")
def cast_unsafe(spark, d):
    df = t(spark, d, "orders").withColumn("x", F.col("o_orderkey") * 1000003)
    return df.select("o_orderkey", _call(df, "cast_i64_to_i32", ["x"], CastOptions(safe=False)).alias("narrow"))


@query("SELECT o_orderkey, cast(o_orderkey % 100 AS smallint) AS narrow FROM orders")
def cast_checked(spark, d):
    return t(spark, d, "orders").select("o_orderkey", kernels.cast_checked(F.col("o_orderkey") % 100, "smallint").alias("narrow"))


@query("SELECT n_nationkey, n_regionkey AS same FROM nation")
def identity(spark, d):
    df = t(spark, d, "nation")
    return df.select("n_nationkey", kernels.context().vector("identity_i32", [Datum.of(df, "n_regionkey")]).alias("same"))


@query("SELECT * FROM (VALUES ('add_i64', 'vector', 1), ('divide_i64', 'vector', 1), ('cast_i64_to_i32', 'vector', 1), ('identity_i32', 'vector', 1), ('count_rows', 'aggregate', 1)) v(name, kind, kernels)")
def registry_functions(spark, d):
    r = kernels.standard()
    return spark.createDataFrame([(f.name, f.kind.value, len(f.kernels)) for f in r.all()], "name string, kind string, kernels int")


@query("SELECT * FROM (VALUES ('add_i64', 'kernel resolution should succeed', 'bigint'), ('cast_i64_to_i32', 'kernel resolution should succeed', 'int')) v(name, resolution, result_type)")
def registry_inference(spark, d):
    r = kernels.standard()
    df = t(spark, d, "orders")
    key = Datum.of(df, "o_orderkey")
    from tessel.functions.registry import Kind

    rows = [(n, r.explain(n, Kind.VECTOR, a), r.result_type(n, Kind.VECTOR, a).simpleString()) for n, a in (("add_i64", [key, key]), ("cast_i64_to_i32", [key]))]
    return spark.createDataFrame(rows, "name string, resolution string, result_type string")


# Aggregates.
@query("SELECT count(*) AS n_rows, count(nullif(l_linenumber, 1)) AS n_valid FROM lineitem")
def count_rows(spark, d):
    return t(spark, d, "lineitem").agg(kernels.context().aggregate("count_rows", [Datum.literal(0, LongType())]).alias("n_rows"), F.count(F.nullif("l_linenumber", F.lit(1))).alias("n_valid"))


@query("SELECT l_returnflag, count(*) AS n_rows FROM lineitem GROUP BY l_returnflag")
def count_rows_by_key(spark, d):
    return aggregate.count_rows(t(spark, d, "lineitem"), ["l_returnflag"])


@query("SELECT l_returnflag, l_linestatus, count(*) AS n_rows FROM lineitem GROUP BY ALL")
def lifecycle_count(spark, d):
    return aggregate.aggregate(t(spark, d, "lineitem"), kernels.COUNT_ROWS, "l_quantity", LongType(), ["l_returnflag", "l_linestatus"], "n_rows")


@query("SELECT o_orderpriority, cast(max(o_orderkey) - min(o_orderkey) AS bigint) AS spread FROM orders GROUP BY 1")
def lifecycle_custom(spark, d):
    spread = Lifecycle(init=lambda: None, update=_widen, merge=_join, finalize=lambda s: None if s is None else s[1] - s[0])
    return aggregate.aggregate(t(spark, d, "orders"), spread, "o_orderkey", LongType(), ["o_orderpriority"], "spread")


def _join(a, b):
    if a is None or b is None:
        return a or b
    return min(a[0], b[0]), max(a[1], b[1])


def _widen(state, values):
    found = pc.min_max(values).as_py()
    return state if found["min"] is None else _join(state, (found["min"], found["max"]))


@query("SELECT count(*) AS n_rows FROM events")
def lifecycle_global(spark, d):
    return aggregate.aggregate(t(spark, d, "events"), kernels.COUNT_ROWS, "value", LongType(), name="n_rows")


@query("SELECT cast(0 AS bigint) AS n_rows")
def lifecycle_empty(spark, d):
    """Without keys an empty table still has a result."""
    return aggregate.aggregate(permute.slice_empty(t(spark, d, "events")), kernels.COUNT_ROWS, "value", LongType(), name="n_rows")


@query("SELECT l_returnflag, count(*) AS n_rows FROM lineitem WHERE false GROUP BY 1")
def lifecycle_empty_by_key(spark, d):
    return aggregate.aggregate(permute.slice_empty(t(spark, d, "lineitem")), kernels.COUNT_ROWS, "l_quantity", LongType(), ["l_returnflag"], "n_rows")


# Sorting.
@query("SELECT c_custkey, cast(row_number() OVER (ORDER BY nullif(c_mktsegment, 'BUILDING') DESC NULLS LAST, c_custkey) - 1 AS bigint) AS position FROM customer")
def sort_nulls_last_desc(spark, d):
    df = t(spark, d, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"))
    keys = sort.sort_keys("seg", SortOptions(Order.DESCENDING, stable=True), F.col("c_custkey"))
    return with_ordinal(df, keys, "position").select("c_custkey", "position")


_NAN = "CASE WHEN event_id % 7 = 0 THEN 'NaN'::double WHEN event_id % 11 = 0 THEN NULL ELSE value END"


@query(f"SELECT event_id, cast(row_number() OVER (ORDER BY (v IS NULL) DESC, coalesce(isnan(v), false) DESC, v, event_id) - 1 AS bigint) AS position FROM (SELECT event_id, {_NAN} AS v FROM events)")
def sort_nan_at_start(spark, d):
    v = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(F.col("value"))
    df = t(spark, d, "events").select("event_id", v.alias("v"))
    keys = sort.sort_keys("v", SortOptions(null_placement=Placement.AT_START, nan_placement=Placement.AT_START, stable=True), F.col("event_id"))
    return with_ordinal(df, keys, "position").select("event_id", "position")


@query(
    """SELECT cast(row_number() OVER (ORDER BY nullif(o_orderpriority, '1-URGENT') DESC NULLS FIRST, r) - 1 AS bigint) AS position, r AS "index"
    FROM (SELECT o_orderpriority, cast(row_number() OVER (ORDER BY o_orderkey) - 1 AS bigint) AS r FROM orders)"""
)
def sort_indices(spark, d):
    df = t(spark, d, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("p"))
    return sort.sort_indices(df, "p", SortOptions(Order.DESCENDING, Placement.AT_START), ["o_orderkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(spark, d):
    return sort.top(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 25, SortOptions(Order.DESCENDING), ["o_orderkey"])


# Lists, structs, maps.
@query("SELECT vec_id, embedding[4] AS fourth, embedding[2:4] AS middle FROM embeddings")
def list_value(spark, d):
    e = F.col("embedding")
    return t(spark, d, "embeddings").select("vec_id", nested.list_value(e, 3).alias("fourth"), nested.list_slice(e, 1, 3).alias("middle"))


@query("SELECT vec_id, cast(unnest(range(len(embedding))) AS int) AS position, unnest(embedding) AS value FROM embeddings")
def list_flatten(spark, d):
    return nested.list_flatten(t(spark, d, "embeddings"), "embedding", ["vec_id"])


@query("SELECT cast(unnest(range(len(embedding))) AS int) AS position, unnest(embedding) AS value FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 1 OFFSET 12)")
def list_at_row(spark, d):
    return nested.list_at(t(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", 12, ["vec_id"])


@query("SELECT cast(row_number() OVER (ORDER BY doc_id) - 1 AS bigint) AS rid, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS \"offset\", cast(n AS int) AS size FROM (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents)")
def list_to_view(spark, d):
    df = t(spark, d, "documents").select("doc_id", F.split("text", " ").alias("words"))
    return nested.view_from_list(df, "words", ["doc_id"])


@query("SELECT vec_id, embedding[(vec_id % 60) + 1 : (vec_id % 60) + 3] AS part FROM embeddings")
def list_from_view(spark, d):
    return t(spark, d, "embeddings").select("vec_id", nested.list_from_view(F.col("embedding"), F.col("vec_id") % 60, F.lit(3)).alias("part"))


_PAIR = "CASE WHEN n_regionkey <> 2 THEN {'id': n_nationkey, 'name': n_name} END"


@query(f"SELECT n_nationkey, ({_PAIR}).name AS name FROM nation")
def struct_field(spark, d):
    pair = nested.join_struct(F.col("n_regionkey") != 2, id=F.col("n_nationkey"), name=F.col("n_name"))
    return t(spark, d, "nation").select("n_nationkey", nested.struct_field(pair, "name").alias("name"))


@query("SELECT n_nationkey, n_name AS name FROM nation")
def struct_field_raw(spark, d):
    """The child's own value, also below a null parent."""
    pair = nested.join_struct(F.col("n_regionkey") != 2, id=F.col("n_nationkey"), name=F.col("n_name"))
    return t(spark, d, "nation").select("n_nationkey", nested.struct_field(pair, "name", raw=F.col("n_name")).alias("name"))


@query("SELECT n_nationkey, map {'k': n_nationkey, 'r': n_regionkey}['r'] AS r, map_keys(map {'k': n_nationkey, 'r': n_regionkey}) AS keys FROM nation")
def map_value(spark, d):
    entries = F.array(*(F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in (("k", "n_nationkey"), ("r", "n_regionkey"))))
    m = nested.map_from_entries(entries)
    return t(spark, d, "nation").select("n_nationkey", nested.entries_value(entries, F.lit("r")).alias("r"), F.map_keys(m).alias("keys"))


@query("SELECT n_nationkey, unnest(['k', 'k']) AS key, unnest([n_nationkey, n_regionkey]) AS value FROM nation")
def map_entries(spark, d):
    """Entries in order, repeated keys included."""
    entries = F.array(*(F.struct(F.lit("k").alias("key"), F.col(c).alias("value")) for c in ("n_nationkey", "n_regionkey")))
    return t(spark, d, "nation").select("n_nationkey", F.inline(entries))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN cast(o_custkey AS varchar) ELSE cast(o_totalprice > 1000 AS varchar) END AS value FROM orders")
def union_value(spark, d):
    tag = F.when(F.col("o_orderkey") % 2 == 0, 5).otherwise(7)
    u = nested.make_union(tag, {5: ("i", F.col("o_custkey")), 7: ("b", F.col("o_totalprice") > 1000)})
    return t(spark, d, "orders").select("o_orderkey", u.alias("u")).select("o_orderkey", nested.union_value(F.col("u"), {5: "i", 7: "b"}).alias("value"))


@query("SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN cast([10, 20, 30][(vec_id % 3) + 1] AS varchar) ELSE ['a', 'b', 'c'][(vec_id % 3) + 1] END AS value FROM embeddings")
def union_dense_value(spark, d):
    tag, offset = (F.col("vec_id") % 2).cast("int"), (F.col("vec_id") % 3).cast("int")
    children = {0: F.array(*map(F.lit, (10, 20, 30))), 1: F.array(*map(F.lit, ("a", "b", "c")))}
    return t(spark, d, "embeddings").select("vec_id", nested.dense_union_value(tag, offset, children).alias("value"))


# Dictionaries and runs.
_WORDS = "(SELECT value, row_number() OVER (ORDER BY f) - 1 AS i FROM (SELECT event_type AS value, min(event_id) AS f FROM events WHERE event_type <> 'click' GROUP BY 1))"


@query(f"SELECT event_id, cast(i AS bigint) AS \"index\" FROM events LEFT JOIN {_WORDS} w ON event_type = w.value")
def dictionary_encode(spark, d):
    df = t(spark, d, "events").select("event_id", F.nullif("event_type", F.lit("click")).alias("event_type"))
    return nested.dictionary_encode(df, "event_type", "event_id")[0]


@query("SELECT event_id, nullif(event_type, 'click') AS event_type FROM events")
def dictionary_decode(spark, d):
    df = t(spark, d, "events").select("event_id", F.nullif("event_type", F.lit("click")).alias("event_type"))
    encoded, words = nested.dictionary_encode(df, "event_type", "event_id")
    return nested.dictionary_decode(encoded, words, "index", "event_type")


@query("SELECT * FROM (VALUES ('first', 'full', 25::bigint), ('same', 'skip', 0::bigint), ('longer', 'delta', 5::bigint), ('shorter', 'full', 20::bigint), ('other', 'full', 25::bigint)) v(step, kind, n_rows)")
def dictionary_emission(spark, d):
    words = with_ordinal(t(spark, d, "nation").select(F.col("n_name").alias("value")), ["value"], "index").select("index", "value")
    short = words.where("index < 20")
    steps = {"first": (None, words), "same": (words, words), "longer": (short, words), "shorter": (words, short), "other": (words.withColumn("value", F.upper(F.reverse("value"))), words)}
    rows = [(name, *((e := nested.emission(*pair))[0], e[1].count())) for name, pair in steps.items()]
    return spark.createDataFrame(rows, "step string, kind string, n_rows long")


_RUNS = """(SELECT n, event_type AS value, event_type IS DISTINCT FROM lead(event_type) OVER (ORDER BY n) OR lead(n) OVER (ORDER BY n) IS NULL AS last
    FROM (SELECT event_type, row_number() OVER (ORDER BY event_id) AS n FROM events))"""


@query(f"SELECT cast(n AS bigint) AS run_end, value FROM {_RUNS} WHERE last")
def run_end_encode(spark, d):
    return nested.run_end_encode(t(spark, d, "events"), "event_type", "event_id")


@query("SELECT cast(row_number() OVER (ORDER BY event_id) - 1 AS bigint) AS rid, event_type AS value FROM events")
def run_end_decode(spark, d):
    return nested.run_end_decode(nested.run_end_encode(t(spark, d, "events"), "event_type", "event_id"))


@query("SELECT event_type AS value FROM events ORDER BY event_id LIMIT 1 OFFSET 123")
def run_end_value(spark, d):
    return nested.run_end_value(nested.run_end_encode(t(spark, d, "events"), "event_type", "event_id"), 123)


# Typed nulls, validation, types.
@query("SELECT cast(NULL AS bigint) AS o_orderkey, cast(NULL AS double) AS o_totalprice FROM orders")
def null_like(spark, d):
    return permute.null_like(t(spark, d, "orders").select("o_orderkey", "o_totalprice"))


@query("SELECT o_orderkey, 'NullInNonNullableField' AS error FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'InvalidInput' FROM orders WHERE o_totalprice >= 100000")
def validate_rows(spark, d):
    df = t(spark, d, "orders").withColumn("s", F.nullif("o_orderstatus", F.lit("F")))
    return validate.violations(df, [validate.non_null("s"), ("InvalidInput", F.col("o_totalprice") >= 100000)], ["o_orderkey"])


@query("SELECT vec_id, 'InvalidChildLength' AS error FROM embeddings WHERE vec_id % 10 = 0 UNION ALL SELECT vec_id, 'InvalidTypeId' FROM embeddings WHERE vec_id % 4 = 3")
def validate_nested(spark, d):
    e = F.when(F.col("vec_id") % 10 == 0, F.slice("embedding", 1, 5)).otherwise(F.col("embedding"))
    df = t(spark, d, "embeddings").select("vec_id", e.alias("e"), F.struct((F.col("vec_id") % 4).cast("tinyint").alias("type_id")).alias("u"))
    return validate.violations(df, [validate.list_length("e", 64), validate.union_tags("u", [0, 1, 2])], ["vec_id"])


@query("SELECT event_id, 'IndexOutOfRange' AS error FROM events WHERE event_type = 'click'")
def validate_dictionary(spark, d):
    df = t(spark, d, "events").select("event_id", "event_type")
    encoded, words = nested.dictionary_encode(df, "event_type", "event_id")
    return validate.index_violations(encoded, "index", words.where("value <> 'click'"), ["event_id"])


@query("SELECT run_end, cast(run_end AS bigint) AS n, 'InvalidRunEnds' AS error FROM (SELECT event_id % 50 AS run_end, lag(event_id % 50) OVER (ORDER BY event_id) AS b, event_id FROM events) WHERE run_end <= coalesce(b, 0)")
def validate_run_ends(spark, d):
    runs = t(spark, d, "events").select("event_id", (F.col("event_id") % 50).alias("run_end"))
    return validate.run_end_violations(runs, "event_id").select("run_end", F.col("run_end").alias("n"), "error")


@query("SELECT cast(45 AS bigint) AS n_types, cast(44 AS bigint) AS greatest_id, cast(10 AS bigint) AS n_integer_or_floating_or_bool")
def type_catalogue(spark, d):
    df = spark.createDataFrame([(k.id, k.name, k.family, k.spark) for k in types.TYPES], "id int, name string, family string, spark string")
    return df.agg(F.count(F.lit(1)).alias("n_types"), F.max("id").cast("long").alias("greatest_id"), F.count(F.when(F.col("name").rlike("^(u?int(8|16|32|64)|bool|double)$"), 1)).alias("n_integer_or_floating_or_bool"))


# Interchange.
def _through_ipc(spark: SparkSession, df: DataFrame, name: str, **options: str) -> DataFrame:
    ipc.register(spark)
    path = f"{shared_dir(spark)}/ipc-{name}"
    df.write.format("arrow_ipc").mode("overwrite").options(**options).option("path", path).save()
    return spark.read.format("arrow_ipc").option("path", path).load()


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def ipc_file_roundtrip(spark, d):
    df = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    return _through_ipc(spark, df, "file", container="file", compression="zstd", batch_rows="4096")


@query("SELECT vec_id, embedding, label FROM embeddings")
def ipc_stream_roundtrip(spark, d):
    return _through_ipc(spark, t(spark, d, "embeddings"), "stream", container="stream", compression="lz4")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def stream_handover(spark, d):
    df = t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return interchange.import_stream(spark, interchange.export_stream(df))


@query("SELECT * FROM (VALUES (0, 0::bigint, 1::bigint, 2.0::double), (0, 1::bigint, 0::bigint, 3.0::double), (0, 1::bigint, 2::bigint, 4.0::double)) v(ordinal, row, col, value)")
def tensor_entries(spark, d):
    import numpy as np

    m = pa.SparseCSRMatrix.from_dense_numpy(np.array([[0.0, 2.0, 0.0], [3.0, 0.0, 4.0]]))
    found = tensors.entries(tensors.tensors(spark, [m]))
    return found.select("ordinal", F.col("coords")[0].alias("row"), F.col("coords")[1].alias("col"), "value")


