"""Functions, their registry and the aggregate lifecycle."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType

from tessel import errors
from tessel.functions import datum, kernels
from tessel.functions.datum import Datum
from tessel.functions.registry import Arity, Context, Function, Kernel, Kind, Lifecycle, Registry, Signature
from tessel.operators import aggregate
from tessel.options import ArithmeticOptions, CastOptions, CustomOptions, EngineConfig, FilterOptions, NoOptions, Order, OverflowMode, Placement, SortOptions

LOW, HIGH = -(2**63), 2**63 - 1


def pairs(spark, lhs, rhs, parts=1):
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(lhs, rhs))], "k long, a long, b long").repartition(parts)


def run(df, name, args, options):
    c = kernels.context().vector(name, [Datum.of(df, a) for a in args], options)
    with errors.naming():
        return [r[1] for r in sorted(df.select("k", c.alias("v")).collect())]


@pytest.mark.parametrize("parts", [1, 4])
@pytest.mark.parametrize(
    "name, lhs, rhs, want",
    [
        ("add_i64", [1, 2, 3], [4, 5, 6], [5, 7, 9]),
        ("divide_i64", [8, 9, 10], [2, 3, 5], [4, 3, 2]),
        ("add_i64", [1, None, 3], [10, 20, None], [11, None, None]),
        ("divide_i64", [8, None, 10], [2, 3, 5], [4, None, 2]),
        ("add_i64", [1, None, 3, 4, 5], [10, 20, None, 40, 50], [11, None, None, 44, 55]),
        ("divide_i64", [-7, 7, LOW], [2, -2, 1], [-3, -3, LOW]),
    ],
)
def test_conformance(spark, parts, name, lhs, rhs, want):
    assert run(pairs(spark, lhs, rhs, parts), name, ["a", "b"], ArithmeticOptions()) == want


def test_scalars_broadcast(spark):
    df = pairs(spark, [1, None, 3, 4], [0] * 4)
    five = Datum.literal(5, LongType())
    got = df.select("k", kernels.context().vector("add_i64", [five, Datum.of(df, "a")], ArithmeticOptions()).alias("v"))
    assert [r[1] for r in sorted(got.collect())] == [6, None, 8, 9]
    ten = Datum.literal(10, LongType())
    df = pairs(spark, [20, 30, 40, 50], [0] * 4)
    got = df.select("k", kernels.context().vector("divide_i64", [Datum.of(df, "a"), ten], ArithmeticOptions()).alias("v"))
    assert [r[1] for r in sorted(got.collect())] == [2, 3, 4, 5]


def test_errors_have_names(spark):
    with pytest.raises(errors.DivideByZero):
        run(pairs(spark, [1, 2], [1, 0]), "divide_i64", ["a", "b"], ArithmeticOptions())
    with pytest.raises(errors.Overflow):
        run(pairs(spark, [HIGH], [1]), "add_i64", ["a", "b"], ArithmeticOptions())
    with pytest.raises(errors.Overflow):
        run(pairs(spark, [LOW], [-1]), "divide_i64", ["a", "b"], ArithmeticOptions())
    with pytest.raises(errors.InvalidCast):
        run(pairs(spark, [2147483648], [0]), "cast_i64_to_i32", ["a"], CastOptions())
    with pytest.raises(errors.InvalidCast):
        run(pairs(spark, [1], [0]), "cast_i64_to_i32", ["a"], CastOptions(to_type=StringType()))


def test_relaxed_forms(spark):
    loose = ArithmeticOptions(check_overflow=False, divide_by_zero_is_error=False)
    assert run(pairs(spark, [42, LOW, None], [0, -1, 0]), "divide_i64", ["a", "b"], loose) == [0, LOW, None]
    values = [HIGH, LOW, HIGH, -1, 2**40, None, LOW]
    others = [1, -1, HIGH, 1, -(2**41), 1, LOW]
    wrap = lambda x: (x + 2**63) % 2**64 - 2**63
    assert run(pairs(spark, values, others), "add_i64", ["a", "b"], loose) == [None if a is None else wrap(a + b) for a, b in zip(values, others)]
    clip = ArithmeticOptions(check_overflow=False, saturate=True)
    assert run(pairs(spark, values, others), "add_i64", ["a", "b"], clip) == [None if a is None else max(LOW, min(HIGH, a + b)) for a, b in zip(values, others)]


def test_casts(spark):
    edge = [2147483647, -2147483648, 0, None]
    assert run(pairs(spark, edge, edge), "cast_i64_to_i32", ["a"], CastOptions()) == edge
    assert run(pairs(spark, [2147483648, 4294967296, -2147483649], [0] * 3), "cast_i64_to_i32", ["a"], CastOptions(safe=False)) == [-2147483648, 0, 2147483647]
    df = pairs(spark, [127, None], [0, 0])
    assert [r[0] for r in df.orderBy("k").select(kernels.cast_checked(F.col("a"), "tinyint")).collect()] == [127, None]
    with pytest.raises(errors.InvalidCast), errors.naming():
        pairs(spark, [128], [0]).select(kernels.cast_checked(F.col("a"), "tinyint")).collect()


def test_context_defaults(spark):
    df = pairs(spark, [HIGH], [1])
    for mode, want in ((OverflowMode.WRAPPING, LOW), (OverflowMode.SATURATING, HIGH)):
        c = Context(kernels.standard(), EngineConfig(overflow_mode=mode)).vector("add_i64", [Datum.of(df, "a"), Datum.of(df, "b")])
        assert df.select(c).first()[0] == want


def test_option_defaults():
    assert (CastOptions().safe, CastOptions().to_type) == (True, None)
    assert (ArithmeticOptions().check_overflow, ArithmeticOptions().divide_by_zero_is_error) == (True, True)
    assert FilterOptions().drop_nulls
    assert SortOptions() == SortOptions(Order.ASCENDING, Placement.AT_END, None, False)
    assert [o.tag for o in (NoOptions(), CastOptions(), ArithmeticOptions(), FilterOptions(), SortOptions(), CustomOptions("x"))] == ["none", "cast", "arithmetic", "filter", "sort", "custom"]


def long(value=0):
    return Datum.literal(value, LongType())


def returning(value):
    return lambda context, args, options: value


def test_overloads_by_specificity():
    r = Registry()
    r.vector("f", Kernel(Signature.at_least(1), returning("least")))
    r.vector("f", Kernel(Signature.range(1, 3), returning("range")))
    r.vector("f", Kernel(Signature.any(2), returning("exact")))
    r.vector("f", Kernel(Signature.any(2), returning("later")))
    c = Context(r)
    assert [c.vector("f", [long()] * n) for n in (1, 2, 3, 4)] == ["range", "exact", "range", "least"]
    assert r.kernel_count("f", Kind.VECTOR) == 4
    assert [s.model for s in (Signature.any(1), Signature.range(1, 2), Signature.at_least(1))] == [Arity.EXACT, Arity.RANGE, Arity.AT_LEAST]


def test_kinds_are_name_spaces():
    r = Registry()
    r.scalar("f", Kernel(Signature.any(0, result_type=lambda a, o: LongType()), returning(1)))
    r.vector("f", Kernel(Signature.any(0, result_type=lambda a, o: LongType()), returning(2)))
    c = Context(r)
    assert (c.scalar("f", []), c.vector("f", [])) == (1, 2)
    assert r.function_count() == 2 and r.function_at(5) is None and r.function_at(0).name == "f"
    assert not r.contains("f", Kind.AGGREGATE)
    with pytest.raises(errors.FunctionNotFound):
        c.aggregate("f", [])


def test_failures_in_order_of_precedence():
    r = Registry()
    r.vector("f", Kernel(Signature.any(1, type_check=lambda a: isinstance(a[0].data_type, LongType), options_check=lambda o: isinstance(o, CastOptions)), returning(0)))
    text = Datum.literal("x", StringType())
    for args, options, error, said in (
        ([long(), long()], CastOptions(), errors.InvalidArity, "no kernel matched exact arity"),
        ([text], CastOptions(), errors.NoMatchingKernel, "no kernel matched argument types"),
        ([long()], NoOptions(), errors.InvalidOptions, "kernel matched args but options were invalid"),
    ):
        with pytest.raises(error):
            r.resolve("f", Kind.VECTOR, args, options)
        assert r.explain("f", Kind.VECTOR, args, options) == said
        assert r.explain_result_type("f", Kind.VECTOR, args, options) == said
    assert r.explain("f", Kind.VECTOR, [long()], CastOptions()) == "kernel resolution should succeed"
    assert r.explain_result_type("f", Kind.VECTOR, [long()], CastOptions()) == "result type inference should succeed"
    assert r.explain("g", Kind.VECTOR, []) == "function not found"
    assert r.explain_result_type("g", Kind.VECTOR, []) == "cannot infer result type: function not found"
    r._functions[Kind.VECTOR]["h"] = Function("h", Kind.VECTOR)
    assert r.explain("h", Kind.VECTOR, []) == "function has no registered kernels"
    for signature, n, said in ((Signature.at_least(2), 1, "no kernel matched minimum arity"), (Signature.range(2, 3), 4, "no kernel matched arity range")):
        one = Registry()
        one.vector("f", Kernel(signature, returning(0)))
        assert one.explain("f", Kind.VECTOR, [long()] * n) == said


def test_signatures_explain_themselves():
    s = Signature.any(1, type_check=lambda a: False)
    assert s.explain([]) == "arity mismatch: argument count does not match exact kernel arity"
    assert s.explain([long()]) == "type mismatch: arguments did not satisfy kernel type_check"
    assert Signature.at_least(1).explain([]) == "arity mismatch: argument count is below minimum kernel arity"
    assert Signature.range(1, 2).explain([]) == "arity mismatch: argument count is outside kernel arity range"
    assert Signature.any(0, options_check=lambda o: False).explain([]) == "options mismatch: options did not satisfy kernel options_check"
    assert Signature.any(0).explain([]) == "signature accepted"
    assert Signature.any(0).explain_inference([]) == "cannot infer result type: no arguments and no result_type_fn"
    with pytest.raises(errors.InvalidInput):
        Signature.any(0).infer([])
    assert Signature.unary().infer([long()]) == LongType()
    with pytest.raises(errors.InvalidInput):
        Registry().vector("f", Kernel(Signature.range(3, 2), returning(0)))


def test_argument_checks():
    a, b = Datum(F.lit(1), LongType(), length=3), Datum(F.lit(1), LongType(), length=4)
    assert datum.execution_length([long(), long()]) == 1
    assert datum.execution_length([a, long()]) == 3
    with pytest.raises(errors.InvalidInput):
        datum.execution_length([a, b])
    with pytest.raises(errors.InvalidArity):
        datum.execution_length([])
    assert datum.all_numeric([]) and datum.same_types([a])
    assert not datum.binary_same_numeric([a, Datum(F.lit(1), IntegerType())])
    assert datum.unary_column([a]) and datum.unary_scalar([long()]) and datum.unary_numeric([a]) and datum.has_arity([a], 1)
    assert datum.run_lengths([2, 3], [1, 4]) == [1, 1, 3]
    assert datum.run_lengths([2, 0, 3], [5], [1, 4]) == [1, 1, 3]
    with pytest.raises(errors.InvalidInput):
        datum.run_lengths([2], [3])


def test_null_propagation(spark):
    df = spark.createDataFrame([(1, 2), (None, 2), (1, None)], "a long, b long")
    c = datum.propagate_nulls([Datum.of(df, "a"), Datum.of(df, "b")], F.lit(7))
    assert [r[0] for r in df.select(c).collect()] == [7, None, None]


def test_scalar_of(spark):
    assert datum.scalar_of(spark.range(1).selectExpr("3 as x")) == 3
    with pytest.raises(errors.InvalidInput):
        datum.scalar_of(spark.range(2))


def test_aligned_tables(spark):
    a, b = spark.range(10).repartition(3), spark.range(10).selectExpr("id * 2 as twice").repartition(2)
    assert sorted(tuple(r) for r in datum.align(a, b, ["id"], ["twice"]).collect()) == [(k, 2 * k) for k in range(10)]
    with pytest.raises(errors.InvalidInput):
        datum.align(a, b.limit(3))


def test_sessions_merge(spark):
    c = kernels.context()
    a, b = c.begin("count_rows", [long()]), c.begin("count_rows", [long()])
    a.update([1, 2, 3], [long()])
    b.update([10, None])
    a.merge(b)
    assert a.finalize() == 5 and b.finalize() == 2
    with pytest.raises(errors.InvalidArity):
        a.update([1], [])
    other = aggregate.Session(Kernel(Signature.unary(), returning(0), kernels.COUNT_ROWS))
    with pytest.raises(errors.AggregateStateMismatch):
        a.merge(other)
    c.registry.aggregate("plain", Kernel(Signature.unary(), returning(0)))
    with pytest.raises(errors.MissingLifecycle):
        c.begin("plain", [long()])
    assert c.supports_lifecycle("count_rows", [long()]) and not c.supports_lifecycle("plain", [long()])


def test_lifecycle_over_a_table_with_a_hot_key(spark):
    rows = [("hot" if k % 3 else f"k{k}" if k % 2 else None, k if k % 5 else None) for k in range(3000)]
    df = spark.createDataFrame(rows, "key string, v long").repartition(7)
    total = Lifecycle(init=lambda: 0, update=lambda s, values: s + sum(v for v in values.to_pylist() if v is not None), merge=lambda a, b: a + b, finalize=lambda s: s)
    want = {}
    for key, v in rows:
        want[key] = want.get(key, 0) + (v or 0)
    got = aggregate.aggregate(df, total, "v", LongType(), ["key"], "total", spread=3).collect()
    assert {r["key"]: r["total"] for r in got} == want
    assert aggregate.aggregate(df, total, "v", LongType(), name="total").first()[0] == sum(want.values())
    assert aggregate.aggregate(df.limit(0), total, "v", LongType(), ["key"]).count() == 0
