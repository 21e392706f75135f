"""Permutations, sorting, nested and encoded columns, validation."""

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessel import errors
from tessel.operators import nested, permute, sort, validate
from tessel.operators.ordinal import RID, chunk_of, with_ordinal
from tessel.options import FilterOptions, Order, Placement, SortOptions


def numbers(spark, values, parts=1, kind="long"):
    """Rows (k, v) in order of k; spread over partitions in ranges, so that the order stays known."""
    df = spark.createDataFrame(list(enumerate(values)), f"k long, v {kind}")
    return df if parts == 1 else df.repartitionByRange(parts, "k")


def values(df, order="position"):
    return [r["v"] for r in df.orderBy(order).collect()]


@pytest.mark.parametrize("parts", [1, 3])
def test_take(spark, parts):
    df = numbers(spark, [10, 20, 30, 40, 50], parts)
    assert values(permute.take_list(df, [1, 2, 4, 0], ["k"])) == [20, 30, 50, 10]
    assert values(permute.take_list(df, [1, None, 1], ["k"])) == [20, None, 20]
    assert permute.take_list(df, [], ["k"]).count() == 0
    for bad in ([5], [-1], [0, None, 9]):
        with pytest.raises(errors.InvalidInput), errors.naming():
            permute.take_list(df, bad, ["k"]).collect()
    assert permute.element_at(df, 3, ["k"]).first()["v"] == 40


@pytest.mark.parametrize("parts", [1, 3])
def test_filter(spark, parts):
    df = numbers(spark, [1, 2, 3, 4, 5], parts).withColumn("p", F.element_at(F.array(*map(F.lit, [True, False, None, True, True])), (F.col("k") + 1).cast("int")))
    assert sorted(values(permute.filter_rows(df, F.col("p")), "k")) == [1, 4, 5]
    kept = permute.filter_rows(df, F.col("p"), FilterOptions(drop_nulls=False)).collect()
    assert sorted((r["v"] or 0) for r in kept) == [0, 1, 4, 5]
    assert [r for r in kept if r["v"] is None][0].asDict() == {"k": None, "v": None, "p": None}
    found = permute.selection_indices(df, F.col("p"), FilterOptions(drop_nulls=False), ["k"]).orderBy("rid").collect()
    assert [r["index"] for r in found] == [0, None, 3, 4]
    with pytest.raises(errors.InvalidInput):
        permute.filter_rows(df, F.col("v"))


def test_filter_of_any_type(spark):
    df = spark.createDataFrame([([7, 8], {"a": 1.5}, 2.5)], "l array<int>, m map<string,double>, d double")
    assert permute.filter_rows(df, F.lit(False)).count() == 0
    row = permute.filter_rows(df, F.lit(None).cast("boolean"), FilterOptions(drop_nulls=False)).first()
    assert tuple(row) == (None, None, None)


def test_choose(spark):
    df = spark.createDataFrame([(0, 10, 100), (1, 20, 200), (2, 30, 300)], "i int, a long, c long")
    pick = lambda **o: [r["value"] for r in permute.choose_from(df, "i", ["a", F.lit(99).cast("long"), "c"], **o).orderBy("a").collect()]
    assert pick() == [10, 99, 300]
    df = spark.createDataFrame([(0, 10, 1), (None, 20, 1), (1, 30, 1)], "i int, a long, c long")
    got = permute.choose_from(df, "i", ["a", F.lit(88).cast("long")], nullable=True).orderBy("a").collect()
    assert [r["value"] for r in got] == [10, None, 88]
    for bad, nullable in (("5", True), ("null", False)):
        with pytest.raises(errors.InvalidInput), errors.naming():
            permute.choose_from(df.selectExpr(f"cast({bad} as int) as i", "a"), "i", ["a"], nullable=nullable).collect()
    with pytest.raises(errors.InvalidArity):
        permute.choose(F.col("i"), [])
    with pytest.raises(errors.InvalidInput):
        permute.choose_from(df, "i", ["a", "i"])


def test_slice_and_concat(spark):
    df = numbers(spark, range(10), 3)
    assert sorted(values(permute.slice_rows(df, 3, 4, ["k"]), "k")) == [3, 4, 5, 6]
    assert permute.slice_rows(df, 10, 0, ["k"]).count() == 0
    for offset, n in ((8, 3), (-1, 2), (0, 11)):
        with pytest.raises(errors.SliceOutOfBounds):
            permute.slice_rows(df, offset, n)
    assert permute.slice_empty(df).schema == df.schema
    assert permute.concat([df, df]).count() == 20
    with pytest.raises(errors.InvalidInput):
        permute.concat([])
    with pytest.raises(errors.InvalidInput):
        permute.concat([df, df.withColumn("v", F.col("v").cast("int"))])
    with pytest.raises(errors.InvalidChunkType):
        permute.chunked([df, df.select("v", "k")])
    ordered = permute.concat_ordered([df, permute.slice_rows(df, 0, 2, ["k"])], ["k"]).orderBy("part", "rid").collect()
    assert [r["v"] for r in ordered] == [*range(10), 0, 1]
    assert permute.null_like(df).collect() == [(None, None)] * 10
    assert permute.empty_like(spark, df.schema).count() == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_ordinals_are_whole(spark, parts):
    data = random.Random(1).sample(range(10_000), 3000)
    df = spark.createDataFrame([(v,) for v in data], "v long").repartition(parts)
    got = with_ordinal(df, [F.col("v").desc()]).collect()
    assert {r[RID]: r["v"] for r in got} == dict(enumerate(sorted(data, reverse=True)))
    assert sorted(r[RID] for r in with_ordinal(df).collect()) == list(range(3000))
    assert with_ordinal(df.limit(0), ["v"]).count() == 0


def test_chunk_coordinates(spark):
    df = spark.createDataFrame([(0,), (2,), (3,), (6,)], "i long")
    assert [tuple(r) for r in chunk_of(df, [3, 0, 4], "i").collect()] == [(0, 0, 0), (2, 0, 2), (3, 2, 0), (6, 2, 3)]
    with pytest.raises(errors.InvalidInput), errors.naming():
        chunk_of(spark.createDataFrame([(7,)], "i long"), [3, 4], "i").collect()


NAN = float("nan")


@pytest.mark.parametrize("order", list(Order))
@pytest.mark.parametrize("nulls", list(Placement))
@pytest.mark.parametrize("nans", [None, *Placement])
def test_sort(spark, order, nulls, nans):
    data = [1.0, None, NAN, -2.0, 1.0, None, NAN, 5.0]
    df = numbers(spark, data, 1, "double")
    options = SortOptions(order, nulls, nans, stable=True)

    def key(item):
        k, v = item
        null = v is None
        odd = not null and math.isnan(v)
        first = null if nulls is Placement.AT_END else not null
        second = 0 if nans is None else odd if nans is Placement.AT_END else not odd
        size = 0 if null else (math.inf if odd else v)
        return first, second, size if order is Order.ASCENDING else -size, k

    want = [k for k, _ in sorted(enumerate(data), key=key)]
    assert [r["k"] for r in sort.sort(df, "v", options).collect()] == want
    found = sort.sort_indices(df, "v", options, ["k"]).orderBy("position").collect()
    assert [r["index"] for r in found] == want
    taken = permute.take(df, sort.sort_indices(df, "v", options, ["k"]), ["k"]).orderBy("position").collect()
    assert [r["k"] for r in taken] == want
    if not nans:
        assert len(sort.top(df, "v", 3, options).collect()) == 3


def test_dictionaries(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(["b", None, "a", "b", "c", "a"])], "k long, v string").repartition(3)
    encoded, words = nested.dictionary_encode(df, "v", "k")
    assert {r["index"]: r["value"] for r in words.collect()} == {0: "b", 1: "a", 2: "c"}
    assert [r["index"] for r in encoded.orderBy("k").collect()] == [0, None, 1, 0, 2, 1]
    assert sorted(nested.dictionary_decode(encoded, words, "index", "v").collect()) == sorted(df.collect())
    with pytest.raises(errors.IndexOutOfRange), errors.naming():
        nested.dictionary_decode(encoded, words.where("index < 2"), "index", "v").collect()
    assert [r["error"] for r in validate.index_violations(encoded, "index", words.where("index > 0"), ["k"]).collect()] == ["IndexOutOfRange"] * 2
    kind, rows = nested.emission(words.where("index < 2"), words)
    assert kind == "delta" and [r["value"] for r in rows.collect()] == ["c"]
    assert nested.apply_emission(words.where("index < 2"), kind, rows).count() == 3
    assert nested.emission(None, words)[0] == "full" and nested.emission(words, words)[0] == "skip"
    assert nested.emission(words, words.where("index < 2"))[0] == "full"
    with pytest.raises(errors.InvalidMetadata):
        nested.apply_emission(None, "delta", rows)


@pytest.mark.parametrize("parts", [1, 4])
def test_runs(spark, parts):
    df = spark.createDataFrame(list(enumerate([100, 100, 200, 200, 200, None, None, 100])), "k long, v long").repartition(parts)
    runs = nested.run_end_encode(df, "v", "k")
    assert [tuple(r) for r in runs.orderBy("run_end").collect()] == [(2, 100), (5, 200), (7, None), (8, 100)]
    assert [r["value"] for r in nested.run_end_decode(runs).orderBy("rid").collect()] == [100, 100, 200, 200, 200, None, None, 100]
    assert [r["value"] for r in nested.run_end_decode(runs, 3).orderBy("rid").collect()] == [100, 100, 200]
    assert nested.run_end_value(runs, 4).first()[0] == 200
    for call in (lambda: nested.run_end_value(runs, 8), lambda: nested.run_end_decode(runs, 9)):
        with pytest.raises(errors.InvalidRunEnds):
            call()
    bad = spark.createDataFrame([(0, 2), (1, 2), (2, 5)], "o long, run_end long")
    assert [r["o"] for r in validate.run_end_violations(bad, "o").collect()] == [1]
    assert nested.run_end_encode(df.limit(0), "v", "k").count() == 0


def test_nested_columns(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, None), (3, []), (4, [3])], "k long, l array<int>")
    assert [tuple(r) for r in nested.list_flatten(df, "l", ["k"]).orderBy("k", "position").collect()] == [(1, 0, 1), (1, 1, 2), (4, 0, 3)]
    assert [tuple(r) for r in nested.view_from_list(df, "l", ["k"]).orderBy("rid").collect()] == [(0, 0, 2), (1, 2, 0), (2, 2, 0), (3, 2, 1)]
    assert [r["value"] for r in nested.list_at(df, "l", 0, ["k"]).orderBy("position").collect()] == [1, 2]
    s = spark.createDataFrame([((10, "a"),), (None,)], "s struct<id:int,name:string>")
    parts = nested.split_struct(s, "s").select("`s.valid`", "`s.id`").collect()
    assert [tuple(r) for r in parts] == [(True, 10), (False, None)]
    e = spark.createDataFrame([([("k", 1), ("k", 2), (None, 3)],)], "e array<struct<key:string,value:int>>")
    assert e.select(nested.entries_value(F.col("e"), F.lit("k")), nested.entries_value(F.col("e"), F.lit(None).cast("string"))).first() == (1, 3)
    with pytest.raises(errors.InvalidEntriesType), errors.naming():
        e.select(nested.map_from_entries(F.col("e"))).collect()
    u = spark.createDataFrame([(9,)], "t int").select(nested.make_union(F.col("t"), {5: ("i", F.lit(1))}).alias("u"))
    with pytest.raises(errors.InvalidChildren), errors.naming():
        u.select(nested.union_value(F.col("u"), {5: "i"})).collect()


def test_validation(spark):
    df = spark.createDataFrame([(1, "a", [1, 2], bytearray(b"xy"), 5), (2, None, [1], bytearray(b"x"), 12345)], "k long, s string, l array<int>, b binary, n long")
    checks = [validate.non_null("s"), validate.list_length("l", 2), validate.byte_width("b", 2), validate.precision("n", 4, 0)]
    found = validate.violations(df, checks, ["k"]).collect()
    assert sorted(r["error"] for r in found) == ["BufferTooSmall", "InvalidChildLength", "InvalidInput", "NullInNonNullableField"]
    assert {r["k"] for r in found} == {2}
    with pytest.raises(errors.NullInNonNullableField):
        validate.check(df, checks[:1])
    validate.check(df.where("k = 1"), checks)
    views = spark.createDataFrame([(0, 2), (4, 2), (-1, 1)], "o long, n long")
    assert views.select(validate.view_bounds("o", "n", 5)[1]).collect() == [(False,), (True,), (True,)]
    entries = spark.createDataFrame([([("a", 1), ("a", 2)],)], "e array<struct<key:string,value:int>>")
    assert entries.select(validate.unique_keys("e")[1]).first()[0]
    u = spark.createDataFrame([((5, 1, None),), ((5, 1, "x"),), ((6, None, "x"),)], "u struct<type_id:tinyint,i:int,s:string>")
    assert [r[0] for r in u.select(validate.union_members("u", {5: "i", 7: "s"})[1]).collect()] == [False, True, True]
    validate.check_array(pa.array([1, 2, None]))
    broken = pa.ListArray.from_buffers(pa.list_(pa.int8()), 2, [None, pa.py_buffer(b"\x00\0\0\0\x05\0\0\0\x02\0\0\0")], children=[pa.array([1, 2], pa.int8())])
    with pytest.raises(errors.InvalidOffsets):
        validate.check_array(broken)
