"""Types, schemas, Arrow IPC, hand-over, tensors and streams."""

import datetime
import decimal
import os

import numpy as np
import pyarrow as pa
import pyarrow.ipc as ipc
import pytest
from pyspark.sql import functions as F

from tessel import errors, schema, types
from tessel.sources import interchange, tensors
from tessel.sources import ipc as source


def table():
    """One column for almost every type, three rows, the second null where that can be."""
    d = decimal.Decimal
    columns = {
        "u8": pa.array([1, None, 255], pa.uint8()),
        "u16": pa.array([1, None, 65535], pa.uint16()),
        "u32": pa.array([1, None, 2**32 - 1], pa.uint32()),
        "u64": pa.array([1, None, 2**64 - 1], pa.uint64()),
        "f16": pa.array([np.float16(0.5), None, np.float16(2)], pa.float16()),
        "d64": pa.array([datetime.date(2020, 1, 2), None, datetime.date(1969, 1, 1)], pa.date64()),
        "t32": pa.array([datetime.time(1, 2, 3), None, datetime.time(0)], pa.time32("ms")),
        "ts": pa.array([1, None, 2], pa.timestamp("ms")),
        "tz": pa.array([1_700_000_000_000, None, 2], pa.timestamp("ms", "UTC")),
        "dur": pa.array([1000, None, -5], pa.duration("ms")),
        "dec": pa.array([d("1.25"), None, d("-0.42")], pa.decimal128(10, 2)),
        "dec256": pa.array([d("1.25"), None, d("3.00")], pa.decimal256(20, 2)),
        "big": pa.array([d(10) ** 50, None, d(1)], pa.decimal256(60, 0)),
        "sv": pa.array(["short", None, "this string is longer than twelve"], pa.string_view()),
        "bv": pa.array([b"ab", None, b"xy"], pa.binary_view()),
        "fsb": pa.array([b"ab", None, b"xy"], pa.binary(2)),
        "ls": pa.array(["a", None, ""], pa.large_string()),
        "dict": pa.array(["red", None, "red"]).dictionary_encode(),
        "ree": pa.RunEndEncodedArray.from_arrays(pa.array([2, 3], pa.int32()), pa.array([100, 200], pa.int32())),
        "list": pa.array([[1, 2], None, [3]], pa.list_(pa.uint16())),
        "fsl": pa.array([[1, 2], None, [5, 6]], pa.list_(pa.int32(), 2)),
        "lv": pa.array([[1], None, [2, 3]], pa.list_view(pa.int32())),
        "struct": pa.array([{"a": 1, "b": "x"}, None, {"a": 3, "b": None}], pa.struct([("a", pa.uint8()), ("b", pa.string())])),
        "map": pa.array([[(1, 10), (2, 20)], None, [(3, 30)]], pa.map_(pa.int32(), pa.int32())),
        "union": pa.UnionArray.from_dense(pa.array([5, 7, 5], pa.int8()), pa.array([0, 0, 1], pa.int32()), [pa.array([100, 200]), pa.array([True])], ["i", "b"], [5, 7]),
        "nulls": pa.nulls(3),
    }
    return pa.table(columns)


WANT = {
    "u8": [1, None, 255], "u64": [1, None, 2**64 - 1], "f16": [0.5, None, 2.0], "d64": [datetime.date(2020, 1, 2), None, datetime.date(1969, 1, 1)],
    "dur": [datetime.timedelta(seconds=1), None, datetime.timedelta(milliseconds=-5)], "big": [str(10**50), None, "1"], "sv": ["short", None, "this string is longer than twelve"],
    "dict": ["red", None, "red"], "ree": [100, 100, 200], "list": [[1, 2], None, [3]], "fsl": [[1, 2], None, [5, 6]], "lv": [[1], None, [2, 3]],
    "struct": [(1, "x"), None, (3, None)], "map": [{1: 10, 2: 20}, None, {3: 30}], "union": [(5, 100, None), (7, None, True), (5, 200, None)], "nulls": [None] * 3,
}


def test_every_type_has_an_entry():
    assert [t.id for t in types.TYPES] == list(range(45))
    assert len(types.BY_NAME) == 45
    for field in table().schema:
        assert types.logical(field.type).name in types.BY_NAME


def test_any_arrow_table_loads(spark):
    df = schema.from_arrow(spark, table())
    rows = df.collect()
    for name, want in WANT.items():
        got = [r[name] for r in rows]
        assert [tuple(v) if hasattr(v, "asDict") else v for v in got] == want, name
    assert dict(df.dtypes)["u32"] == "bigint" and dict(df.dtypes)["u64"] == "decimal(20,0)" and dict(df.dtypes)["ts"] == "timestamp_ntz"
    assert df.schema["fsb"].metadata["arrow:byte_width"] == "2" and df.schema["fsl"].metadata["arrow:list_size"] == "2"


def test_lossy_units_are_errors(spark):
    with pytest.raises(pa.ArrowInvalid):
        schema.from_arrow(spark, pa.table({"d": pa.array([1], pa.duration("ns"))}))


def test_predicates_and_equality():
    d = pa.dictionary(pa.int32(), pa.uint8())
    assert types.is_integer(d) and types.is_numeric(d) and not types.is_floating(d) and types.bit_width(d) == 8
    assert types.is_nested(d) and types.is_nested(pa.list_(pa.int8())) and not types.is_nested(pa.int8())
    assert types.is_string_like(pa.binary(3)) and types.is_temporal(pa.duration("s")) and types.is_decimal(pa.decimal64(9, 1))
    assert types.equal(pa.field("a", pa.int8()), pa.field("a", pa.int8()))
    for other in (pa.field("b", pa.int8()), pa.field("a", pa.int16()), pa.field("a", pa.int8(), False), pa.field("a", pa.int8(), metadata={"x": "y"})):
        assert not types.equal(pa.field("a", pa.int8()), other)


def test_schema_access(spark):
    t = pa.Table.from_arrays([pa.array([1]), pa.array([2]), pa.array([3])], schema=pa.schema([pa.field("a", pa.int64(), metadata={"z": "9"}), pa.field("A", pa.int64()), pa.field("a", pa.int64())]))
    df = schema.from_arrow(spark, t)
    assert df.columns == ["a", "A", "a#2"] and df.schema["a"].metadata["z"] == "9"
    assert df.select(schema.column(df, "a"), schema.column(df, "A")).first() == (1, 2)
    assert schema.column(df, "b") is None and schema.field_index(df.schema, "A") == 1
    assert schema.select(df, ["A", "a"]).first() == (2, 1)
    assert schema.project(df, [2, 0]).schema["a"].metadata["z"] == "9"
    assert schema.select(df, []).count() == 0
    with pytest.raises(errors.UnknownField):
        schema.select(df, ["b"])
    with pytest.raises(errors.IndexOutOfBounds):
        schema.project(df, [3])
    with pytest.raises(errors.IndexOutOfBounds):
        schema.column_at(df, -1)
    assert schema.same_schema(df.schema, df.schema, metadata=True)


def test_batches_are_checked(spark):
    s = pa.schema([pa.field("id", pa.int32(), False), pa.field("ok", pa.bool_(), False)])
    good = [pa.array([1, 2], pa.int32()), pa.array([True, False])]
    assert schema.assemble(spark, s, good).count() == 2
    for columns, error in (
        (good[:1], errors.InvalidColumnCount),
        ([good[0], pa.array([True])], errors.InvalidColumnLength),
        ([good[0], pa.array([1, 2])], errors.InvalidColumnType),
        ([pa.array([1, None], pa.int32()), good[1]], errors.NullInNonNullableField),
    ):
        with pytest.raises(error):
            schema.assemble(spark, s, columns)
    b = schema.BatchBuilder(spark, s)
    b.set_column(0, good[0])
    for call, error in ((lambda: b.set_column(0, good[0]), errors.ColumnAlreadySet), (lambda: b.set_column(2, good[0]), errors.InvalidColumnIndex), (lambda: b.set_column_by_name("x", good[0]), errors.UnknownField), (b.finish, errors.MissingColumn)):
        with pytest.raises(error):
            call()
    b.set_column_by_name("ok", good[1])
    assert b.finish().count() == 2
    for call in (b.finish, lambda: b.set_column(0, good[0])):
        with pytest.raises(errors.AlreadyFinished):
            call()
    b.reset()
    b.set_column(0, good[0])


@pytest.mark.parametrize("container", ["file", "stream"])
@pytest.mark.parametrize("compression", ["none", "zstd", "lz4"])
def test_ipc_round_trip(spark, tmp_path, container, compression):
    source.register(spark)
    df = spark.range(1000).selectExpr("id", "if(id % 3 = 0, null, concat('s', id)) as s", "array(id, id + 1) as l").repartition(3)
    path = str(tmp_path / "out")
    df.write.format("arrow_ipc").mode("overwrite").options(container=container, compression=compression, batch_rows="100").option("path", path).save()
    back = spark.read.format("arrow_ipc").option("path", path).load()
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(back.collect()) == sorted(df.collect())
    assert back.rdd.getNumPartitions() == (12 if container == "file" else 3)
    only = spark.read.format("arrow_ipc").option("path", path).option("columns", "s").load()
    assert only.columns == ["s"] and only.count() == 1000
    df.limit(5).write.format("arrow_ipc").mode("overwrite").option("path", path).save()
    assert spark.read.format("arrow_ipc").option("path", path).load().count() == 5
    df.limit(5).write.format("arrow_ipc").mode("append").option("path", path).save()
    assert spark.read.format("arrow_ipc").option("path", path).load().count() == 10


def test_ipc_of_any_type_and_batches(spark, tmp_path):
    source.register(spark)
    path = str(tmp_path / "all.arrow")
    t = table()
    with ipc.new_file(path, t.schema) as w:
        w.write_table(t)
        w.write_table(t.slice(0, 1))
    rows = spark.read.format("arrow_ipc").option("path", path).load().collect()
    assert len(rows) == 4 and [r["ree"] for r in rows].count(100) == 3
    assert source.batch_count(path) == 2
    assert len(source.read_batch(spark, path, 1).collect()) == 1
    with pytest.raises(errors.InvalidFile):
        source.read_batch(spark, path, 2)


def test_dictionary_deltas(spark, tmp_path):
    source.register(spark)
    path = str(tmp_path / "d.arrows")
    s = pa.schema([pa.field("color", pa.dictionary(pa.int32(), pa.string()), False)])
    one = pa.DictionaryArray.from_arrays(pa.array([0, 1], pa.int32()), pa.array(["red", "blue"]))
    two = pa.DictionaryArray.from_arrays(pa.array([2], pa.int32()), pa.array(["red", "blue", "green"]))
    with ipc.new_stream(path, s, options=ipc.IpcWriteOptions(emit_dictionary_deltas=True)) as w:
        for a in (one, two):
            w.write_batch(pa.RecordBatch.from_arrays([a], schema=s))
    assert [r[0] for r in spark.read.format("arrow_ipc").option("path", path).load().collect()] == ["red", "blue", "green"]


def test_malformed_input_has_names(spark, tmp_path):
    for name, data, error in (("a.arrow", b"ARROW1\0\0garbage", errors.InvalidFile), ("b.arrows", b"\x05garbage", errors.InvalidMessage)):
        (tmp_path / name).write_bytes(data)
        fs, p = source.file_system(str(tmp_path / name))
        with pytest.raises(error):
            source.open_reader(fs, p, "auto")
    with pytest.raises(errors.InvalidFile):
        source.list_files(str(tmp_path / "missing"))


def test_hand_over(spark):
    df = spark.range(50).selectExpr("id", "cast(id as string) as s").repartition(3)
    handed = interchange.export_stream(df, rows=7)
    assert sorted(interchange.import_stream(spark, handed).collect()) == sorted(df.collect())
    with pytest.raises(errors.Released):
        handed.reader()
    t = pa.table({"x": [1, 2]})
    assert interchange.import_stream(spark, t, pa.schema([("x", pa.int64())])).count() == 2
    with pytest.raises(errors.SchemaMismatch):
        interchange.import_stream(spark, t, pa.schema([("x", pa.int32())]))
    assert interchange.import_array(spark, pa.array([{"a": 1}, {"a": 2}])).columns == ["a"]
    assert interchange.import_array(spark, pa.array([1, 2])).columns == ["value"]
    assert interchange.import_schema(t.schema) == t.schema
    with pytest.raises(errors.TopLevelSchemaMustBeStruct):
        interchange.import_schema(pa.int32())
    assert interchange.export_arrow(df).num_rows == 50


def test_tensors(spark, tmp_path):
    dense = np.arange(6, dtype=np.int32).reshape(2, 3)
    path = str(tmp_path / "t.arrows")
    tensors.write_tensors(path, [pa.Tensor.from_numpy(dense, dim_names=["rows", "cols"]), pa.Tensor.from_numpy(dense.T.copy())])
    df = tensors.read_tensors(spark, path)
    first = tensors.tensor_at(df, 0).first()
    assert (first["shape"], first["dim_names"], first["strides"], first["values"]) == ([2, 3], ["rows", "cols"], [12, 4], [0.0, 1.0, 2.0, 3.0, 4.0, 5.0])
    got = {(r["ordinal"], *r["coords"]): r["value"] for r in tensors.entries(df).collect()}
    assert all(got[0, i, j] == dense[i, j] == got[1, j, i] for i in range(2) for j in range(3))
    with pytest.raises(errors.InvalidFile):
        tensors.tensor_at(df, 2)
    m = np.array([[0.0, 2.0, 0.0], [3.0, 0.0, 4.0]])
    sparse = tensors.tensors(spark, [pa.SparseCOOTensor.from_dense_numpy(m), pa.SparseCSRMatrix.from_dense_numpy(m), pa.SparseCSCMatrix.from_dense_numpy(m), pa.SparseCSFTensor.from_dense_numpy(m)])
    for k in range(4):
        assert {tuple(r["coords"]): r["value"] for r in tensors.entries(tensors.tensor_at(sparse, k, sparse=True)).collect()} == {(0, 1): 2.0, (1, 0): 3.0, (1, 2): 4.0}
    ptr = spark.createDataFrame([(0, 0, 1), (1, 1, 3)], "row long, begin long, end long")
    idx = spark.createDataFrame([(0, 1, 2.0), (1, 0, 3.0), (2, 2, 4.0)], "position long, col long, value double")
    assert sorted(tuple(r) for r in tensors.csr_entries(ptr, idx).collect()) == [(0, 1, 2.0), (1, 0, 3.0), (1, 2, 4.0)]
    data = open(path, "rb").read()
    (tmp_path / "cut.arrows").write_bytes(data[: len(data) - 20])
    with pytest.raises(errors.InvalidBody):
        tensors.read_tensors(spark, str(tmp_path / "cut.arrows"))


def test_a_folder_as_a_stream(spark, tmp_path):
    source.register(spark)
    folder = tmp_path / "in"
    os.makedirs(folder)

    def add(k):
        t = pa.table({"id": [k, k + 1], "at": pa.array([datetime.datetime(2024, 1, 1, 0, k)] * 2, pa.timestamp("us"))})
        with ipc.new_stream(str(folder / f"{k:03}.arrows"), t.schema) as w:
            w.write_table(t)

    add(0)
    stream = spark.readStream.format("arrow_ipc").option("path", str(folder)).load()
    q = stream.withColumn("twice", F.col("id") * 2).writeStream.format("memory").queryName("ipc_in").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        add(5)
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(r["twice"] for r in spark.table("ipc_in").collect()) == [0, 2, 10, 12]
