"""Columns that grow value by value, and messages one at a time."""

import pyarrow as pa
import pyarrow.ipc as ipc
import pytest

from tessel import errors
from tessel.functions.datum import aligned_chunks
from tessel.operators.nested import emission
from tessel.sources import builders
from tessel.sources import ipc as source


def test_life_of_a_builder(spark):
    b = builders.ColumnBuilder(pa.uint32())
    b.extend([1, None, 3])
    b.append_null()
    assert len(b) == 4
    with pytest.raises(errors.NotFinished):
        b.reset()
    assert b.finish().to_pylist() == [1, None, 3, None]
    for call in (b.finish, b.append_null, lambda: b.append(1)):
        with pytest.raises(errors.AlreadyFinished):
            call()
    b.reset()
    b.append(7)
    assert b.finish_reset().to_pylist() == [7]
    b.append(8)
    assert b.finish_clear().to_pylist() == [8]
    b.append(9)
    assert [r[0] for r in b.to_df(spark).collect()] == [9]
    c = builders.ColumnBuilder(pa.int8())
    c.append(300)
    with pytest.raises(errors.InvalidInput):
        c.finish()


@pytest.mark.parametrize(
    "kind, good, bad, error",
    [
        (pa.binary(2), b"ab", b"abc", errors.BufferTooSmall),
        (pa.list_(pa.int8(), 2), [1, 2], [1], errors.InvalidChildLength),
        (pa.struct([pa.field("a", pa.int8(), False)]), {"a": 1}, {"a": None}, errors.NullInNonNullableField),
        (pa.struct([("a", pa.int8())]), {"a": 1}, {"b": 1}, errors.InvalidChildren),
        (pa.map_(pa.string(), pa.int8()), {"k": 1}, [(None, 1)], errors.InvalidEntriesType),
    ],
)
def test_values_are_checked(kind, good, bad, error):
    b = builders.ColumnBuilder(kind)
    b.append(good)
    with pytest.raises(error):
        b.append(bad)
    b.append_null()
    assert len(b.finish()) == 2


def test_encoded_columns():
    d = builders.DictionaryBuilder(pa.int8(), pa.array(["red", "blue"]))
    d.extend([1, None, 0])
    with pytest.raises(errors.IndexOutOfRange):
        d.append(200)
    assert d.finish().to_pylist() == ["blue", None, "red"]
    d.clear()
    d.append(5)
    with pytest.raises(errors.IndexOutOfRange):
        d.finish()
    r = builders.RunEndBuilder(pa.int16(), pa.int32())
    r.extend([(2, 100), (5, None)])
    with pytest.raises(errors.InvalidRunEnds):
        r.append((5, 1))
    with pytest.raises(errors.InvalidRunEnds):
        r.append_null()
    assert r.finish().to_pylist() == [100, 100, None, None, None]
    with pytest.raises(errors.InvalidRunEnds):
        builders.RunEndBuilder(pa.uint8(), pa.int32())


@pytest.mark.parametrize("mode", ["dense", "sparse"])
def test_unions(mode):
    u = builders.UnionBuilder(pa.union([pa.field("i", pa.int32()), pa.field("s", pa.string())], mode, type_codes=[5, 7]))
    u.extend([(5, 1), (7, "x"), (5, 2)])
    u.append_null()
    with pytest.raises(errors.InvalidTypeId):
        u.append((6, 1))
    assert u.finish().to_pylist() == [1, "x", 2, None]


@pytest.mark.parametrize("large", [False, True])
def test_list_views(large):
    v = builders.ListViewBuilder(pa.array([1, 2, 3, 4]), large)
    v.extend([(2, 2), (0, 3), None, (4, 0)])
    with pytest.raises(errors.InvalidOffsets):
        v.append((3, 2))
    assert v.finish().to_pylist() == [[3, 4], [1, 2, 3], None, []]


def test_messages(spark, tmp_path):
    path = str(tmp_path / "m.arrows")
    t = pa.table({"a": [1, 2], "d": pa.array(["x", "y"]).dictionary_encode()})
    with ipc.new_stream(path, t.schema) as w:
        w.write_table(t)
    assert [r["kind"] for r in source.messages(spark, path).orderBy("ordinal").collect()] == ["schema", "dictionary", "record batch"]
    plain = pa.record_batch({"a": [1, 2]})
    assert source.decode_schema(plain.schema.serialize().to_pybytes()).names == ["a"]
    assert source.decode_batch(spark, plain.serialize().to_pybytes(), plain.schema).count() == 2
    with pytest.raises(errors.InvalidMessage):
        source.decode_schema(b"junk")
    with pytest.raises(errors.InvalidMetadata):
        source.decode_batch(spark, plain.schema.serialize().to_pybytes(), plain.schema)


def test_offsets_of_32_bits_end(monkeypatch):
    monkeypatch.setattr(builders, "LAST_OFFSET", 4)
    for kind, value in ((pa.string(), "äb"), (pa.binary(), b"abc"), (pa.list_(pa.int8()), [1, 2, 3]), (pa.map_(pa.int8(), pa.int8()), {1: 1, 2: 2, 3: 3})):
        b = builders.ColumnBuilder(kind)
        b.append(value)
        with pytest.raises(errors.OffsetOverflow):
            b.append(value)
        assert len(b) == 1 and len(b.finish_reset()) == 1
        b.append(value)
    large = builders.ColumnBuilder(pa.large_string())
    large.extend(["abc", "abc"])
    assert len(large) == 2


def test_chunks_in_step():
    a = pa.chunked_array([[1, 2], [], [3, 4, 5]], pa.int64())
    b = pa.chunked_array([[6], [7, 8, 9, 10]], pa.int64())
    found = [(at, x.to_pylist(), y.to_pylist()) for at, (x, y) in aligned_chunks(a, b)]
    assert found == [(0, [1], [6]), (1, [2], [7]), (2, [3, 4, 5], [8, 9, 10])]
    assert list(aligned_chunks(a[:0], b[:0])) == []
    with pytest.raises(errors.InvalidInput):
        list(aligned_chunks(a, b[:2]))


def test_zeros_of_either_sign_are_two_dictionary_values(spark):
    one, two = (spark.createDataFrame([(0, v)], "index long, value double") for v in (0.0, -0.0))
    assert emission(one, one)[0] == "skip" and emission(two, two)[0] == "skip"
    assert emission(one, two)[0] == "full"
