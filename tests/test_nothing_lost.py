"""Cases in which rows, columns or files could get lost without a word."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tessel import errors, work
from tessel.functions import kernels
from tessel.operators import aggregate, nested, permute, sort
from tessel.options import SortOptions
from tessel.sources import ipc, tensors


def test_a_folder_stream_reads_appends_whatever_their_names(spark, tmp_path):
    ipc.register(spark)
    data, out, state = (str(tmp_path / n) for n in ("data", "out", "state"))

    def append(first):
        spark.range(first, first + 40, 1, 4).write.format("arrow_ipc").mode("append").option("path", data).save()

    def stream():
        rows = spark.readStream.format("arrow_ipc").option("path", data).load()
        rows.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination(120)

    for first in (0, 40, 80):
        append(first)
        stream()
    stream()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(120))


def test_a_folder_stream_bounds_its_offset_by_the_files_age(tmp_path):
    import os

    import pyarrow as pa

    from tessel.streaming.ipc_folder import FolderStream

    table = pa.table({"a": [1]})
    for name, at in (("z.arrow", 1000), ("b.arrow", 2000)):
        with pa.OSFile(str(tmp_path / name), "wb") as f, pa.ipc.new_file(f, table.schema) as w:
            w.write_table(table)
        os.utime(tmp_path / name, (at, at))
    s = FolderStream(None, {"path": str(tmp_path), "max_file_age": "500"})
    one = s.latestOffset()
    assert [p.path.split("/")[-1] for p in s.partitions(s.initialOffset(), one)] == ["b.arrow", "z.arrow"]
    assert [f.split("/")[-1] for f in one["seen"]] == ["b.arrow"]
    with pa.OSFile(str(tmp_path / "a.arrow"), "wb") as f, pa.ipc.new_file(f, table.schema) as w:
        w.write_table(table)
    os.utime(tmp_path / "a.arrow", (1900, 1900))
    assert [p.path.split("/")[-1] for p in s.partitions(one, s.latestOffset())] == ["a.arrow"]


def test_dictionaries_leave_columns_called_like_theirs(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "a", None)], "k int, value string, w string")
    encoded, words = nested.dictionary_encode(df, "w", "k", name="code")
    assert sorted(map(tuple, encoded.select("k", "value", "code").collect())) == [(1, "a", 0), (2, "b", 1), (3, "a", None)]
    back = nested.dictionary_decode(encoded, words, "code", "w")
    assert sorted(map(tuple, back.select("k", "value", "w").collect())) == [(1, "a", "x"), (2, "b", "y"), (3, "a", None)]
    own, _ = nested.dictionary_encode(df, "value", "k")
    assert sorted(map(tuple, own.select("k", "w", "index").collect(), ), key=lambda r: r[0]) == [(1, "x", 0), (2, "y", 1), (3, None, 0)]
    with pytest.raises(errors.TesselError, match="already"):
        nested.dictionary_encode(df, "w", "k", name="value")


def test_takes_and_lists_refuse_names_they_would_repeat(spark):
    df = spark.createDataFrame([(7, [1, 2])], "position int, v array<int>")
    for call in (lambda: permute.take_list(df, [0], ["position"]), lambda: nested.list_flatten(df, "v", ["position"])):
        with pytest.raises(errors.TesselError) as e:
            call()
        assert e.value.name == "InvalidInput"
    assert permute.element_at(df, 0, ["position"]).collect() == df.collect()
    odd = spark.createDataFrame([(k, -k) for k in range(20)], "__rid int, __index int")
    assert [tuple(r) for r in permute.take_list(odd, [3, None], ["__rid"]).orderBy("position").collect()] == [(0, 3, -3), (1, None, None)]
    assert sorted(r[0] for r in permute.slice_rows(odd, 5, 4, ["__rid"]).collect()) == [5, 6, 7, 8]


def test_slices_and_takes_in_the_tables_own_order(spark):
    df = spark.range(0, 1000, 1, 7)
    assert sorted(r[0] for r in permute.slice_rows(df, 500, 20).collect()) == list(range(500, 520))
    assert [tuple(r) for r in permute.take_list(df, [999, 0]).orderBy("position").collect()] == [(0, 999), (1, 0)]
    with pytest.raises(errors.TesselError), errors.naming():
        permute.take_list(df, [1000]).collect()


def test_a_prefix_and_the_whole_numbering_agree(spark, monkeypatch):
    df = spark.createDataFrame([(k * 7919 % 1000, k) for k in range(1000)], "a int, b int").repartition(5)
    short = permute.slice_rows(df, 100, 50, ["a"]).collect()
    monkeypatch.setattr("tessel.operators.ordinal.PREFIX", 0)
    assert sorted(short) == sorted(permute.slice_rows(df, 100, 50, ["a"]).collect())


def test_a_stable_sort_keeps_equal_rows_in_order(spark):
    df = spark.range(0, 500, 1, 6).select((F.col("id") % 3).alias("k"), "id")
    rows = [tuple(r) for r in sort.sort(df, "k", SortOptions(stable=True)).collect()]
    assert rows == sorted(rows)


def test_an_aggregate_without_keys_has_a_result_over_nothing(spark):
    empty = spark.createDataFrame([], "k int, v long")
    run = lambda keys: aggregate.aggregate(empty, kernels.COUNT_ROWS, "v", LongType(), keys, "n").collect()
    assert [tuple(r) for r in run([])] == [(0,)]
    assert run(["k"]) == []


def test_states_are_handed_on_before_they_pile_up(spark, monkeypatch):
    monkeypatch.setattr(aggregate, "MOST_STATES", 3)
    df = spark.range(0, 300, 1, 2).select((F.col("id") % 50).alias("k"), "id")
    rows = aggregate.aggregate(df, kernels.COUNT_ROWS, "id", LongType(), ["k"], "n").collect()
    assert sorted(map(tuple, rows)) == [(k, 6) for k in range(50)]


def test_long_runs_are_decoded_in_pieces(spark, monkeypatch):
    runs = spark.createDataFrame([(3_000_000_000, "a"), (3_000_000_002, "b")], "run_end long, value string")
    tail = nested.run_end_decode(runs).where("rid >= 2999999999")
    assert nested.run_end_decode(runs, 2).count() == 2
    monkeypatch.setattr(nested, "PIECE", 4)
    small = spark.createDataFrame([(10, "a"), (11, None), (30, "a")], "run_end long, value string")
    found = sorted(map(tuple, nested.run_end_decode(small).collect()))
    assert found == [(k, "a" if k != 10 else None) for k in range(30)]
    assert "Generate" in tail._jdf.queryExecution().toString()
    spans = spark.createDataFrame([(0, 0, 6), (1, 6, 6), (2, 6, 7)], "row long, begin long, end long")
    cells = spark.createDataFrame([(k, k, k / 2) for k in range(7)], "position long, col long, value double")
    assert sorted(map(tuple, tensors.csr_entries(spans, cells).collect())) == [(0, k, k / 2) for k in range(6)] + [(2, 6, 3.0)]


@pytest.mark.parametrize("values", [[], [None], [1], [1, 1, 1], [1, 2, 2, None, None, 1]])
def test_runs_meet_across_ranges(spark, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values * 40)], "k int, v int")
    runs = nested.run_end_encode(df, "v", "k")
    expected = [(k + 1, v) for k, v in enumerate(values * 40) if k + 1 == len(values) * 40 or (values * 40)[k + 1] != v]
    assert sorted(map(tuple, runs.collect())) == expected
    assert [r["value"] for r in nested.run_end_decode(runs).orderBy("rid").collect()] == values * 40


def test_a_failed_overwrite_leaves_what_was_there(spark, tmp_path):
    ipc.register(spark)
    path = str(tmp_path / "t")
    spark.range(10).write.format("arrow_ipc").mode("overwrite").option("path", path).save()
    broken = spark.range(10).select(F.when(F.col("id") < 20, F.raise_error(F.lit("no"))).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        broken.write.format("arrow_ipc").mode("overwrite").option("path", path).save()
    read = lambda: sorted(r["id"] for r in spark.read.format("arrow_ipc").option("path", path).load().collect())
    assert read() == list(range(10))
    again = spark.read.format("arrow_ipc").option("path", path).load().where("id < 5")
    again.write.format("arrow_ipc").mode("overwrite").option("path", path).save()
    assert read() == list(range(5))


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(applicationId="a", master="spark://host:7077", getConf=lambda: {})
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: d))
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        work.shared_dir(session)
