"""Dense and sparse tensors as rows, and their IPC messages."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.ipc as ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.errors import named
from tessel.operators.nested import _spread
from tessel.sources.ipc import file_system

ROW = "ordinal int, kind string, value_type string, shape array<bigint>, dim_names array<string>, strides array<bigint>, values array<double>, coords array<array<bigint>>"


def dense_row(ordinal: int, t: pa.Tensor) -> tuple:
    return (ordinal, "dense", str(t.type), list(t.shape), list(t.dim_names or []), list(t.strides), t.to_numpy().astype(float).ravel().tolist(), None)


def sparse_row(ordinal: int, t: pa.SparseCOOTensor | pa.SparseCSRMatrix | pa.SparseCSCMatrix) -> tuple:
    """Any sparse form as coordinates and values."""
    kind = {"SparseCOOTensor": "coo", "SparseCSRMatrix": "csr", "SparseCSCMatrix": "csc", "SparseCSFTensor": "csf"}[type(t).__name__]
    if kind == "coo":
        values, coords = t.to_numpy()
        values, coords = values.ravel(), coords.tolist()
    elif kind in ("csr", "csc"):
        values, ptr, other = t.to_numpy()
        lead = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
        other = other.ravel()
        pairs = np.stack([lead, other] if kind == "csr" else [other, lead], axis=1)
        values, coords = values.ravel(), pairs.tolist()
    else:
        dense = t.to_tensor().to_numpy()
        where = np.argwhere(dense)
        values, coords = dense[tuple(where.T)], where.tolist()
    return (ordinal, kind, str(t.type), list(t.shape), list(t.dim_names or []), None, [float(v) for v in values], coords)


def tensors(spark: SparkSession, found: Sequence[object]) -> DataFrame:
    rows = [dense_row(k, t) if isinstance(t, pa.Tensor) else sparse_row(k, t) for k, t in enumerate(found)]
    return spark.createDataFrame(rows, ROW)


def write_tensors(path: str, found: Sequence[pa.Tensor]) -> None:
    """Tensor messages one after the other."""
    fs, p = file_system(path)
    with fs.open_output_stream(p) as out:
        for t in found:
            ipc.write_tensor(t, out)


def read_tensors(spark: SparkSession, path: str) -> DataFrame:
    """All tensor messages of a stream, other messages skipped; a cut body is InvalidBody."""
    fs, p = file_system(path)
    out = []
    with fs.open_input_file(p) as source:
        data = source.read()
    stream = pa.BufferReader(data)
    while stream.tell() < len(data):
        at = stream.tell()
        try:
            message = ipc.read_message(stream)
        except EOFError:
            break
        except (pa.ArrowInvalid, OSError) as error:
            raise named("InvalidBody", str(error)) from error
        if message.type == "tensor":
            end = stream.tell()
            stream.seek(at)
            out.append(ipc.read_tensor(stream))
            stream.seek(max(end, stream.tell()))
    return tensors(spark, out)


def tensor_at(df: DataFrame, index: int, sparse: bool = False) -> DataFrame:
    """The index-th dense or sparse tensor."""
    kind = F.col("kind") != "dense" if sparse else F.col("kind") == "dense"
    mine = df.where(kind)
    if not 0 <= index < mine.count():
        raise named("InvalidFile", str(index))
    return mine.orderBy("ordinal").offset(index).limit(1)


def entries(df: DataFrame) -> DataFrame:
    """ordinal, coords, value of every stored entry; dense ones get their coordinates from the shape."""
    dense = df.where("kind = 'dense'").select("ordinal", "shape", F.posexplode("values").alias("at", "value"))
    sizes = F.expr("transform(sequence(1, size(shape)), k -> aggregate(slice(shape, k + 1, size(shape)), 1L, (a, x) -> a * x))")
    coords = F.expr("transform(sequence(0, size(shape) - 1), k -> cast((at div steps[k]) % shape[k] as bigint))")
    dense = dense.withColumn("steps", sizes).withColumn("coords", coords).select("ordinal", "coords", "value")
    sparse = df.where("kind <> 'dense'").select("ordinal", F.explode(F.arrays_zip("coords", "values")).alias("e")).select("ordinal", "e.coords", F.col("e.values").alias("value"))
    return dense.unionByName(sparse)


def csr_entries(indptr: DataFrame, indices: DataFrame) -> DataFrame:
    """row, col, value from (row, begin, end) pointers and (position, col, value) entries."""
    spans = indptr.select("row", F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"))
    return _spread(spans, "begin", "end", "position").join(indices, "position").select("row", "col", "value")
