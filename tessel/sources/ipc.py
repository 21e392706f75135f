"""Arrow IPC streams and files as a Spark data source: ``spark.read.format("arrow_ipc")``.

A file with a footer gives one partition for each record batch, a stream one for each file,
since a stream has no index. Dictionaries, deltas and compressed bodies are Arrow's matter;
types that Spark lacks arrive as described in ``tessel.types``.

Options: path (file, folder or glob), container ("file", "stream" or, when reading, "auto"),
compression ("none", "zstd", "lz4") and batch_rows for writing, columns (comma-separated) for
reading only some of the top-level fields.

Paths are opened with pyarrow's file systems, so a cluster needs a store that its executors
can reach in that way (a mount, or one that pyarrow knows by its scheme).
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructField, StructType

from tessel.errors import named
from tessel.schema import unique_names
from tessel.types import loadable, spark_schema

MAGIC = b"ARROW1"
SUFFIXES = (".arrow", ".arrows", ".ipc", ".feather")


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return pafs.LocalFileSystem(), path


def list_files(path: str) -> list[str]:
    fs, p = file_system(path)
    if any(c in p for c in "*?["):
        import fnmatch

        found = fs.get_file_info(pafs.FileSelector(posixpath.dirname(p)))
        return sorted(f.path for f in found if f.is_file and fnmatch.fnmatch(f.path, p))
    info = fs.get_file_info(p)
    if info.type == pafs.FileType.Directory:
        found = fs.get_file_info(pafs.FileSelector(p, recursive=True))
        return sorted(f.path for f in found if f.is_file and f.path.endswith(SUFFIXES) and not posixpath.basename(f.path).startswith(("_", ".")))
    if info.type == pafs.FileType.NotFound:
        raise named("InvalidFile", path)
    return [p]


def is_file_container(fs: pafs.FileSystem, path: str) -> bool:
    with fs.open_input_file(path) as f:
        return f.read(len(MAGIC)) == MAGIC


def open_reader(fs: pafs.FileSystem, path: str, container: str):
    """The reader of a path; malformed input has a named error."""
    source = fs.open_input_file(path)
    is_file = container == "file" or container == "auto" and is_file_container(fs, path)
    try:
        return ipc.open_file(source) if is_file else ipc.open_stream(source)
    except pa.ArrowInvalid as error:
        raise named("InvalidFile" if is_file else "InvalidMessage", str(error)) from error


@dataclass
class Part(InputPartition):
    path: str
    batch: int  # -1: all of a stream


class IpcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options
        self.path, self.container = options["path"], options.get("container", "auto")

    def partitions(self) -> list[Part]:
        fs, _ = file_system(self.path)
        out = []
        for path in list_files(self.path):
            reader = open_reader(fs, path, self.container)
            if isinstance(reader, ipc.RecordBatchFileReader):
                out += [Part(path, k) for k in range(reader.num_record_batches)]
            else:
                out.append(Part(path, -1))
        return out or [Part("", -1)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = file_system(self.path)
        reader = open_reader(fs, partition.path, self.container)
        keep = wanted(reader.schema, self.options)
        try:
            batches = reader if partition.batch < 0 else [reader.get_batch(partition.batch)]
            for batch in batches:
                yield loadable_batch(batch, keep)
        except pa.ArrowInvalid as error:
            raise named("InvalidMetadata", str(error)) from error


def wanted(schema: pa.Schema, options: dict) -> list[int]:
    if not options.get("columns"):
        return list(range(len(schema)))
    names = [c.strip() for c in options["columns"].split(",")]
    for n in names:
        if n not in schema.names:
            raise named("UnknownField", n)
    return [schema.names.index(n) for n in names]


def loadable_batch(batch: pa.RecordBatch, keep: list[int]) -> pa.RecordBatch:
    names = unique_names(batch.schema.names)
    return pa.RecordBatch.from_arrays([loadable(batch.column(k)) for k in keep], names=[names[k] for k in keep])


def of_size(batches: Iterator[pa.RecordBatch], schema: pa.Schema, rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of a fixed size, whatever size they come in."""
    held = schema.empty_table()
    for batch in batches:
        cast = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, schema)], schema=schema)
        held = pa.concat_tables([held, pa.Table.from_batches([cast])])
        while held.num_rows >= rows:
            yield from held.slice(0, rows).combine_chunks().to_batches()
            held = held.slice(rows)
    if held.num_rows:
        yield from held.combine_chunks().to_batches()


@dataclass
class Done(WriterCommitMessage):
    path: str
    rows: int


class IpcWriter(DataSourceArrowWriter):
    """One IPC stream or file per task, named after it is whole; an aborted job removes its parts.

    What an overwrite replaces goes once all tasks are done, so a job that fails leaves it as it
    was, and a job may read what it replaces.
    """

    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.schema, self.options = schema, options
        self.path, self.overwrite = options["path"], overwrite
        self.job = uuid.uuid4().hex[:8]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        fs, p = file_system(self.path)
        fs.create_dir(p, recursive=True)
        container = self.options.get("container", "file")
        compression = self.options.get("compression", "none")
        task = TaskContext.get()
        suffix = ".arrow" if container == "file" else ".arrows"
        final = posixpath.join(p, f"part-{task.partitionId():05d}-{self.job}{suffix}")
        draft = posixpath.join(p, f"_{posixpath.basename(final)}.{task.taskAttemptId()}")
        write_options = ipc.IpcWriteOptions(compression=None if compression == "none" else compression)
        rows, at_once = 0, int(self.options.get("batch_rows", 65_536))
        schema = to_arrow_schema(self.schema)
        new = ipc.new_file if container == "file" else ipc.new_stream
        with fs.open_output_stream(draft) as sink, new(sink, schema, options=write_options) as writer:
            for batch in of_size(iterator, schema, at_once):
                writer.write_batch(batch)
                rows += batch.num_rows
        fs.move(draft, final)
        return Done(final, rows)

    def commit(self, messages: list) -> None:
        fs, p = file_system(self.path)
        fs.create_dir(p, recursive=True)
        mine = {posixpath.basename(m.path) for m in messages if m is not None}
        for f in fs.get_file_info(pafs.FileSelector(p)):
            draft = f.base_name.startswith("_part-") and f"-{self.job}." in f.base_name
            if draft or self.overwrite and f.base_name not in mine:
                fs.delete_file(f.path) if f.is_file else fs.delete_dir(f.path)

    def abort(self, messages: list) -> None:
        fs, p = file_system(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(m.path)
        for f in fs.get_file_info(pafs.FileSelector(p, allow_not_found=True)):
            if f.base_name.startswith("_part-") and f"-{self.job}." in f.base_name:
                fs.delete_file(f.path)


class ArrowIpc(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def schema(self) -> StructType:
        files = list_files(self.options["path"])
        if not files:
            raise named("InvalidFile", self.options["path"])
        fs, _ = file_system(self.options["path"])
        arrow = open_reader(fs, files[0], self.options.get("container", "auto")).schema
        full = spark_schema(arrow)
        names = unique_names(arrow.names)
        return StructType([StructField(names[k], full.fields[k].dataType, full.fields[k].nullable, full.fields[k].metadata) for k in wanted(arrow, self.options)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return IpcReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return IpcWriter(schema, dict(self.options), overwrite)

    def streamReader(self, schema: StructType):
        from tessel.streaming.ipc_folder import FolderStream

        return FolderStream(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArrowIpc)


def batch_count(path: str) -> int:
    fs, p = file_system(path)
    reader = open_reader(fs, p, "file")
    return reader.num_record_batches


def read_batch(spark: SparkSession, path: str, index: int):
    """One record batch of a file by its number."""
    from tessel.schema import from_arrow

    fs, p = file_system(path)
    reader = open_reader(fs, p, "file")
    if not 0 <= index < reader.num_record_batches:
        raise named("InvalidFile", f"batch {index} of {reader.num_record_batches}")
    return from_arrow(spark, pa.Table.from_batches([reader.get_batch(index)]))


def messages(spark: SparkSession, path: str):
    """ordinal, kind, metadata_bytes, body_bytes of every message of a stream, in order."""
    fs, p = file_system(path)
    rows = []
    with fs.open_input_file(p) as source:
        while True:
            try:
                m = ipc.read_message(source)
            except EOFError:
                break
            except pa.ArrowInvalid as error:
                raise named("InvalidMessage", str(error)) from error
            rows.append((len(rows), m.type, m.metadata.size, m.body.size if m.body is not None else 0))
    return spark.createDataFrame(rows, "ordinal int, kind string, metadata_bytes long, body_bytes long")


def decode_schema(message: bytes) -> StructType:
    """The schema of an encapsulated message; anything else is InvalidMessage."""
    try:
        return spark_schema(ipc.read_schema(pa.BufferReader(message)))
    except (pa.ArrowInvalid, EOFError, OSError) as error:
        raise named("InvalidMessage", str(error)) from error


def decode_batch(spark: SparkSession, message: bytes, schema: pa.Schema):
    """The rows of an encapsulated record batch, given its schema."""
    from tessel.schema import from_arrow

    try:
        batch = ipc.read_record_batch(ipc.read_message(pa.BufferReader(message)), schema)
    except (pa.ArrowInvalid, EOFError, OSError) as error:
        raise named("InvalidMetadata", str(error)) from error
    return from_arrow(spark, pa.Table.from_batches([batch]))
