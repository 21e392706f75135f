"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``.

    Where the setting is missing, the driver's temporary folder serves if driver and executors
    are one process; on a cluster each would write to its own disk, so that is an error.
    """
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir has to name a folder that driver and executors share ({master})")
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="tessel-")
            _remove_at_exit(spark, _local[app])
        base = _local[app]
    else:
        _remove_at_exit(spark, f"{base.rstrip('/')}/tessel-{app}")
    return f"{base.rstrip('/')}/tessel-{app}"


_planned: set[str] = set()


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    if path in _planned:
        return
    _planned.add(path)

    def remove() -> None:
        try:
            delete(spark, path)
        except Exception:  # the JVM may be gone already; the folder's owner cleans up then
            return

    atexit.register(remove)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def put(spark: SparkSession, name: str, data: bytes) -> str:
    """A small file in the shared folder; returns its path."""
    path = f"{shared_dir(spark)}/{name}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(hadoop, True)
    out.write(bytearray(data))
    out.close()
    return path


#: A small table has a file for this many shuffle partitions, but at least so many for each core.
NARROW, PER_CORE = 4, 8


class Written:
    """A table written to the shared folder: cuts the lineage and survives lost executors."""

    def __init__(self, df: DataFrame, name: str, sort: list[str] | None = None, folder: str | None = None, narrow: bool = False):
        """narrow: into few files, for tables that are small against what they come from."""
        self.spark = df.sparkSession
        if narrow:
            partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            files = max(PER_CORE * self.spark.sparkContext.defaultParallelism, partitions // NARROW)
            if partitions > 2 * files:  # else some tasks would read twice what others do, to save little
                df = df.coalesce(files)
        self.path = f"{folder or shared_dir(self.spark)}/{name}-{uuid.uuid4().hex[:12]}"
        if sort:
            df = df.sortWithinPartitions(*sort)
        df.write.option("compression", "zstd").parquet(self.path)
        self.schema = df.schema

    @classmethod
    def at(cls, spark: SparkSession, path: str) -> Written:
        """One that an earlier application has written."""
        self = cls.__new__(cls)
        self.spark, self.path, self.schema = spark, path, spark.read.parquet(path).schema
        return self

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        delete(self.spark, self.path)


def written(df: DataFrame, name: str) -> DataFrame:
    """A small table, written."""
    return Written(df, name, narrow=True).df
