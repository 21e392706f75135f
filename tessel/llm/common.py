"""What the corpus operators share: tables, short Arrow batches, written intermediates."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.work import Written, delete, shared_dir, written

__all__ = ["BATCH_BYTES", "Bucketed", "TEXT_ROWS", "Written", "settings", "columns", "delete", "drawn_by_hash", "plain", "shared_dir", "short_batches", "table", "written"]

#: What is handed to a Python worker at once: at most so many rows and, since texts may be
#: long, about so many bytes (a longer text comes alone).
TEXT_ROWS, BATCH_BYTES = 128, "16m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(df: DataFrame, **known: str) -> tuple[DataFrame, list[str]]:
    """The columns under names that can't clash, and their old names in order.

    known: new name = name in df, found exactly or else as the only one alike but for case.
    The other columns get numbers, so whatever they are called, no operator meets them.
    """
    old = df.columns
    at = {}
    for new, name in known.items():
        same = [k for k, c in enumerate(old) if c == name] or [k for k, c in enumerate(old) if c.lower() == name.lower()]
        if not same:
            raise ValueError(f"no column {name}")
        at[same[0]] = new
    return df.toDF(*(at.get(k, f"other_{k}") for k in range(len(old)))), old


def columns(df: DataFrame, **known: str) -> DataFrame:
    """Only the known columns, under their new names."""
    return plain(df, **known)[0].select(*known)


def drawn_by_hash(key: Column, wanted: int, of: int) -> Column:
    """True for about ``wanted`` of ``of`` distinct keys, the same ones in every run.

    Unlike a sort with a limit, it lets no task send more than its share to the driver.
    """
    if of <= wanted:
        return F.lit(True)
    return F.pmod(F.xxhash64(F.lit("drawn"), key), F.lit(1 << 40)) < F.lit(int(wanted / of * (1 << 40)))


def short_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Bounds the Arrow batches between the JVM and Python for the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings that hold for the plans made inside, and are as before afterwards."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Bucketed:
    """A table in the shared folder, dealt into buckets by some columns and sorted by them within each.

    Joins and groupings on those columns read it as it lies. A bucket whose rows come from one task
    is one sorted file. The table is known to this session's catalog alone; its files may stay.
    """

    def __init__(self, df: DataFrame, name: str, buckets: int, keys: list[str], folder: str | None = None, sort: bool = True):
        self.spark, self.buckets, self.keys = df.sparkSession, buckets, keys
        self.table = f"{name}_{uuid.uuid4().hex[:12]}".replace("-", "_")
        self.path = f"{folder or shared_dir(self.spark)}/{self.table}_{buckets}"
        writer = df.write.format("parquet").option("compression", "zstd").option("path", self.path).bucketBy(buckets, *keys)
        (writer.sortBy(*keys) if sort else writer).saveAsTable(self.table)

    @classmethod
    def at(cls, spark: SparkSession, path: str, schema: str, keys: list[str]) -> Bucketed:
        """One that an earlier application has written, sorted."""
        self = cls.__new__(cls)
        self.spark, self.path, self.keys = spark, path, keys
        self.buckets = int(path.rsplit("_", 1)[1])
        self.table = f"opened_{uuid.uuid4().hex[:12]}"
        by = ", ".join(keys)
        spark.sql(f"CREATE TABLE {self.table} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return self

    @property
    def df(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        delete(self.spark, self.path)
