"""Structured Streaming over a folder of Arrow IPC streams and files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceStreamReader
from pyspark.sql.types import StructType

from tessel.sources.ipc import Part, file_system, list_files, loadable_batch, open_reader, wanted

#: Seconds for which a file may turn up after newer ones, unless the option max_file_age says otherwise.
MAX_AGE = 7 * 24 * 3600


class FolderStream(DataSourceStreamReader):
    """Every file once, whatever its name and whenever it turns up.

    The offset lists the files seen that were changed within ``max_file_age`` seconds of the newest
    one, and the time before which all count as seen, so it doesn't grow with the folder's age. A
    file that turns up with an older time than that is left out, as Spark's own file source does.
    """

    def __init__(self, schema: StructType, options: dict):
        self.options, self.path = options, options["path"]
        self.max_age = int(float(options.get("max_file_age", MAX_AGE)) * 1e9)

    def _times(self) -> dict[str, int]:
        fs, _ = file_system(self.path)
        return {i.path: int(i.mtime_ns or 0) for i in fs.get_file_info(list_files(self.path))}

    def initialOffset(self) -> dict:
        return {"before": -1, "seen": {}}

    def latestOffset(self) -> dict:
        times = self._times()
        before = max(times.values(), default=0) - self.max_age
        return {"before": before, "seen": {f: at for f, at in sorted(times.items()) if at >= before}}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        new = [f for f in end["seen"] if f not in start["seen"] and end["seen"][f] >= start["before"]]
        # Those that are too old to be listed in the end, but weren't so at the start.
        aged = [f for f, at in self._times().items() if start["before"] <= at < end["before"] and f not in start["seen"]]
        return [Part(f, -1) for f in sorted({*new, *aged})]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        reader = open_reader(fs, partition.path, self.options.get("container", "auto"))
        keep = wanted(reader.schema, self.options)
        n = getattr(reader, "num_record_batches", None)
        for batch in reader if n is None else (reader.get_batch(k) for k in range(n)):
            yield loadable_batch(batch, keep)


def running_count(stream: DataFrame, time: str, window: str, late: str, keys: list[str]) -> DataFrame:
    """Rows by key and tumbling window, rows later than the watermark left out (an extension)."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count(F.lit(1)).alias("n_rows")).select("window.start", *keys, "n_rows")
