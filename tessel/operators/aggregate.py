"""Mergeable aggregates: sessions on the driver, and the same lifecycle over a table."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from tessel.errors import named
from tessel.functions.datum import Datum
from tessel.functions.registry import Kernel, Lifecycle
from tessel.options import NoOptions, Options


#: Keys of which a task holds states at once.
MOST_STATES = 100_000


class Session:
    """One running aggregate: update it with batches, merge others of the same kernel, finalize."""

    def __init__(self, kernel: Kernel, options: Options = NoOptions()):
        self.kernel, self.options = kernel, options
        self.state = kernel.lifecycle.init()

    def update(self, batch: Any, args: Sequence[Datum] | None = None) -> None:
        if args is not None and (what := self.kernel.signature.fails(list(args), self.options)):
            raise named({"arity": "InvalidArity", "types": "NoMatchingKernel", "options": "InvalidOptions"}[what])
        self.state = self.kernel.lifecycle.update(self.state, batch)

    def merge(self, other: Session) -> None:
        if other.kernel is not self.kernel:
            raise named("AggregateStateMismatch")
        self.state = self.kernel.lifecycle.merge(self.state, other.state)

    def finalize(self) -> Any:
        return self.kernel.lifecycle.finalize(self.state)

    def close(self) -> None:
        self.state = None


def aggregate(df: DataFrame, lifecycle: Lifecycle, column: str, result: DataType, keys: Sequence[str] = (), name: str = "result", spread: int = 32) -> DataFrame:
    """A lifecycle over a table, by key or over all of it.

    Every partition folds its rows into one state a key, so a hot key travels as one small row
    from each task. States are merged in two steps, the first over ``spread`` parts of a key's
    states, which needs nothing of merge but to be associative and commutative. A partition with
    very many keys hands its states on when it holds ``MOST_STATES`` of them.

    Cases: without keys an empty table has one result, that of an untouched state; with keys it has
    none; null keys are a group of their own; a result name that is a key's is InvalidInput.
    """
    if name in keys:
        raise named("InvalidInput", name)
    keys = list(keys)
    rows = df.select(*(F.col(k).alias(f"k{n}") for n, k in enumerate(keys)), F.col(column).alias("value"))
    names = [f"k{n}" for n in range(len(keys))]
    state_type = StructType([*(StructField(n, df.schema[k].dataType) for n, k in zip(names, keys)), StructField("part", rows.select(F.lit(0)).schema[0].dataType), StructField("state", rows.select(F.lit(b"")).schema[0].dataType)])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() % spread
        states: dict[tuple, Any] = {}

        def handed_on() -> pa.RecordBatch:
            items = list(states.items())
            columns = [pa.array([k[n] for k, _ in items], batch_type(n)) for n in range(len(names))]
            columns += [pa.array([part] * len(items), pa.int32()), pa.array([pickle.dumps(s) for _, s in items], pa.binary())]
            states.clear()
            return pa.RecordBatch.from_arrays(columns, names=[*names, "part", "state"])

        for batch in batches:
            values = batch.column(len(names))
            if not names:
                states[()] = lifecycle.update(states.get((), lifecycle.init()), values)
                continue
            index: dict[tuple, list[int]] = {}
            for at, key in enumerate(zip(*(batch.column(k).to_pylist() for k in range(len(names))))):
                index.setdefault(key, []).append(at)
            for key, at in index.items():
                state = states[key] if key in states else lifecycle.init()
                states[key] = lifecycle.update(state, values.take(pa.array(at)))
            if len(states) >= MOST_STATES:
                yield handed_on()
        yield handed_on()

    from pyspark.sql.pandas.types import to_arrow_type

    key_types = [to_arrow_type(df.schema[k].dataType) for k in keys]

    def batch_type(n: int) -> pa.DataType:
        return key_types[n]

    def merged(finish: bool) -> Callable:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            state = None
            for k, raw in enumerate(pdf["state"]):
                other = pickle.loads(raw)
                state = other if k == 0 else lifecycle.merge(state, other)
            head = {n: pdf[n].iloc[:1].tolist() for n in names}
            if finish:
                return pd.DataFrame(head | {name: [lifecycle.finalize(state)]})
            return pd.DataFrame(head | {"part": [0], "state": [pickle.dumps(state)]})

        return run

    partial = rows.mapInArrow(fold, state_type)
    if not names:
        untouched = df.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit(pickle.dumps(lifecycle.init())).alias("state"))
        partial = partial.unionByName(untouched)
    once = partial.groupBy(*names, "part").applyInPandas(merged(False), state_type)
    final = StructType([*state_type.fields[: len(names)], StructField(name, result)])
    out = once.groupBy(*names).applyInPandas(merged(True), final)
    return out.select(*(F.col(n).alias(k) for n, k in zip(names, keys)), name)


def count_rows(df: DataFrame, keys: Sequence[str] = (), name: str = "n_rows") -> DataFrame:
    """All rows, nulls included."""
    count = F.count(F.lit(1)).alias(name)
    return df.groupBy(*keys).agg(count) if keys else df.agg(count)
