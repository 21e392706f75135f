"""Best-fit packing of token sequences (operator 4): best-two-fit on the length histogram.

Only the number of pieces of each length matters for packing, and there are at most
``capacity`` lengths, so the packing is decided on that histogram, which has a fixed size:
a pattern (a multiset of lengths) is filled greedily from the longest remaining length;
then its smallest piece gives way to the two unpacked pieces that fit the gap left by it
most tightly; the pattern is used as often as its lengths last. The pieces then get their
places by their rank within their length, which is a count per partition plus an offset.

Cases: a null text is empty and has only the end id; texts longer than the capacity are
cut, the first piece being the shorter one; null and equal ids keep all their rows; an empty table
gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.common import Written, columns, short_batches

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, place long"


def _pieces(encoder: Callable, end_id: int, capacity: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encode, end = encoder(), np.array([end_id], "<u4").tobytes()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode.ids(text) + end
                n = len(ids) // 4
                first = n % capacity or capacity
                begin, k = 0, 0
                while begin < n:
                    length = first if k == 0 else capacity
                    crc = zlib.crc32(ids[4 * begin : 4 * (begin + length)])
                    rows.append((doc_id, k, begin, length, crc, part, int(seen[length])))
                    seen[length] += 1
                    begin, k = begin + length, k + 1
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return run


class Histogram:
    """Counts of the unpacked pieces by length, with a search for the longest that fits."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()

    def longest(self, limit: int, used: dict[int, int]) -> int:
        for length in np.flatnonzero(self.left[: limit + 1])[::-1].tolist():
            if self.left[length] > used.get(length, 0):
                return length
        return 0

    def best_pair(self, room: int, used: dict[int, int]) -> tuple[int, int]:
        """The two unpacked lengths of the largest sum up to room; (0, 0) if there are none."""
        free = self.left[: room + 1].copy()
        for length, n in used.items():
            if length <= room:
                free[length] -= n
        have = np.flatnonzero(free > 0)
        best, low, high = (0, 0), 0, len(have) - 1
        while low <= high:
            a, b = int(have[low]), int(have[high])
            if low == high and free[a] < 2:
                break
            if a + b > room:
                high -= 1
                continue
            if a + b > sum(best):
                best = (a, b)
            if a + b == room:
                break
            low += 1
        return best


def plan_patterns(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Patterns with their multiplicities that pack all counted lengths."""
    hist, out = Histogram(counts), []
    while hist.left.any():
        used: dict[int, int] = {}
        pattern: list[int] = []
        gap = capacity
        while gap and (length := hist.longest(gap, used)):
            pattern.append(length)
            used[length] = used.get(length, 0) + 1
            gap -= length
        while gap and len(pattern) > 1:
            small = min(pattern)
            pair = hist.best_pair(small + gap, used)
            if sum(pair) <= small:
                break
            pattern.remove(small)
            used[small] -= 1
            for length in pair:
                pattern.append(length)
                used[length] = used.get(length, 0) + 1
            gap += small - sum(pair)
        used = {k: n for k, n in used.items() if n}
        times = min(int(hist.left[k]) // n for k, n in used.items())
        for k, n in used.items():
            hist.left[k] -= n * times
        out.append((sorted(pattern, reverse=True), times))
    return out


def allotments(patterns: list[tuple[list[int], int]], capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first rank, first sequence and offset of each of its runs of places."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    taken = np.zeros(capacity + 1, np.int64)
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            runs.setdefault(length, []).append((int(taken[length]), sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    return {k: tuple(np.array(x, dtype=np.int64) for x in zip(*v)) for k, v in runs.items()}


RESULT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _places(runs: dict) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length).tolist():
                at = np.flatnonzero(length == k)
                first, begins, offsets = runs[k]
                which = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at] = begins[which] + rank[at] - first[which]
                offset[at] = offsets[which]
            columns = [batch.column(k) for k in range(5)]
            columns[3] = pa.array(length.astype(np.int64))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, encoder: Callable, end_id: int, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its sequence and its offset there."""
    spark = docs.sparkSession
    short_batches(spark)
    rows = columns(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = Written(rows.mapInArrow(_pieces(encoder, end_id, capacity), PIECES), "pieces").df
    by_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most capacity rows
        counts[r["length"]] = r["n"]
    runs = allotments(plan_patterns(counts, capacity), capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(offsets, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("place") + F.col("base")).alias("rank")
    )
    return ranked.mapInArrow(_places(runs), RESULT)
