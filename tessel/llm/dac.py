"""Token-ID output with directly addressable codes (operator 1).

A segment is one binary value: ids split into chunks of 8 bits, one level per chunk. Level
k holds the k-th chunk of every id that has one, a bitmap tells which of them continue on
level k + 1, and a directory of counts before every 512 bits turns a position on one level
into the position on the next. Any id is found by as many look-ups as it has chunks; no
block is decoded. Segments are rows of Parquet files in ascending order of (doc_id, text),
so any store that Spark can write to holds them, and a lost task is simply written again.

Cases: a null text counts as empty and has only the end id; null ids come first and stay null; repeated ids of documents keep
all their rows, ordered by text; an empty table gives no segment and no row; columns other
than the id and the text are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.common import Written, columns, short_batches

MAGIC = b"TDAC0001"
CHUNK_BITS = 8
RANK_BITS = 512
#: Ids after which a segment ends; a longer document has a segment of its own.
SEGMENT_IDS = 1 << 18


def _pack(*arrays: np.ndarray) -> list[bytes]:
    return [a.tobytes() for a in arrays]


def encode_segment(doc_ids: list[int | None], starts: np.ndarray, ids: np.ndarray) -> bytes:
    """doc_ids: signed 64-bit or null; starts: first position of each document; ids: unsigned 32-bit."""
    null = np.packbits([d is None for d in doc_ids], bitorder="little")
    parts = _pack(np.array([d or 0 for d in doc_ids], dtype="<i8"), null, starts.astype("<i8"))
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> CHUNK_BITS
        goes_on = more > 0
        bits = np.packbits(goes_on, bitorder="little")
        counts = np.add.reduceat(goes_on, np.arange(0, len(rest), RANK_BITS), dtype=np.int64) if len(rest) else np.zeros(0, np.int64)
        directory = np.concatenate(([0], np.cumsum(counts))).astype("<u4")
        levels.append((len(rest), len(bits), len(directory)))
        parts += _pack((rest & ((1 << CHUNK_BITS) - 1)).astype(np.uint8), bits, directory)
        if not goes_on.any():
            break
        rest = more[goes_on]
    head = MAGIC + struct.pack("<qqi", len(doc_ids), len(ids), len(levels))
    return head + b"".join(struct.pack("<qqq", *level) for level in levels) + b"".join(parts)


class Segment:
    """Random access to the ids of one segment."""

    def __init__(self, blob: bytes):
        if blob[: len(MAGIC)] != MAGIC:
            raise ValueError("not a segment of token ids")
        at = len(MAGIC)
        self.n_docs, self.n_ids, n_levels = struct.unpack_from("<qqi", blob, at)
        at += 20
        sizes = [struct.unpack_from("<qqq", blob, at + 24 * k) for k in range(n_levels)]
        at += 24 * n_levels

        def take(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, dtype, n, at)
            at += out.nbytes
            return out

        ids, null = take("<i8", self.n_docs), np.unpackbits(take("u1", -(-self.n_docs // 8)), count=self.n_docs, bitorder="little")
        self.doc_ids = [None if n else d for d, n in zip(ids.tolist(), null.tolist())]
        self.starts = take("<i8", self.n_docs)
        self.levels = [(take("u1", n), take("u1", b), take("<u4", d)) for n, b, d in sizes]

    def _rank(self, level: int, position: int) -> int:
        """Ids before the position that continue on the next level."""
        _, bits, directory = self.levels[level]
        block = position // RANK_BITS
        first = block * RANK_BITS // 8
        count = int(directory[block]) + int(np.bitwise_count(bits[first : position // 8]).sum())
        if position % 8:
            count += (int(bits[position // 8]) & ((1 << position % 8) - 1)).bit_count()
        return count

    def __getitem__(self, position: int) -> int:
        if not 0 <= position < self.n_ids:
            raise IndexError(position)
        value = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[position]) << (CHUNK_BITS * level)
            if not bits[position // 8] >> (position % 8) & 1:
                break
            position = self._rank(level, position)
        return value

    def slice(self, begin: int, end: int) -> np.ndarray:
        """The ids from begin to before end, read level by level from their own places only."""
        out = np.zeros(end - begin, np.uint32)
        where = np.arange(end - begin)
        for level, (chunks, bits, _) in enumerate(self.levels):
            if begin >= end:
                break
            out[where] |= chunks[begin:end].astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            flags = np.unpackbits(bits[begin // 8 : (end + 7) // 8], bitorder="little")[begin % 8 : begin % 8 + end - begin]
            where = where[flags.astype(bool)]
            if not len(where):
                break
            begin = self._rank(level, begin)
            end = begin + len(where)
        return out

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        ends, ids = np.append(self.starts[1:], self.n_ids), self.slice(0, self.n_ids)
        for doc_id, begin, end in zip(self.doc_ids, self.starts.tolist(), ends.tolist()):
            yield doc_id, begin, ids[begin:end]


SEGMENTS = "part int, segment int, first_doc long, n_ids long, blob binary"
DOCUMENTS = "doc_id long, part int, segment int, local_start long, n_tokens long, ids_crc32 long"


def _segments(encoder: Callable, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment = TaskContext.get().partitionId(), 0
        encode, end = encoder(), np.array([end_id], "<u4").tobytes()
        docs: list[int | None] = []
        data: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(x) // 4 for x in data], dtype=np.int64)
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            blob = encode_segment(docs, starts, np.frombuffer(b"".join(data), "<u4"))
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "segment": pa.array([segment], pa.int32()), "first_doc": pa.array([docs[0]], pa.int64()), "n_ids": pa.array([size], pa.int64()), "blob": pa.array([blob], pa.binary())}
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode.ids(text) + end
                if docs and size + len(ids) // 4 > SEGMENT_IDS:
                    yield flush()
                    segment, size = segment + 1, 0
                    docs.clear()
                    data.clear()
                docs.append(doc_id)
                data.append(ids)
                size += len(ids) // 4
        if docs:
            yield flush()

    return run


def write_token_ids(docs: DataFrame, encoder: Callable, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> Written:
    """Writes the ids of every text, in ascending order of the documents' ids.

    encoder: gives, on an executor, an object whose ids(text) returns little-endian unsigned
    32-bit ids. Texts are dealt by ranges of (id, hash of text), so equal ids may still spread.
    """
    short_batches(docs.sparkSession)
    rows = columns(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return Written(ordered.mapInArrow(_segments(encoder, end_id), SEGMENTS), "token-ids")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, number, blob in zip(*(batch.column(k).to_pylist() for k in range(3))):
            found = list(Segment(blob).documents())
            n = len(found)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([d for d, _, _ in found], pa.int64()),
                    "part": pa.array([part] * n, pa.int32()),
                    "segment": pa.array([number] * n, pa.int32()),
                    "local_start": pa.array([b for _, b, _ in found], pa.int64()),
                    "n_tokens": pa.array([len(i) for _, _, i in found], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(i.astype("<u4").tobytes()) for _, _, i in found], pa.int64()),
                }
            )


def read_token_ids(files: Written) -> DataFrame:
    """One row per document from the files: doc_id, start (over all documents), n_tokens, ids_crc32.

    Positions within a segment come from its header; what precedes a segment is summed in two
    steps, within each file's part and then over the parts, whose number is the partitions'.
    """
    table = files.df
    sizes = table.select("part", "segment", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_ids").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    places = (
        sizes.withColumn("in_part", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
        .join(parts, "part")
        .select("part", "segment", (F.col("in_part") + F.col("part_start")).alias("base"))
    )
    found = table.select("part", "segment", "blob").mapInArrow(_read, DOCUMENTS)
    return found.join(places, ["part", "segment"]).select(
        "doc_id", (F.col("base") + F.col("local_start")).cast("long").alias("start"), "n_tokens", "ids_crc32"
    )
