"""Byte-level BPE encoding and decoding over Arrow batches (operator 5).

Encoding works on byte characters: every byte of a text has a printable character, the
tokenizers library merges those, and the offsets of the ids count bytes. Decoding reverses
the byte table; an id may end inside a character, so only whole texts become strings.

Cases: null and empty texts have no ids and decode to no bytes; null and repeated document ids
keep their rows; any string of Spark is
valid UTF-8 and returns unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import columns, short_batches
from tessel.llm.tokens import rank_decoder, rank_encoder


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return columns(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def encode_bpe(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int), offsets (first byte of each id in the text's UTF-8)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = rank_encoder(ranks, pattern), rank_decoder(ranks, pattern)
        for batch in batches:
            ids = [np.frombuffer(encoder.ids(t), "<u4").astype(np.int32) for t in batch.column(1).to_pylist()]
            offsets = [decoder.offsets(i.tolist()) for i in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(offsets, pa.list_(pa.int64()))], names=["doc_id", "ids", "offsets"]
            )

    short_batches(docs.sparkSession)
    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, offsets array<long>")


def decode_bpe(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and the decoded bytes of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = rank_decoder(ranks, pattern)
        for batch in batches:
            data = [decoder.data(i or ()) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    short_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def bpe_digest(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes in one pass and returns digests in place of ids and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = rank_encoder(ranks, pattern), rank_decoder(ranks, pattern)
        words = Decimals()
        for batch in batches:
            n, ids_sha, data_sha = [], [], []
            for text in batch.column(1).to_pylist():
                ids = np.frombuffer(encoder.ids(text), "<u4").tolist()
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(words.__getitem__, ids)).encode()).hexdigest())
                data_sha.append(hashlib.sha256(decoder.data(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(data_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    short_batches(docs.sparkSession)
    return _rows(docs, id_col, text_col).mapInArrow(run, DIGEST)


class Decimals(dict):
    """The decimal string of each id, made once."""

    def __missing__(self, key: int) -> str:
        out = self[key] = str(key)
        return out


def library_ids(path: str) -> Callable:
    """For write_token_ids and packing: makes, on an executor, the encoder of a tokenizers file."""

    def make():
        from tessel.llm.tokens import library_encoder

        return library_encoder(path)

    return make
