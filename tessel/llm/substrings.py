"""Substring dedup with a log-structured index of window hashes (operator 7).

A window is ``window`` consecutive words. Storing the hash of every window would move more
bytes than the texts hold, so the index keeps one *anchor* per stretch of windows: of the
half-length word sequences inside a window the one with the smallest hash. Equal windows
choose equal anchors, so nothing is lost; about one word in thirteen starts an anchor.

The index is a set of sorted immutable runs, each dealt into the same buckets by anchor: anchor
hash, hash of the whole stretch of words whose windows chose it, and the first document and place
that has it. A new batch of documents, all with larger ids than the indexed ones, becomes a run;
it is merge-joined with the runs before it, bucket by bucket as they lie, so no older run is ever
shuffled; the finds are verified; and more than ``fan_out`` runs are compacted into one, which
keeps of each stretch its first holder. Verification is by hashes of the words: a stretch that
occurs whole in an earlier document (64 bits of anchor and 64 of stretch agree) settles all its
windows at once; where stretches of one anchor differ, their first documents are read again and
each of their windows is compared by 128 bits of its words. The words themselves are not compared.

Documents lie in slots, which are the splits they were read in, or hashes of their ids where they
come without. A slot hands on each of its stretches once, whatever the number of its documents
that hold it, so a passage that very many documents share is no hot key; what the index finds
goes back to the slots, where the documents' anchors and texts lie, and neither is shuffled.

Cases: null, empty and short texts have no window; white space is the ASCII one only and
words stay as they are; within one document nothing is removed for its own repeats; rows
that repeat a doc_id are forms of one document and never remove one another's words; a document without an id is no other's copy and stays whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tessel.llm.common import Bucketed, Written, plain, settings, short_batches, written

WINDOW = 50
#: Runs that stay side by side before they are merged, and batches in which a table is indexed.
FAN_OUT = 2
BATCHES = 4

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, which is what bytes.split knows."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive values: a polynomial from prefix sums, then mixed."""
    n = len(hashes)
    powers = np.ones(n + 1, np.uint64)
    powers[1:] = _INVERSE
    powers = np.multiply.accumulate(powers)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * powers[:n])))
    up = np.full(n - size + 1, _ODD)
    up[0] = 1
    return _mix((sums[size:] - sums[:-size]) * np.multiply.accumulate(up))


def stretches(words: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """anchor hash, first window and number of windows of every stretch that shares an anchor."""
    none = np.zeros(0, np.int64)
    if len(words) < window:
        return none.astype(np.uint64), none, none
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(w) for w in words], dtype=np.uint64)
    part = (window + 1) // 2
    inner = rolling(hashes, part)
    views = np.lib.stride_tricks.sliding_window_view(inner, window - part + 1)
    chosen = views.argmin(axis=1) + np.arange(len(views))
    begins = np.concatenate(([0], np.flatnonzero(np.diff(chosen)) + 1))
    counts = np.diff(np.append(begins, len(views)))
    return inner[chosen[begins]], begins, counts


#: form: a hash of the text, which tells apart rows that repeat a doc_id.
OCCURS = "slot int, doc_id long, form long, anchor long, stretch long, begin int, n int"
#: A row for each stretch and slot, or for each stretch where runs were compacted: the first document that has it; last: the greatest doc_id.
RUN = "anchor long, stretch long, doc_id long, form long, slot int, begin int, n int, last long"
FIRST = ("doc_id", "form", "slot", "begin", "n")

#: Under these, sorted buckets are merged as they lie, and rows that lie by slot needn't be dealt again for joins on more columns.
AS_THEY_LIE = {
    "spark__sql__legacy__bucketedTableScan__outputOrdering": "true",
    "spark__sql__execution__replaceHashWithSortAgg": "true",
    "spark__sql__requireAllClusterKeysForCoPartition": "false",
}


def bucket_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slots(spark: SparkSession, buckets: int) -> list[int]:
    """For each bucket a number that Spark deals into it."""
    wide = 32 * buckets
    while True:
        number = F.col("id").cast("int")
        found = spark.range(wide).groupBy(F.pmod(F.hash(number), F.lit(buckets)).alias("b")).agg(F.min(number).alias("v")).collect()  # a row for each bucket
        if len(found) == buckets:
            return [r["v"] for r in sorted(found, key=lambda r: r["b"])]
        wide *= 2


def laid_out(docs: DataFrame, buckets: int, by_split: bool = False) -> Bucketed:
    """The documents in slots: by the split they are read in, without moving any; or by a hash of id and form, the same for all tables."""
    spark = docs.sparkSession
    if by_split:
        docs = docs.withColumn("slot", F.get(F.lit(slots(spark, buckets)), F.pmod(F.spark_partition_id(), F.lit(buckets))))
    elif "slot" not in docs.columns:
        docs = docs.withColumn("slot", F.hash("doc_id", "form")).repartition(buckets, "slot")
    return Bucketed(docs, "documents", buckets, ["slot"], sort=False)


def _anchor_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = xxhash.xxh3_64_intdigest
        for batch in batches:
            places, docs, forms, anchors, whole, begins, counts = [], [], [], [], [], [], []
            for slot, doc_id, form, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                words = words_of(text)
                anchor, begin, n = stretches(words, window)
                if not len(anchor):
                    continue
                joined = b" ".join(words)
                ends = np.cumsum([len(w) + 1 for w in words])
                first = np.concatenate(([0], ends[:-1]))[begin].tolist()
                last = (ends[begin + n + window - 2] - 1).tolist()
                whole.append(np.array([h(joined[a:b]) for a, b in zip(first, last)], dtype=np.uint64))
                anchors.append(anchor)
                begins.append(begin)
                counts.append(n)
                places.append(np.full(len(begin), slot, np.int32))
                docs.append(np.full(len(begin), doc_id, np.int64))
                forms.append(np.full(len(begin), form, np.int64))
            if docs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in (places, docs, forms, [a.view(np.int64) for a in anchors], [w.view(np.int64) for w in whole], [b.astype(np.int32) for b in begins], [c.astype(np.int32) for c in counts])],
                    names=["slot", "doc_id", "form", "anchor", "stretch", "begin", "n"],
                )

    return run


def _window_rows(window: int):
    """Hashes of the windows asked for: slot, doc_id, form, text and stretches in; one row per window out, with its place in its stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = xxhash.xxh3_128_digest
        for batch in batches:
            found, rows = [], []
            for slot, doc_id, form, text, asked in zip(*(batch.column(k).to_pylist() for k in range(5))):
                words = words_of(text)
                joined = b" ".join(words)
                ends = np.cumsum([len(w) + 1 for w in words])
                first = np.concatenate(([0], ends[:-1])).tolist()
                for x in asked:
                    found += [h(joined[first[p] : ends[p + window - 1] - 1]) for p in range(x["begin"], x["begin"] + x["n"])]
                    rows += [(slot, doc_id, form, x["anchor"], x["stretch"], k) for k in range(x["n"])]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            columns = zip(*rows) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["window", "slot", "doc_id", "form", "anchor", "stretch", "k"])

    return run


class FingerprintIndex:
    """Runs of anchors. Documents come in batches of ascending ids.

    folder: where the runs are kept for later applications, which ``open`` them by their
    paths; by default they last as long as this one. buckets: the same for all its runs.
    """

    def __init__(self, window: int = WINDOW, fan_out: int = FAN_OUT, folder: str | None = None, buckets: int | None = None):
        self.window, self.fan_out, self.folder, self.buckets = window, fan_out, folder, buckets
        self.runs: list[Bucketed] = []
        self.compactions = 0

    @classmethod
    def open(cls, spark: SparkSession, paths: list[str], folder: str, window: int = WINDOW, fan_out: int = FAN_OUT) -> FingerprintIndex:
        self = cls(window, fan_out, folder)
        self.runs = [Bucketed.at(spark, p, RUN, ["anchor"]) for p in paths]
        self.buckets = self.runs[0].buckets if self.runs else None
        return self

    @property
    def paths(self) -> list[str]:
        return [r.path for r in self.runs]

    def add(self, docs: DataFrame, stored: DataFrame | None = None) -> DataFrame:
        """Indexes the batch; returns its duplicated stretches of windows: doc_id, form, begin, n.

        docs, stored: doc_id, text and form of the batch, and of all documents that the index has
        seen, the batch included (by default the batch alone); texts are read from there.
        """
        self.buckets = self.buckets or bucket_count(docs.sparkSession)
        lying = laid_out((docs if stored is None else stored).select("doc_id", "text", "form"), self.buckets)
        batch = lying if stored is None else laid_out(docs.select("doc_id", "text", "form"), self.buckets)
        return self.add_anchors(self.anchors(batch.df).df, lying.df).select("doc_id", "form", "begin", "n")

    def anchors(self, docs: DataFrame) -> Bucketed:
        """The stretches of documents that lie in slots, in the same slots."""
        short_batches(docs.sparkSession)
        found = docs.where("doc_id is not null").select("slot", "doc_id", "form", "text").mapInArrow(_anchor_rows(self.window), OCCURS)
        return Bucketed(found, "occurs", self.buckets, ["slot"], sort=False)

    def add_anchors(self, occurs: DataFrame, stored: DataFrame) -> DataFrame:
        """The same for a batch whose anchors lie in slots, as do the documents in stored: slot, doc_id, form, begin, n."""
        with settings(occurs.sparkSession, **AS_THEY_LIE):
            once = occurs.groupBy("slot", "anchor", "stretch").agg(F.min(F.struct("doc_id", "form", "begin", "n")).alias("first"), F.max("doc_id").alias("last"))
            rows = once.select("anchor", "stretch", "first.doc_id", "first.form", "slot", "first.begin", "first.n", "last")
            new = Bucketed(rows.repartition(self.buckets, "anchor"), "anchors", self.buckets, ["anchor"], folder=self.folder)
            found = self._duplicates(new, occurs, stored)
            self.runs.append(new)
            self._compact()
        return found

    def _compact(self) -> None:
        """Joins all runs into one, bucket by bucket, if they are too many."""
        if len(self.runs) <= self.fan_out:
            return
        merged = self._all([r.df for r in self.runs]).groupBy("anchor", "stretch").agg(F.min(F.struct(*FIRST)).alias("first"), F.max("last").alias("last"))
        new = Bucketed(merged.select("anchor", "stretch", *(f"first.{c}" for c in FIRST), "last"), "anchors", self.buckets, ["anchor"], folder=self.folder)
        for run in self.runs:
            run.drop()
        self.runs, self.compactions = [new], self.compactions + 1

    @staticmethod
    def _all(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def shared(self, new: DataFrame) -> DataFrame:
        """anchor, differ: the new run's anchors that an earlier document has, by a merge join with each older run."""
        both = new.groupBy("anchor").agg(F.min("doc_id").alias("first"), F.max("last").alias("last"), F.min("stretch").alias("lo"), F.max("stretch").alias("hi"))
        for old in self.runs:
            held = old.df.groupBy(F.col("anchor")).agg(F.min("doc_id").alias("f"), F.min("stretch").alias("l"), F.max("stretch").alias("h"))
            met = both.join(held.hint("merge"), "anchor", "left")
            both = met.select("anchor", F.least("first", "f").alias("first"), "last", F.least("lo", "l").alias("lo"), F.greatest("hi", "h").alias("hi"))
        return both.where("first < last").select("anchor", (F.col("lo") != F.col("hi")).alias("differ"))

    def _duplicates(self, new: Bucketed, occurs: DataFrame, stored: DataFrame) -> DataFrame:
        spark = new.spark
        # Written first, the small sides leave the other sides of their joins to be split where a key is hot.
        shared = written(self.shared(new.df), "shared")
        parts = [new.df.withColumn("new", F.lit(True)), *(r.df.withColumn("new", F.lit(False)) for r in self.runs)]
        met = Written(self._all([p.join(shared, "anchor") for p in parts]), "met", narrow=True).df
        holders = written(met.groupBy("anchor", "stretch").agg(F.min(F.struct(*FIRST)).alias("first"), F.max("differ").alias("differ")), "holders")
        told = met.where("new").join(holders.select("anchor", "stretch", F.col("first.doc_id").alias("holder")), ["anchor", "stretch"]).where("last > holder")
        told = Written(told.select("slot", "anchor", "stretch", "holder"), "told", narrow=True).df
        whole = occurs.join(told.hint("shuffle_hash"), ["slot", "anchor", "stretch"]).where("doc_id > holder").select("slot", "doc_id", "form", "begin", "n")
        # Where one anchor stands in different stretches, the first holder of each shows its windows.
        asked = holders.where("differ").select("first.*", "anchor", "stretch").groupBy("slot", "doc_id", "form").agg(F.collect_list(F.struct("begin", "n", "anchor", "stretch")).alias("asked"))
        texts = stored.select("slot", "doc_id", "form", "text").join(asked.hint("shuffle_hash"), ["slot", "doc_id", "form"])
        short_batches(spark)
        windows = Written(texts.select("slot", "doc_id", "form", "text", "asked").mapInArrow(_window_rows(self.window), "window binary, slot int, doc_id long, form long, anchor long, stretch long, k int"), "windows", narrow=True)
        owners = windows.df.groupBy("window").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").select("window", "owner")
        seen = windows.df.join(written(owners, "owners"), "window").where("doc_id > owner").select("slot", "doc_id", "form", "anchor", "stretch", "k")
        # The holder may have the stretch at several places.
        single = occurs.join(written(seen, "seen").hint("shuffle_hash"), ["slot", "doc_id", "form", "anchor", "stretch"])
        return written(whole.unionByName(single.select("slot", "doc_id", "form", (F.col("begin") + F.col("k")).alias("begin"), F.lit(1).alias("n"))), "duplicated")


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _cut(window: int, texts: bool, carry: list[str]):
    """doc_id, text, begins, counts and the carried columns in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digests, kept_texts = [], [], [], []
            for text, begins, counts in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                words = words_of(text)
                kept = words
                if begins:
                    steps = np.zeros(len(words) + 1, np.int64)
                    np.add.at(steps, begins, 1)
                    np.add.at(steps, np.array(begins) + np.array(counts) + window - 1, -1)
                    covered = np.cumsum(steps[:-1]) > 0
                    kept = [w for w, c in zip(words, covered.tolist()) if not c]
                joined = b" ".join(kept)
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(joined).hexdigest())
                kept_texts.append((text if not begins else joined.decode("utf-8", "surrogatepass")) if texts else None)
            found = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept_texts, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *found, *batch.columns[4:]], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept", *carry])

    return run


def remove_duplicates(docs: DataFrame, batches: int = BATCHES, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", texts: bool = False, extra: list[str] | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256; with texts also kept (the text, untouched where
    nothing goes) and all other columns, named as by ``plain`` (those of extra keep their names).

    The table goes through the index in ``batches`` batches of ascending ids, split at
    approximate quantiles; where they are split doesn't change the result.
    """
    docs, _ = plain(docs, doc_id=id_col, text=text_col, **{c: c for c in extra or ()})
    docs = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")}).withColumn("form", F.xxhash64("text"))
    carry = [c for c in docs.columns if c not in ("doc_id", "text", "form")] if texts else []
    spark = docs.sparkSession
    short_batches(spark)
    buckets = bucket_count(spark)
    lying = laid_out(docs.select("doc_id", "text", "form", *carry), buckets, by_split=True)
    docs = lying.df
    index = FingerprintIndex(window, buckets=buckets)
    occurs = index.anchors(docs)
    cuts = sorted(set(docs.where("doc_id is not null").approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01))) if batches > 1 else []
    edges = [None, *(int(c) for c in cuts), None]
    found = []
    for low, high in zip(edges, edges[1:]):
        batch = occurs.df
        if low is not None:
            batch = batch.where(F.col("doc_id") > low)
        if high is not None:
            batch = batch.where(F.col("doc_id") <= high)
        found.append(index.add_anchors(batch, docs))
    occurs.drop()
    for run in index.runs:
        run.drop()
    with settings(spark, **AS_THEY_LIE):
        spans = index._all(found).groupBy("slot", "doc_id", "form").agg(F.collect_list(F.struct("begin", "n")).alias("spans"))
        joined = docs.join(spans.hint("shuffle_hash"), ["slot", "doc_id", "form"], "left").select("doc_id", "text", "spans.begin", "spans.n", *carry)
        schema = StructType(StructType.fromDDL(RESULT).fields + [StructField(c, docs.schema[c].dataType) for c in carry])
        out = joined.mapInArrow(_cut(window, texts, carry), schema)
        out = Written(out if texts else out.drop("kept"), "cut")
    lying.drop()
    return out.df
