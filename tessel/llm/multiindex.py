"""Nearest neighbours by an inverted multi-index (operator 10).

Vectors are scaled to length one and cut in two halves; each half has its own codebook, so
``codes`` centroids a half make ``codes``² cells, more of them the more entries there are. A query
walks the pairs of centroids in the order of summed distance with a heap, until the cells it has
met hold the share ``visit`` of all entries (and more than k of them); those entries are ranked
again by the exact cosine of the original vectors. Codebooks and share are fitted on a bounded
sample: the share is the least that finds RECALL of the sample's own neighbours, so clustered
vectors get by with little, and since neighbours in a sample are farther than in the whole table,
the whole table's are found at least as well. Every row is in the index.

Cells are gathered into shards of about ``shard`` entries by their counts (the table of
counts has a fixed size); a cell that holds more is spread over several. Copies of a vector
are one entry that lists its smallest ids, as many as a result can use. Entries go to their shard
once; queries go to the shards of their cells and stream past them, so a task holds one shard and
one batch of queries.

Cases: rows without a vec_id, and vectors that are null, empty, zero or hold null or non-finite components are neither
entries nor queries; vectors of another dimension than the query are no candidates; fewer
candidates than k give fewer rows; an empty table gives an empty result. Rows that repeat a
vec_id are candidates of one another only under different ids.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.common import Written, columns, drawn_by_hash, short_batches
from tessel.llm.vectors import by_dimension, matrix, unit, usable, vector_key

#: Centroids of a half at CODES_AT entries; they grow with the fourth root, up to MOST_CODES.
CODES, CODES_AT, MOST_CODES = 32, 50_000, 256
SAMPLE = 8192
#: Share of a sample's neighbours that its walks have to find, and walks that are tried.
RECALL, TRIED = 0.99, 512
SHARD = 8192
SEED = 10


def codes_for(n: int) -> int:
    return int(np.clip(round(CODES * (n / CODES_AT) ** 0.25), 8, MOST_CODES))


def fit_codebook(points: np.ndarray, codes: int, rounds: int = 10, seed: int = SEED) -> np.ndarray:
    """Lloyd's algorithm; an empty cluster keeps its centroid."""
    rng = np.random.default_rng(seed)
    centers = points[rng.choice(len(points), min(codes, len(points)), replace=False)]
    for _ in range(rounds):
        near = distances(points, centers).argmin(axis=1)
        for k in np.unique(near):
            centers[k] = points[near == k].mean(axis=0)
    return centers


def distances(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (points * points).sum(axis=1)[:, None] - 2 * points @ centers.T + (centers * centers).sum(axis=1)[None, :]


class MultiIndex:
    """Two codebooks for one dimension."""

    def __init__(self, units: np.ndarray, codes: int = CODES):
        self.cut = units.shape[1] // 2
        self.books = [fit_codebook(units[:, : self.cut].copy(), codes), fit_codebook(units[:, self.cut :].copy(), codes)]
        self.shape = tuple(len(b) for b in self.books)

    def halves(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(units[:, : self.cut], self.books[0]), distances(units[:, self.cut :], self.books[1])

    def cells(self, units: np.ndarray) -> np.ndarray:
        first, second = self.halves(units)
        return first.argmin(axis=1) * self.shape[1] + second.argmin(axis=1)

    def walk(self, first: np.ndarray, second: np.ndarray) -> Iterator[int]:
        """Cells by summed distance: a pair enters the heap once both pairs before it are out."""
        a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
        x, y = first[a].tolist(), second[b].tolist()
        a, b = a.tolist(), b.tolist()
        heap, done = [(x[0] + y[0], 0, 0)], [0] * len(x)
        while heap:
            _, i, j = heapq.heappop(heap)
            yield a[i] * self.shape[1] + b[j]
            done[i] = j + 1
            if i + 1 < len(x) and done[i + 1] == j:
                heapq.heappush(heap, (x[i + 1] + y[j], i + 1, j))
            if j + 1 < len(y) and (i == 0 or done[i - 1] > j + 1):
                heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))

    def visited(self, first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
        out, seen = [], 0
        for cell in self.walk(first, second):
            if counts[cell]:
                out.append(cell)
                seen += int(counts[cell])
                if seen >= enough:
                    break
        return out


def fit_visit(index: MultiIndex, units: np.ndarray, k: int, recall: float = RECALL, tried: int = TRIED) -> float:
    """The least share of the entries in walked cells with which this share of the nearest neighbours is met."""
    if len(units) <= k + 1:
        return 1.0
    cells = index.cells(units)
    counts = np.bincount(cells, minlength=index.shape[0] * index.shape[1])
    asked = np.random.default_rng(SEED).permutation(len(units))[:tried]
    scores = units[asked] @ units.T
    scores[np.arange(len(asked)), asked] = -np.inf
    nearest_ = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    first, second = index.halves(units[asked])
    shares = []
    for n in range(len(asked)):
        order = np.argsort(np.add.outer(first[n], second[n]).ravel(), kind="stable")
        met = np.empty(len(order))
        met[order] = np.cumsum(counts[order])
        shares.append(met[cells[nearest_[n]]] / len(units))
    return float(min(1.0, np.quantile(np.concatenate(shares), recall, method="higher")))


def shard_cells(counts: np.ndarray, shard: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each cell its first shard and in how many it is spread; the number of shards."""
    first, parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    now, room = 0, shard
    for cell in np.flatnonzero(counts).tolist():
        n = int(counts[cell])
        if n > shard:
            now += room < shard
            parts[cell] = -(-n // shard)
            first[cell] = now
            now, room = now + int(parts[cell]), shard
            continue
        if n > room:
            now, room = now + 1, shard
        first[cell], room = now, room - n
    return first, parts, now + 1


def _top(scores: np.ndarray, ids: list, query_ids: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """The k best (query, id, score) of each row of scores, ties to smaller ids; ids are lists for each column."""
    for row, query in zip(scores, query_ids.tolist()):
        if len(row) > k + 1:
            bar = np.partition(row, len(row) - k - 1)[len(row) - k - 1]
            near = np.flatnonzero(row >= bar)
        else:
            near = np.arange(len(row))
        near = near[row[near] > -np.inf]
        found = sorted((-row[c], i) for c in near.tolist() for i in ids[c] if i != query)[:k]
        for s, i in found:
            yield query, i, -s


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, visit: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score; queries are the rows whose id is divisible by ``every``. visit: the share, if it isn't to be fitted."""
    spark = vectors.sparkSession
    rows = columns(vectors, vec_id=id_col, embedding=vector_col).withColumn("vec_id", F.col("vec_id").cast("long"))
    good = rows.where(usable("embedding") & F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), *vector_key("embedding"), F.size("embedding").cast("int").alias("dim"))
    ranked = good.withColumn("nth", F.row_number().over(Window.partitionBy("dim", "k1", "k2").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    classes = ranked.groupBy("dim", "k1", "k2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("embedding").alias("embedding"))
    entries = Written(classes.select("dim", "ids", "embedding"), "entries").df
    short_batches(spark, 1024)
    dims = sorted((r["dim"], r["count"]) for r in entries.groupBy("dim").count().collect())  # one row for each dimension in use
    found = [_nearest(good.where(F.col("dim") == d).select("vec_id", "embedding"), entries.where(F.col("dim") == d), n, k, every, visit) for d, n in dims]
    out = found[0] if found else spark.createDataFrame([], "query_id long, vec_id long, score double")
    for more in found[1:]:
        out = out.unionByName(more)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = out.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def _nearest(rows: DataFrame, entries: DataFrame, n_entries: int, k: int, every: int, visit: float | None) -> DataFrame:
    drawn = entries.where(drawn_by_hash(F.col("embedding"), SAMPLE, n_entries)).orderBy(F.xxhash64("embedding")).select("embedding").toArrow()
    if not len(drawn):
        drawn = entries.limit(1).select("embedding").toArrow()
    points = unit(matrix(drawn.column(0).combine_chunks()))
    index = MultiIndex(points, codes_for(n_entries))
    visit = fit_visit(index, points, k) if visit is None else visit
    del points

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = index.cells(unit(matrix(batch.column(1)))) if len(batch) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells.astype(np.int32))], names=["ids", "embedding", "cell"])

    placed = Written(entries.select("ids", "embedding").mapInArrow(place, "ids array<long>, embedding array<double>, cell int"), "cells").df
    counts = np.zeros(index.shape[0] * index.shape[1], np.int64)
    for r in placed.groupBy("cell").count().collect():  # at most MOST_CODES squared rows
        counts[r["cell"]] = r["count"]
    first, parts, shards = shard_cells(counts, SHARD)
    enough = max(int(np.ceil(visit * counts.sum())), k + 1)  # the query's own entry is among them
    queries = rows.where(F.col("vec_id") % every == 0)
    names = ["shard", "asks", "ids", "embedding", "cells"]

    def to_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(2).to_numpy()
            lead = np.array([i[0] for i in batch.column(0).to_pylist()], dtype=np.int64)
            shard = first[cells] + (lead * 2654435761 >> 7) % parts[cells]
            own = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32)), batch.column(2))
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(np.zeros(len(batch), bool)), batch.column(0), batch.column(1), own], names=names)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            a, b = index.halves(unit(matrix(batch.column(1))))
            at, shard, cells = [], [], []
            for n in range(len(batch)):
                met: dict[int, list[int]] = {}
                for cell in index.visited(a[n], b[n], counts, enough):
                    for part in range(int(parts[cell])):
                        met.setdefault(int(first[cell]) + part, []).append(cell)
                for s, c in met.items():
                    at.append(n)
                    shard.append(s)
                    cells.append(c)
            some = batch.take(pa.array(at, pa.int64()))
            ids = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32)), some.column(0).cast(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(np.ones(len(some), bool)), ids, some.column(1), pa.array(cells, pa.list_(pa.int32()))], names=names)

    def rank(entries: list[pa.RecordBatch], asked: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(entries).combine_chunks()
        ids = whole.column(2).to_pylist()
        units = unit(matrix(whole.column(3).chunk(0)))
        cell = whole.column(4).chunk(0).flatten().to_numpy()
        for at in range(0, len(asked), rows):
            some = asked.slice(at, rows)
            scores = unit(matrix(some.column(3))) @ units.T
            met = np.zeros((len(some), len(counts)), bool)
            for n, c in enumerate(some.column(4)):
                met[n, c.values.to_numpy()] = True
            scores[~met[:, cell]] = -np.inf
            best = list(_top(scores, ids, some.column(2).flatten().to_numpy(), k))
            query, vec, score = zip(*best) if best else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "vec_id", "score"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, entries = None, []
        for batch in batches:
            shard, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            turns = np.flatnonzero((np.diff(shard) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for begin, end in zip([0, *turns.tolist()], [*turns.tolist(), len(batch)]):
                if begin == end:
                    continue
                if shard[begin] != now:
                    now, entries = shard[begin], []
                part = batch.slice(begin, end - begin)
                if not asks[begin]:
                    entries.append(part)
                elif entries:
                    yield from rank(entries, part)

    kind = "shard int, asks boolean, ids array<long>, embedding array<double>, cells array<int>"
    both = placed.mapInArrow(to_shard, kind).unionByName(queries.mapInArrow(route, kind))
    return both.repartition("shard").sortWithinPartitions("shard", "asks").mapInArrow(stream, "query_id long, vec_id long, score double")
