"""SimHash near-duplicates through vantage-point trees (operator 8).

Fingerprints that link differ in at most ``reach`` bits, so they differ in at most
``reach // 2`` bits of one half. For each half there is one vantage-point tree over the
Hamming distance of that half: a node has a vantage point and a radius; a fingerprint lives
on one side of it, and as a query it goes to both sides unless the triangle inequality rules
one out. A query that may differ in one bit only keeps count of the bits that can still be the
one: near a border those that lead across go to the other side and the rest stay, so a query
visits no leaf but those of its 32 neighbours. Where many fingerprints share a half, a node measures all 64 bits with the whole
reach instead. The trees come from a sample of the distinct fingerprints, which grows with them
up to ``MOST_SAMPLE``; they set only the shards' sizes, never the result. Every leaf is a shard; a
shard goes on with a tree of its own members, compares in its leaves those who live there with
all who come by, and returns the links that join its members, at most one
fewer than it has rows. Copies are one fingerprint from the start.

Cases: null and empty texts, and texts of white space, have fingerprint zero, which links
like any other; texts of fewer words than a shingle are one shingle; rows that repeat an id
each get a row and are one node of the components; a null id has a fingerprint but no component, and links with nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import Written, columns, drawn_by_hash, short_batches
from tessel.llm.components import components

SHINGLE = 3
REACH = 3
#: Distinct fingerprints aimed at in a shard, and those that the trees are drawn from.
SHARD = 8192
SAMPLE = 32_768
MOST_SAMPLE = 1 << 20
#: Fingerprints aimed at in a leaf within a shard.
LEAF = 256

HALVES = (np.uint64(0xFFFFFFFF00000000), np.uint64(0x00000000FFFFFFFF))
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint; bytes.lower and bytes.split know ASCII only, as the contract asks."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [h(b" ".join(words), 42)]
    elif shingle == 3:
        hashes = [h(b"%b %b %b" % t, 42) for t in zip(words, words[1:], words[2:])]
    else:
        hashes = [h(b" ".join(words[k : k + shingle]), 42) for k in range(len(words) - shingle + 1)]
    return majority(np.array(hashes, dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255):  # byte sums of 255 rows at most can't overflow
        bits = np.unpackbits(hashes[at : at + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    short_batches(docs.sparkSession)
    rows = columns(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, fp long")


class VantageTree:
    """Inner nodes in arrays; a negative child is leaf -1 - child."""

    def __init__(self, sample: np.ndarray, half: int, reach: int, leaf: int):
        self.point, self.radius, self.mask, self.span, self.near, self.far = [], [], [], [], [], []
        self.leaves, self.single = 0, reach // 2 == 1
        self.root = self._grow(sample, HALVES[half], reach // 2, reach, max(2, leaf))
        self.half = half

    def _grow(self, sample: np.ndarray, mask: np.uint64, span: int, reach: int, leaf: int) -> int:
        best = None
        if len(sample) > leaf:
            for m, s in ((mask, span), (ALL, reach)):
                for point in (sample[0], sample[len(sample) // 2], sample[-1]):
                    d = np.bitwise_count((sample ^ point) & m)
                    radius = int(np.median(d)) if d.any() else 0
                    for r in (radius - 1, radius):
                        inside = int((d <= r).sum())
                        if 0.1 * len(sample) <= inside <= 0.9 * len(sample):
                            cost = np.log(max(inside, len(sample) - inside) / len(sample)) / (1 + ((d > r - s) & (d <= r + s)).mean())
                            if best is None or cost < best[0]:
                                best = (cost, point, r, m, s, d)
                if best is not None:
                    break
        if best is None:
            self.leaves += 1
            return -self.leaves
        _, point, radius, m, s, d = best
        node = len(self.point)
        for values, value in ((self.point, point), (self.radius, radius), (self.mask, m), (self.span, s), (self.near, 0), (self.far, 0)):
            values.append(value)
        self.near[node] = self._grow(sample[d <= radius], mask, span, reach, leaf)
        self.far[node] = self._grow(sample[d > radius], mask, span, reach, leaf)
        return node

    def walk(self, values: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each leaf that any value visits: leaf, indices of the visitors, which of them live there."""
        # same: values with this very half may be here; flips: the bits of the half of which one may differ.
        whole = np.ones(len(values), bool)
        stack = [(self.root, np.arange(len(values)), whole, whole, np.full(len(values), HALVES[self.half]))]
        while stack:
            node, at, home, same, flips = stack.pop()
            if not len(at):
                continue
            if node < 0:
                yield -1 - node, at, home
                continue
            bits = (values[at] ^ self.point[node]) & self.mask[node]
            d = np.bitwise_count(bits).astype(np.int64)
            radius, span = self.radius[node], self.span[node]
            inside = d <= radius
            near, far = d <= radius + span, d > radius - span
            near_same = far_same = same
            near_flips = far_flips = flips
            if self.single and self.mask[node] != ALL:
                border = (d == radius) | (d == radius + 1)
                near_flips, far_flips = np.where(border, flips & bits, flips), np.where(border, flips & ~bits, flips)
                near_same, far_same = same & inside, same & ~inside
                near &= (near_flips != 0) | near_same
                far &= (far_flips != 0) | far_same
            stack.append((self.near[node], at[near], (home & inside)[near], near_same[near], near_flips[near]))
            stack.append((self.far[node], at[far], (home & ~inside)[far], far_same[far], far_flips[far]))


class Union:
    """Union-find over a shard's rows."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            roots = self.roots()
            a, b = roots[a], roots[b]
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            keep = lo != hi
            lo, hi = lo[keep], hi[keep]
            if not len(lo):
                return
            np.minimum.at(self.parent, hi, lo)
            a, b = lo, hi


def shard_links(values: np.ndarray, home: np.ndarray, half: int, reach: int, shard: int, rows: int = 256) -> Iterator[tuple[int, int]]:
    """Pairs of row numbers that join the shard's linked rows.

    A tree of those that live there cuts the shard further, however many they are; each row is
    compared with all that live in the leaves it comes by.
    """
    union = Union(len(values))
    parts = [(np.arange(len(values)), home)]
    leaf = min(LEAF, shard)
    if home.sum() > 2 * leaf:
        points = values[home].copy()
        np.random.default_rng(11).shuffle(points)
        tree = VantageTree(points, half, reach, leaf)
        parts = ((at, home[at] & lives) for _, at, lives in tree.walk(values))
    for at, lives in parts:
        live = at[lives]
        for k in range(0, len(at), rows):
            some = at[k : k + rows]
            a, b = np.nonzero(np.bitwise_count(values[some, None] ^ values[live][None, :]) <= reach)
            union.join(some[a], live[b])
    roots = union.roots()
    for k in np.flatnonzero(roots != np.arange(len(values))).tolist():
        yield k, int(roots[k])


def near_links(classes: DataFrame, reach: int = REACH, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """a, b: representatives (column rep) of the distinct fingerprints (column fp), enough to join all that link."""
    n = classes.count()
    sample = max(sample, min(MOST_SAMPLE, 8 * n // shard))
    drawn = classes.where(drawn_by_hash(F.col("fp"), sample, n)).select("fp").collect()
    points = np.sort(np.array([r["fp"] for r in drawn], dtype=np.int64).view(np.uint64))
    np.random.default_rng(7).shuffle(points)
    leaf = max(2, min(shard, n // 32 + 1) * len(points) // max(1, n))
    trees = [VantageTree(points, half, reach, leaf) for half in range(len(HALVES))]
    first = [0, trees[0].leaves]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            for tree, start in zip(trees, first):
                for leaf_no, at, home in tree.walk(values):
                    rows = pa.array(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), start + leaf_no, np.int32)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(home)], names=["shard", "fp", "rep", "home"]
                    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        values, rep = pdf["fp"].to_numpy().view(np.uint64), pdf["rep"].to_numpy()
        half = int(pdf["shard"].iloc[0] >= first[1])
        found = list(shard_links(values, pdf["home"].to_numpy(), half, reach, shard))
        return pd.DataFrame({"a": rep[[x for x, _ in found]], "b": rep[[y for _, y in found]]}, dtype=np.int64)

    short_batches(classes.sparkSession, 100_000)
    sent = classes.select("fp", "rep").mapInArrow(route, "shard int, fp long, rep long, home boolean")
    return sent.groupBy("shard").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest id reachable)."""
    found = Written(fingerprints(docs, id_col, text_col), "fingerprints").df
    classes = Written(found.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprint-classes", narrow=True).df
    links = components(near_links(classes, reach))
    joined = classes.join(links, classes["rep"] == links["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    by_class = Written(joined, "fingerprint-components", narrow=True).df
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    return found.join(by_class, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component)
