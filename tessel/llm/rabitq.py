"""Near-duplicate vectors by randomised-rotation binary codes (operator 6).

A unit vector is rotated at random; the signs are its code, and the inner product of code
and vector is stored as its correction factor. Code times a rotated query, divided by the
factor, estimates the cosine without bias. What the code leaves out is orthogonal to the
vector, so for a cosine of at least t the estimate can't be lower than
``t - sqrt(1/f^2 - 1) * sqrt(1 - t^2)``: pairs below that bound in either direction are
settled, all others are computed again in double precision from the original components.

Only vectors of one label (and dimension) meet. Exact copies are one vector with a count. What
meets are codes: blocks of packed signs, factors and rotated vectors in eight bits. A pair whose
signs differ in more bits than one at the threshold does with a chance of ``miss`` (1e-9) is
refuted by counting bits; the estimates with their factors, less what eight bits can cost, refute
others for certain; and the vectors that have a partner left are fetched for the exact cosine.
Labels of any size go the same way, in pairs of blocks, so comparisons of codes, which are cheap,
grow with the square of a label's distinct vectors, and little else does.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and null
labels, link with nothing and keep their row; rows that repeat a vec_id each get a row and share the count and the component; a row without a
vec_id links with nothing, has no component and isn't kept;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import Written, columns, short_batches, written
from tessel.llm.components import components
from tessel.llm.simhash import Union
from tessel.llm.vectors import by_dimension, matrix, rotation, unit, usable, vector_key

THRESHOLD = 0.98
#: Distinct vectors of a block, and the chance that bit counts refute a pair at the threshold.
BLOCK = 4096
MISS = 1e-9
SEED = 20


def encode(units: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated vectors, packed sign codes and correction factors."""
    dim = units.shape[1]
    turned = units @ rotation(dim, seed).T
    signs = turned >= 0
    return turned, np.packbits(signs, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(dim)


def signs_of(codes: np.ndarray, dim: int) -> np.ndarray:
    return (np.unpackbits(codes, axis=1, count=dim).astype(np.float64) * 2 - 1) / math.sqrt(dim)


def lowest_estimate(factors: np.ndarray, threshold: float) -> np.ndarray:
    """No pair at the threshold has a smaller estimate than this for the coded vector."""
    f = np.minimum(factors, 1.0)
    return threshold - np.sqrt(np.maximum(0.0, 1 / (f * f) - 1)) * math.sqrt(1 - threshold * threshold) - 1e-9


def most_flips(dim: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """A pair at the threshold differs in more sign bits than this with a chance under ``miss``.

    Signs under a random rotation differ with the angle's share of a half turn. With few dimensions
    they depend too much on one another, so that nothing is refuted.
    """
    if dim < 32:
        return dim
    p, tail = max(1e-12, math.acos(min(1.0, threshold)) / math.pi), 0.0
    for k in range(dim, 0, -1):
        tail += math.exp(math.lgamma(dim + 1) - math.lgamma(k + 1) - math.lgamma(dim - k + 1) + k * math.log(p) + (dim - k) * math.log1p(-p))
        if tail > miss:
            return k
    return 0


class Codes:
    """The codes of a block: sign words, factors, and rotated vectors in eight bits with their scales."""

    def __init__(self, dim: int, code: bytes, factor: bytes, small: bytes, scale: bytes):
        self.factor = np.frombuffer(factor, np.float64)
        n = len(self.factor)
        packed = np.frombuffer(code, np.uint8).reshape(n, -1)
        self.signs = signs_of(packed, dim).astype(np.float32)
        wide = np.zeros((n, -(-packed.shape[1] // 8) * 8), np.uint8)
        wide[:, : packed.shape[1]] = packed
        self.words = wide.view(np.uint64)
        scales = np.frombuffer(scale, np.float64)
        self.turned = (np.frombuffer(small, np.int8).reshape(n, dim) * (scales[:, None] / 127)).astype(np.float32)
        #: What rounding to eight bits (and to single precision) can change in a product with signs of length one.
        self.slack = math.sqrt(dim) * scales / 254 + 1e-4

    @staticmethod
    def shrink(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scale = np.abs(turned).max(axis=1)
        return np.rint(turned / scale[:, None] * 127).astype(np.int8), scale


def undecided(x: Codes, y: Codes, same: bool, dim: int, threshold: float, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of either block have a partner that their codes can't refute."""
    most = most_flips(dim, threshold)
    low_x, low_y = lowest_estimate(x.factor, threshold), lowest_estimate(y.factor, threshold)
    hit_x, hit_y = np.zeros(len(x.factor), bool), np.zeros(len(y.factor), bool)
    for at in range(0, len(hit_x), rows):
        to = min(at + rows, len(hit_x))
        if most < dim:
            flips = np.bitwise_count(x.words[at:to, 0, None] ^ y.words[None, :, 0])
            for w in range(1, x.words.shape[1]):
                flips = flips + np.bitwise_count(x.words[at:to, w, None] ^ y.words[None, :, w]).astype(np.uint16)
            near = flips <= most
        else:
            near = np.ones((to - at, len(hit_y)), bool)
        if same:
            near &= np.arange(at, to)[:, None] < np.arange(len(hit_y))[None, :]
        a, b = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        if not len(a):
            continue
        a = at + a
        one = x.signs[a] @ y.turned[b].T + y.slack[None, b] >= (low_x * x.factor)[a, None]
        two = x.turned[a] @ y.signs[b].T + x.slack[a, None] >= (low_y * y.factor)[None, b]
        left = one & two & near[np.ix_(a - at, b)]
        hit_x[a] |= left.any(axis=1)
        hit_y[b] |= left.any(axis=0)
    return hit_x, hit_y


CODED = "rep long, label string, dim int, code binary, factor double, small binary, scale double"


def code_classes(classes: DataFrame) -> DataFrame:
    """The table of codes: every distinct vector with its sign code, factor and rotated form in eight bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at in by_dimension(batch.column(2).to_numpy()):
                some = batch.take(pa.array(at))
                turned, codes, factors = encode(unit(matrix(some.column(3))))
                small, scale = Codes.shrink(turned)
                in_bytes = [pa.array([r.tobytes() for r in rows], pa.binary()) for rows in (codes, small)]
                yield pa.RecordBatch.from_arrays([*some.columns[:3], in_bytes[0], pa.array(factors), in_bytes[1], pa.array(scale)], names=["rep", "label", "dim", "code", "factor", "small", "scale"])

    short_batches(classes.sparkSession, 1024)
    return classes.select("rep", F.col("label").cast("string"), "dim", F.col("embedding").cast("array<double>")).mapInArrow(run, CODED)


BLOCKS = "label string, dim int, block int, blocks int, reps binary, code binary, factor binary, small binary, scale binary"


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    one = {c: [pdf[c].iloc[0]] for c in ("label", "dim", "block", "blocks")}
    numbers = {"reps": pdf["rep"].to_numpy(np.int64), "factor": pdf["factor"].to_numpy(np.float64), "scale": pdf["scale"].to_numpy(np.float64)}
    return pd.DataFrame(one | {c: [v.tobytes()] for c, v in numbers.items()} | {c: [b"".join(pdf[c])] for c in ("code", "small")})


OPEN = "label string, dim int, bi int, bj int, block int, rep long"


def _meet(threshold: float):
    """Rows of two blocks in; the vectors out that have an undecided partner in the other block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim, bi, bj = row["dim"], row["block"], row["other"]
                x, y = (Codes(dim, *(row[f"{c}{side}"] for c in ("code", "factor", "small", "scale"))) for side in ("", "_2"))
                hit_x, hit_y = undecided(x, y, bi == bj, dim, threshold)
                hits = [(bi, np.frombuffer(row["reps"], np.int64)[hit_x | hit_y if bi == bj else hit_x])]
                if bi != bj:
                    hits.append((bj, np.frombuffer(row["reps_2"], np.int64)[hit_y]))
                for block, reps in hits:
                    n = len(reps)
                    same = [pa.array([row["label"]] * n, pa.string()), *(pa.array(np.full(n, v, np.int32)) for v in (dim, bi, bj, block))]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(reps)], names=["label", "dim", "bi", "bj", "block", "rep"])

    return run


def _settle(threshold: float):
    """The undecided vectors of two blocks in; for each linked one its links between them, and a root of those it is joined with."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, copies, rep = pdf["block"].to_numpy(), pdf["copies"].to_numpy(), pdf["rep"].to_numpy()
        first, second = int(pdf["bi"].iloc[0]), int(pdf["bj"].iloc[0])
        units = unit(np.stack(pdf["embedding"].to_numpy()).astype(np.float64))
        x, y = np.flatnonzero(own == first), np.flatnonzero(own == second)
        links, union = np.zeros(len(rep), np.int64), Union(len(rep))
        for at in range(0, len(x), 256):
            some = x[at : at + 256]
            linked = units[some] @ units[y].T >= threshold
            if first == second:
                linked &= some[:, None] < y[None, :]
            i, j = np.nonzero(linked)
            a, b = some[i], y[j]
            union.join(a, b)
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
        roots = union.roots()
        tied = np.flatnonzero(links > 0)
        return pd.DataFrame({"rep": rep[tied], "links": links[tied], "root": rep[roots[tied]]})

    return run


def block_pairs(coded: DataFrame) -> DataFrame:
    """Every two blocks of a label and dimension, also each with itself: the columns of BLOCKS, other, and those of the other block with _2."""
    many = coded.groupBy("label", "dim").count().select("label", "dim", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    placed = coded.join(written(many, "vector-blocks"), ["label", "dim"]).withColumn("block", F.expr("cast(pmod(xxhash64(rep), blocks) as int)"))
    packed = Written(placed.groupBy("label", "dim", "block", "blocks").applyInPandas(_pack, BLOCKS), "code-blocks", narrow=True).df
    left = packed.withColumn("other", F.explode(F.expr("sequence(block, blocks - 1)")))
    right = packed.select("label", "dim", F.col("block").alias("other"), *(F.col(c).alias(f"{c}_2") for c in ("reps", "code", "factor", "small", "scale")))
    return left.join(right, ["label", "dim", "other"])


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    rows = columns(vectors, vec_id=id_col, embedding=vector_col, label=label_col).withColumn("vec_id", F.col("vec_id").cast("long"))
    good = rows.where(usable("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    keyed = good.select("vec_id", "label", *vector_key("embedding"), "embedding")
    grouped = keyed.groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
    classes = Written(grouped.withColumn("dim", F.size("embedding").cast("int")), "vector-classes").df
    coded = Written(code_classes(classes), "vector-codes").df
    left = Written(block_pairs(coded).mapInArrow(_meet(threshold), OPEN), "undecided", narrow=True).df
    fetched = left.join(classes.select("rep", "copies", F.col("embedding").cast("array<double>").alias("embedding")), "rep")
    found = Written(fetched.groupBy("label", "dim", "bi", "bj").applyInPandas(_settle(threshold), "rep long, links long, root long"), "vector-links", narrow=True).df
    whole = components(found, "rep", "root")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    ends = classes.select("label", "k1", "k2", "rep", "copies").join(counts, "rep", "left").join(whole, F.col("rep") == F.col("node"), "left")
    ends = Written(
        ends.select("label", "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")).where("n_links > 0"), "vector-components"
    ).df
    every = rows.select("vec_id", "label", F.when(usable("embedding") & F.col("vec_id").isNotNull(), F.xxhash64("embedding")).alias("k1"), F.xxhash64(F.lit("second"), F.col("embedding")).alias("k2"))
    return every.join(ends, ["label", "k1", "k2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept")
    )
