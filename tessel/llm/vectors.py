"""Shared by the vector operators: which rows take part, copies, arrays from Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(c: str) -> Column:
    """Neither null, nor empty, nor with null or non-finite components, nor all zero."""
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(c).isNotNull() & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def vector_key(c: str) -> list[Column]:
    """128 bits that stand for a vector's exact components."""
    return [F.xxhash64(c).alias("k1"), F.xxhash64(F.lit("second"), F.col(c)).alias("k2")]


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists all have one length, as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so squares stay finite."""
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same for every process."""
    q, r = np.linalg.qr(np.random.default_rng((seed, dim)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def by_dimension(lengths: np.ndarray):
    """Indices of the rows of each dimension."""
    for dim in np.unique(lengths).tolist():
        yield dim, np.flatnonzero(lengths == dim)


def dimension(df: DataFrame, c: str) -> Column:
    return F.size(c).cast("int")
