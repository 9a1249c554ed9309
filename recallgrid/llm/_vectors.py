"""What the vector operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """True for vectors that are not null, empty or zero and hold no null, NaN
    or infinite component."""
    each = F.col(vector).cast("array<double>")
    finite = F.forall(each, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & finite & F.exists(each, lambda x: x != 0), F.lit(False))


def sample(vectors: DataFrame, vector: str, most: int) -> list[np.ndarray]:
    """At most about most vectors (never over twice as many), chosen by a hash
    of their components, so that the choice doesn't depend on their order."""
    n = vectors.count()
    below = min(1.0, most / max(n, 1)) * 2.0**63
    h = F.abs(F.xxhash64(vector).cast("double"))
    picked = vectors.where(h <= below).select(vector).limit(2 * most).collect()
    return [np.asarray(r[0], dtype=np.float64) for r in picked]


def by_dimension(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each dimension in a list column without nulls."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    out = []
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        out.append((rows, flat[starts[rows][:, None] + np.arange(d)]))
    return out


def scaled(matrix: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that their largest component is between
    1/2 and 1: squares neither overflow nor vanish, and cosines stay the same
    to the last bit."""
    return np.ldexp(matrix, -np.frexp(np.abs(matrix).max(axis=1, initial=0.0))[1][:, None])


def kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """At most k centres of the points."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(points, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]]
    for _ in range(rounds):
        nearest = np.argmin((centres**2).sum(1) - 2 * points @ centres.T, axis=1)
        counts = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres
