"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its PREFIX nearest pivots. The index
is dealt out in segments; a segment posts its vectors, with the pivot's place
in their order, in inverted files by pivot. For a query, the files of its own
nearest pivots give the footrule distance to every vector of the segment
(pivots that only one of the two lists holds count as in place PREFIX). The
best share of the segment by that rank is reranked by exact distance; how much
that must be for the target recall is measured on the sample that the pivots
come from.

Queries are taken in blocks of a bounded size that are sent to all executors;
an executor keeps each query's best over all segments of its task.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallgrid.llm._spark import Scratch
from recallgrid.llm._vectors import by_dimension, sample, usable

PIVOTS = 256
PREFIX = 64
TARGET_RECALL = 0.99
CALIBRATE_MOST = 200
NEAREST = 10
SEGMENT = 1024
QUERY_BLOCK = 20_000
FIT_MOST = 2_000


def permutations(points: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each point, nearest first."""
    with np.errstate(over="ignore", invalid="ignore"):
        far = (pivots**2).sum(1)[None] - 2 * points @ pivots.T
    return np.argsort(far, axis=1, kind="stable")[:, :prefix]


def spread_pivots(points: np.ndarray, most: int, seed: int = 5) -> np.ndarray:
    """Up to most of the points, at random, first those at least half the
    median distance away from all chosen before: a large group of near copies
    doesn't take up the pivots."""
    points = np.unique(points, axis=0)
    points = points[np.random.default_rng(seed).permutation(len(points))]
    some = points[:200]
    half = 0.5 * float(np.median(np.sqrt(np.maximum(((some[:, None] - some[None]) ** 2).sum(2), 0))))
    chosen: list[int] = []
    near = np.full(len(points), np.inf)
    for k in range(len(points)):
        if len(chosen) == most:
            break
        if near[k] >= half:
            chosen.append(k)
            near = np.minimum(near, np.sqrt(((points - points[k]) ** 2).sum(1)))
    rest = [k for k in range(len(points)) if k not in set(chosen)]
    return points[chosen + rest[: most - len(chosen)]]


class Segment:
    """Vectors by ascending id, and the inverted files of their pivots."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, order: np.ndarray, pivots: int):
        self.ids, self.points, self.prefix = ids, points, order.shape[1]
        pivot = order.ravel()
        by = np.argsort(pivot, kind="stable")
        self.vector, self.place = by // self.prefix, by % self.prefix
        self.start = np.searchsorted(pivot[by], np.arange(pivots + 1))

    def closeness(self, order: np.ndarray) -> np.ndarray:
        """Half of (greatest possible footrule - footrule), of queries with
        these pivot orders to all vectors: over shared pivots, how far the
        later of the two places is from the list's end."""
        pivots = len(self.start) - 1
        total = np.zeros((len(order), len(self.ids)), dtype=np.int32)
        pivot = order.ravel()
        by = np.argsort(pivot, kind="stable")
        start = np.searchsorted(pivot[by], np.arange(pivots + 1))
        for p in range(pivots):
            q, v = by[start[p] : start[p + 1]], slice(self.start[p], self.start[p + 1])
            if len(q) and self.start[p] < self.start[p + 1]:
                total[np.ix_(q // self.prefix, self.vector[v])] += (self.prefix - np.maximum(q[:, None] % self.prefix, self.place[v][None])).astype(np.int32)
        return total


def _index(pivots: dict[int, np.ndarray], prefix: int, size: int):
    """(dim, ids, points, places): packed segments."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, matrix in by_dimension(batch.column(1)):
                d = matrix.shape[1]
                if d not in pivots:
                    order = np.zeros((len(rows), 1), np.int64)
                else:
                    order = permutations(matrix, pivots[d], prefix)
                ids = batch.column(0).take(pa.array(rows)).to_numpy()
                by = np.argsort(ids, kind="stable")
                for i in range(0, len(by), size):
                    take = by[i : i + size]
                    cells = [[d], [ids[take].astype(np.int64).tobytes()], [matrix[take].tobytes()], [order[take].astype(np.int16).tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["dim", "ids", "points", "places"])

    return run


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of a from b; where squares leave the
    range of double precision, of scaled differences."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        gap = a - b
        square = (gap**2).sum(1)
        far = np.sqrt(square)
        odd = ~(square < 1e300) | (square < 1e-280)
        if odd.any():
            most = np.abs(gap[odd]).max(axis=1, initial=0.0)
            unit = np.where(most > 0, most, 1.0)
            far[odd] = np.where(most < np.inf, most * np.sqrt(((gap[odd] / unit[:, None]) ** 2).sum(1)), np.inf)
    return far


def _best(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], nearest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest ids of each query among (query, id, distance); an id that
    is there more than once counts at its least distance."""
    q, v, d = (np.concatenate(x) for x in zip(*found, strict=True))
    by = np.lexsort((d, v, q))
    q, v, d = q[by], v[by], d[by]
    single = np.concatenate([[True], (q[1:] != q[:-1]) | (v[1:] != v[:-1])])[: len(q)]
    q, v, d = q[single], v[single], d[single]
    by = np.lexsort((v, d, q))
    q, v, d = q[by], v[by], d[by]
    start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])[: len(q)])
    place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    keep = place < nearest
    return q[keep], v[keep], d[keep]


def calibrated_share(points: np.ndarray, pivots: np.ndarray, prefix: int, nearest: int, target: float) -> float:
    """The share of a segment, best by footrule, that holds the target share
    of the nearest rows: found on the sample, whose rows lie less densely than
    the table's, so that neighbours there are harder to find."""
    points = np.unique(points, axis=0)
    points = points[np.random.default_rng(9).permutation(len(points))]
    asked, base = points[:CALIBRATE_MOST], points[CALIBRATE_MOST:]
    if len(base) < 10 * nearest:
        return 1.0
    rank = Segment(np.arange(len(base)), base, permutations(base, pivots, prefix), len(pivots)).closeness(permutations(asked, pivots, prefix))
    shares = []
    for k, x in enumerate(asked):
        true = np.argsort(distances(base, x), kind="stable")[:nearest]
        # rows that are at least as close by footrule
        shares.append((np.searchsorted(np.sort(-rank[k]), -rank[k][true], side="right")) / len(base))
    return float(min(1.0, np.quantile(np.concatenate(shares), target, method="higher")))


FOUND = "query_id long, vec_id long, score double"


def _search(queries, pivots: dict[int, np.ndarray], prefix: int, shares: dict[int, float], nearest: int):
    """(query_id, vec_id, score): the nearest found in a task's segments."""

    def one(segment: Segment, share: float, ids: np.ndarray, points: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(segment.ids)
        # rows of one id may stand in for each other: then all are compared
        repeated = bool((segment.ids[1:] == segment.ids[:-1]).any())
        most = n if repeated else min(n, max(nearest + 1, math.ceil(share * n)))
        out = []
        for i in range(0, len(ids), 512):
            rank = segment.closeness(order[i : i + 512]).astype(np.int64) * n + np.arange(n - 1, -1, -1)[None]
            picked = np.argpartition(-rank, most - 1, axis=1)[:, :most]
            for k, some in enumerate(picked):
                q = i + k
                far = distances(segment.points[some], points[q])
                v = segment.ids[some]
                other = v != ids[q]
                v, far = v[other], far[other]
                if len(v) > nearest and not repeated:
                    limit = np.partition(far, nearest - 1)[nearest - 1]
                    v, far = v[far <= limit], far[far <= limit]
                out.append((np.full(len(v), ids[q]), v, far))
        return _best(out, nearest)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list = []
        asked = {d: (ids, points, permutations(points, pivots[d], prefix) if d in pivots else np.zeros((len(ids), 1), np.int64)) for d, (ids, points) in queries.value.items()}
        for batch in batches:
            for dim, ids, points, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if dim not in asked:
                    continue
                own = np.frombuffer(ids, np.int64)
                order = np.frombuffer(places, np.int16).astype(np.int64).reshape(len(own), -1)
                segment = Segment(own, np.frombuffer(points, np.float64).reshape(len(own), -1), order, len(pivots.get(dim, [0])))
                best = [_best([*best, one(segment, shares.get(dim, 1.0), *asked[dim])], nearest)]
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best[0]], names=["query_id", "vec_id", "score"])

    return run


def nearest_neighbours(table: DataFrame, is_query, nearest: int = NEAREST, share: float | None = None, recall: float = TARGET_RECALL) -> DataFrame:
    """The nearest found for each query among all other rows of table
    (vec_id, embedding): query_id, rank (from 1), vec_id, score (Euclidean
    distance, double precision), nearest first, ties to the smaller vec_id.

    is_query: a condition on the rows. share: of each segment, to rerank; by
    default what the sample needs for the target recall. Fewer rows come if
    there are fewer candidates. Rows with the query's own vec_id are no candidates of it, and
    rows that share a vec_id are one, at the least distance. Vectors that are null, empty or zero, or
    hold a null, NaN or infinite component, and null vec_ids take no part;
    vectors of different dimensions don't meet. Pivots are taken from about
    FIT_MOST vectors; all are indexed. An empty table gives no rows.
    """
    spark = table.sparkSession
    scratch = Scratch(spark, "permutations")
    rows = table.where(usable("embedding") & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(is_query, F.lit(False)).alias("asks"))
    points: dict[int, list[np.ndarray]] = {}
    for x in sample(rows, "embedding", FIT_MOST):
        points.setdefault(len(x), []).append(x)
    pivots = {d: spread_pivots(np.stack(xs), PIVOTS) for d, xs in points.items()}
    shares = {d: share if share is not None else calibrated_share(np.stack(xs), pivots[d], PREFIX, nearest, recall) for d, xs in points.items()}
    index = scratch.keep(rows.select("vec_id", "embedding").mapInArrow(_index(pivots, PREFIX, SEGMENT), "dim int, ids binary, points binary, places binary"))
    asks = rows.where("asks").select("vec_id", "embedding").distinct()
    asked = scratch.keep(asks)
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    parts: list[str] = []
    for b in range(blocks):
        # a block is bounded by QUERY_BLOCK, not by the number of queries
        by_dim: dict[int, list] = {}
        for r in asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect():
            by_dim.setdefault(len(r["embedding"]), []).append((r["vec_id"], r["embedding"]))
        block = {d: (np.array([i for i, _ in xs], np.int64), np.array([x for _, x in xs], np.float64)) for d, xs in by_dim.items()}
        sent = spark.sparkContext.broadcast(block)
        parts.append(scratch.keep(index.mapInArrow(_search(sent, pivots, PREFIX, shares, nearest), FOUND))._scratch_path)
        sent.unpersist()
    found = spark.read.schema(FOUND).parquet(*parts)
    # repeated rows of one vec_id are one candidate, at its least distance
    single = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return single.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
