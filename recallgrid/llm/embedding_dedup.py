"""Embedding near-dedup by an inverted multi-index.

Unit vectors are cut in halves, each half has its own codebook, and the pairs
of codewords are the cells of a grid. A vector lives in the cell of its two
nearest codewords. To find what it may link with, it visits cells in the order
of a bound on the way there: for each half the distance to the plane between
its own codeword and the other one, squared and summed (a multi-sequence over
both halves' sorted distances). It stops at a bound calibrated on vectors
turned away at random to exactly the least cosine, such that the target recall
of these have their cell visited. Of two cells only the vectors of the one
that a scramble of cells puts first visit the other, so that each pair meets
once. In the cells visited all pairs are verified by their cosine in double
precision.

Vectors alike in all components are one, with a count. A cell is dealt out in
blocks, so that no task holds more than BLOCK residents against BLOCK visitors;
a block gives counts and a spanning forest, not its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm import _arrays
from recallgrid.llm._spark import Scratch, components, spread_join
from recallgrid.llm._vectors import by_dimension, kmeans, sample, scaled, usable

LEAST_COSINE = 0.95
TARGET_RECALL = 0.999
FIT_MOST = 20_000
CELL_VECTORS = 1000
BLOCK = 4096
#: A codeword for each half is fitted on this many vectors at least.
CODEWORD_VECTORS = 10


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    matrix = scaled(matrix)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


class Grid:
    """The codebooks of one dimension and the bound up to which cells are visited."""

    def __init__(self, points: np.ndarray, k: int, cosine: float, recall: float, seed: int = 11):
        unit = unit_rows(points)
        self.half = unit.shape[1] // 2
        self.books = [kmeans(unit[:, : self.half], k), kmeans(unit[:, self.half :], k)]
        rng = np.random.default_rng(seed)
        noise = rng.normal(size=unit.shape)
        noise -= (noise * unit).sum(1, keepdims=True) * unit
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-300)
        turned = cosine * unit + math.sqrt(max(0.0, 1 - cosine**2)) * noise
        ways = self.ways(unit)
        home = self.home(turned)
        cost = sum(w[np.arange(len(unit)), c] ** 2 for w, c in zip(ways, home, strict=True))
        # beyond the exact limit no pair of this cosine can lie
        self.bound = min(float(np.quantile(cost, recall, method="higher")), 2 * (1 - cosine)) + 1e-12

    def halves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return unit[:, : self.half], unit[:, self.half :]

    def squares(self, unit: np.ndarray) -> list[np.ndarray]:
        return [(b**2).sum(1) - 2 * h @ b.T for h, b in zip(self.halves(unit), self.books, strict=True)]

    def home(self, unit: np.ndarray) -> list[np.ndarray]:
        return [np.argmin(s, axis=1) for s in self.squares(unit)]

    def ways(self, unit: np.ndarray) -> list[np.ndarray]:
        """Of each half: the distance to the plane between the nearest codeword and each other."""
        out = []
        for s, b in zip(self.squares(unit), self.books, strict=True):
            own = np.argmin(s, axis=1)
            apart = np.sqrt(np.maximum(((b[own][:, None, :] - b[None]) ** 2).sum(2), 1e-300)) if len(b) * len(own) * b.shape[1] < 4_000_000 else np.sqrt(np.maximum((b[own] ** 2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * b[own] @ b.T, 1e-300))
            way = (s - s[np.arange(len(own)), own][:, None]) / (2 * apart)
            way[np.arange(len(own)), own] = 0.0
            out.append(way)
        return out

    def visits(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the visited cells, by rank in both halves."""
        first, second = self.ways(unit)
        width = len(self.books[1])
        orders = [np.argsort(w, axis=1, kind="stable") for w in (first, second)]
        sorted_ = [np.take_along_axis(w, o, axis=1) ** 2 for w, o in zip((first, second), orders, strict=True)]
        rows, cells = [], []
        for a in range(sorted_[0].shape[1]):
            on = np.flatnonzero(sorted_[0][:, a] <= self.bound)
            if not on.size:
                break
            for b in range(sorted_[1].shape[1]):
                on = on[sorted_[0][on, a] + sorted_[1][on, b] <= self.bound]
                if not on.size:
                    break
                rows.append(on)
                cells.append(orders[0][on, a] * width + orders[1][on, b])
        return np.concatenate(rows), np.concatenate(cells)

    def cell(self, unit: np.ndarray) -> np.ndarray:
        a, b = self.home(unit)
        return a * len(self.books[1]) + b


def _rank(cells: np.ndarray) -> np.ndarray:
    return _arrays.mix(cells.astype(np.uint64))


def _place(grids: dict[int, Grid]):
    """(cell, visitor, uid, copies, dim, vector): a resident's row, and a
    visitor's for each other cell it visits that ranks after its own. A
    dimension without a grid has one cell."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                for rows, matrix in by_dimension(part.column(2)):
                    d = matrix.shape[1]
                    home, at, cells = np.zeros(len(rows), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
                    if d in grids:
                        unit = unit_rows(matrix)
                        home = grids[d].cell(unit)
                        at, cells = grids[d].visits(unit)
                        later = _rank(cells) > _rank(home[at])
                        at, cells = at[later], cells[later]
                    who = np.concatenate([np.arange(len(rows)), at])
                    taken = part.take(pa.array(rows[who]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([home, cells])), pa.array(np.arange(len(who)) >= len(rows)), taken.column(0), taken.column(1), pa.array(np.full(len(who), d, np.int32)), taken.column(2)],
                        names=["cell", "visitor", "uid", "copies", "dim", "vector"],
                    )

    return run


def _verify(least: float):
    """Reads rows sorted by block (dim, cell, r, v); gives (a, null, n), links
    to add to a, and (a, b, 0), a spanning forest of a block's links."""

    def block(v: int, visitor: np.ndarray, uid: np.ndarray, copies: np.ndarray, matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
        matrix = scaled(matrix)
        norm = np.sqrt((matrix**2).sum(1))
        res, vis = np.flatnonzero(~visitor), np.flatnonzero(visitor)
        # residents meet among themselves in their first block
        for rows, own in ((vis, False), (res, True)) if v == 0 else ((vis, False),):
            for i in range(0, len(rows), 256):
                some = rows[i : i + 256]
                others = res[i:] if own else res
                cosine = (matrix[some] @ matrix[others].T) / (norm[some][:, None] * norm[others][None])
                near = cosine >= least
                if own:
                    near &= some[:, None] < others[None]
                a, b = np.nonzero(near)
                if not a.size:
                    continue
                a, b = some[a], others[b]
                gain = np.bincount(a, weights=copies[b], minlength=len(uid)) + np.bincount(b, weights=copies[a], minlength=len(uid))
                got = np.flatnonzero(gain)
                node, root = _arrays.forest(uid[a], uid[b])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([uid[got], node])), pa.array(np.concatenate([np.zeros(len(got), np.int64), root]), mask=np.arange(len(got) + len(node)) < len(got)), pa.array(np.concatenate([gain[got].astype(np.int64), np.zeros(len(node), np.int64)]))],
                    names=["a", "b", "n"],
                )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            yield from whole(held, final=False)
            held = held.slice(len(held) - trailing(held)) if len(held) else held
        if held is not None and len(held):
            yield from whole(held, final=True)

    def keys(table: pa.Table) -> np.ndarray:
        return np.stack([table.column(k).to_numpy().astype(np.int64) for k in ("dim", "cell", "r", "v")], axis=1)

    def trailing(table: pa.Table) -> int:
        key = keys(table)
        other = np.flatnonzero((key != key[-1]).any(axis=1))
        return len(key) - (int(other[-1]) + 1 if other.size else 0)

    def whole(table: pa.Table, final: bool) -> Iterator[pa.RecordBatch]:
        if not len(table):
            return
        key = keys(table)
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
        stops = np.append(new[1:], len(key))
        for start, stop in list(zip(new, stops, strict=True))[: len(new) if final else len(new) - 1]:
            part = table.slice(start, stop - start).combine_chunks()
            columns = [part.column(k).to_numpy() for k in ("visitor", "uid", "copies")]
            vectors = part.column("vector").combine_chunks()
            vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
            matrix = vectors.flatten().to_numpy().astype(np.float64).reshape(stop - start, -1)
            yield from block(int(key[start, 3]), *columns, matrix)

    return run


def near_duplicates(table: DataFrame, least_cosine: float = LEAST_COSINE, recall: float = TARGET_RECALL, block: int = BLOCK) -> DataFrame:
    """One row for each row of table (vec_id, embedding): vec_id, n_links (the
    other rows it links with), component_id (the smallest vec_id that links
    reach) and kept (whether that is its own).

    Pairs link from a cosine of least_cosine on. Vectors that are null, empty
    or zero, or hold a null, NaN or infinite component, and vectors of
    different dimensions don't link. Repeated rows link with each other. Null
    vec_ids keep their rows (kept false) and are never the smallest; a
    component without any other has a null component_id. Codebooks and bound
    are fitted on about FIT_MOST vectors; all are indexed. Other columns are
    not read; an empty table gives no rows.
    """
    scratch = Scratch(table.sparkSession, "embeddings")
    rows = table.select("vec_id", "embedding", usable("embedding").alias("ok"))
    distinct = rows.where("ok").groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    distinct = scratch.keep(distinct.select(F.monotonically_increasing_id().alias("uid"), "least", "copies", "embedding"))
    points: dict[int, list[np.ndarray]] = {}
    for x in sample(distinct, "embedding", FIT_MOST):
        points.setdefault(len(x), []).append(x)
    # the codebooks grow with the table as far as the sample can fit them
    k = max(2, min(math.ceil(math.sqrt(distinct.count() / CELL_VECTORS)), FIT_MOST // CODEWORD_VECTORS))
    grids = {d: Grid(np.stack(xs), k, least_cosine, recall) for d, xs in points.items() if d > 1}
    kind = dict(distinct.dtypes)["embedding"]
    placed = scratch.keep(distinct.select("uid", "copies", "embedding").mapInArrow(_place(grids), f"cell long, visitor boolean, uid long, copies long, dim int, vector {kind}"))
    # k * k cells at most for each dimension in the sample
    cells = placed.groupBy("dim", "cell").agg(F.count_if("visitor").alias("vis"), F.count_if(~F.col("visitor")).alias("res")).where("res > 0 and res + vis > 1")
    blocks = cells.select("dim", "cell", F.ceil(F.col("res") / block).cast("int").alias("rs"), F.greatest(F.ceil(F.col("vis") / block), F.lit(1)).cast("int").alias("vs"))
    rs, vs, own, visitor = (F.col(c) for c in ("rs", "vs", "own", "visitor"))
    # block (r, v): residents r, and visitors v or, from vs on, the residents v - vs of a later block
    other = F.when(F.col("i") - vs < own, F.col("i") - vs).otherwise(F.col("i") - vs + 1)
    dealt = placed.join(blocks, ["dim", "cell"]).withColumn("own", F.pmod(F.xxhash64("uid"), F.when(visitor, vs).otherwise(rs)).cast("int"))
    dealt = dealt.withColumn("i", F.explode(F.sequence(F.lit(0), F.when(visitor, rs).otherwise(rs + vs - 1) - 1))).withColumn("other", other)
    as_visitor = ~visitor & (F.col("i") >= vs) & (F.col("other") < own)
    r = F.when(visitor, F.col("i")).when(as_visitor, F.col("other")).otherwise(own)
    v = F.when(visitor, own).when(F.col("i") < vs, F.col("i")).when(as_visitor, vs + own).otherwise(vs + F.col("other"))
    dealt = dealt.select("dim", "cell", r.alias("r"), v.alias("v"), (visitor | as_visitor).alias("visitor"), "uid", "copies", "vector")
    ordered = dealt.repartition("dim", "cell", "r", "v").sortWithinPartitions("dim", "cell", "r", "v")
    found = scratch.keep(ordered.mapInArrow(_verify(least_cosine), "a long, b long, n long"))
    scratch.drop(placed)
    links = found.where("b is null").groupBy(F.col("a").alias("uid")).agg(F.sum("n").alias("links"))
    star = components(scratch, found.where("b is not null").select("a", "b")).withColumnRenamed("id", "uid")
    rooted = distinct.join(star, "uid", "left").withColumn("root", F.coalesce("root", "uid")).join(links, "uid", "left")
    rooted = scratch.keep(rooted.select("root", "embedding", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n")))
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_vector = scratch.keep(rooted.join(of_root, "root").select("embedding", "n_links", "component_id", "n"))
    linked = spread_join(rows.where("ok").select("vec_id", "embedding"), of_vector, ["embedding"], table.count()).select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
