"""Nearest-neighbour search: exact by default, by probed partitions on request."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallgrid.functions import vectors as V
from recallgrid.functions.scoring import Decay, age_days, decayed, recency, stickiness
from recallgrid.plans.filters import FilterSpec
from recallgrid.plans.schema import dead

METRICS = {"l2": V.squared_l2, "cosine": lambda a, b: 1 - V.cosine(a, b), "ip": V.inner_product_distance}
OVERFETCH = 3


def query_vector(query: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in query])


def search(vectors: DataFrame, query: list[float] | Column, k: int = 5, metric: str = "l2") -> DataFrame:
    """The k nearest of (id, vec): id, distance, similarity; ties to the
    smaller id. L2 is squared. One scan and a bounded heap per task."""
    q = query if isinstance(query, Column) else query_vector(query)
    scored = vectors.select("id", METRICS[metric](F.col("vec"), q).alias("distance"))
    return scored.orderBy("distance", "id").limit(k).withColumn("similarity", V.similarity(F.col("distance")))


def search_records(records: DataFrame, vectors: DataFrame, query: list[float] | Column, now: int, k: int = 5, where: FilterSpec | None = None, decay: Decay | None = None, counted: bool = False) -> DataFrame:
    """The k best live records that fulfil where and have a vector: id,
    distance, similarity, score, best first, ties to the smaller id.

    With decay the 3k nearest are ranked anew; with a filter on namespace,
    entity or attributes all matches are. counted: score as if the search
    itself were one more recall.
    """
    q = query if isinstance(query, Column) else query_vector(query)
    hit = records.where(~dead())
    if where is not None:
        hit = hit.where(where.column())
    near = vectors.join(hit.select("id", "ts", "importance", "recall_count"), "id").withColumn("distance", V.squared_l2(F.col("vec"), q)).drop("vec")
    similarity = V.similarity(F.col("distance"))
    if decay is None:
        top = near.orderBy("distance", "id").limit(k)
        return top.select("id", "distance", similarity.alias("similarity"), similarity.alias("score"))
    indexed = where is not None and (where.namespace_is is not None or where.entity_is is not None or bool(where.attributes))
    if not indexed:
        near = near.orderBy("distance", "id").limit(OVERFETCH * k)
    recalls = F.col("recall_count") + (1 if counted else 0)
    scored = near.select("id", "distance", similarity.alias("similarity"), decayed(similarity, F.col("ts"), recalls, F.col("importance"), now, decay).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(k)


def _block_nearest(queries, k: int, metric: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = queries.value
        best_d, best_i = np.full((len(qid), k), np.inf), np.full((len(qid), k), np.iinfo(np.int64).max)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, m = batch.column(0).to_numpy(), np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
            for i in range(0, len(ids), 4096):
                some, part = ids[i : i + 4096], m[i : i + 4096]
                if metric == "l2":
                    far = (q**2).sum(1)[:, None] + (part**2).sum(1)[None] - 2 * q @ part.T
                elif metric == "ip":
                    far = 1 - q @ part.T
                else:
                    far = 1 - (q @ part.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(part, axis=1)[None] + 1e-9)
                # a few more than k, as the short form cancels; exact distances decide
                most = min(k + 8, len(some))
                pick = np.argpartition(far, most - 1, axis=1)[:, :most]
                if metric == "l2":
                    exact = ((q[:, None, :] - part[pick]) ** 2).sum(2)
                else:
                    exact = np.take_along_axis(far, pick, axis=1)
                d, who = np.concatenate([best_d, exact], axis=1), np.concatenate([best_i, some[pick]], axis=1)
                order = np.lexsort((who, d), axis=1)[:, :k]
                best_d, best_i = np.take_along_axis(d, order, axis=1), np.take_along_axis(who, order, axis=1)
        rows, cols = np.nonzero(np.isfinite(best_d))
        yield pa.RecordBatch.from_arrays([pa.array(qid[rows]), pa.array(best_i[rows, cols]), pa.array(best_d[rows, cols])], names=["query_id", "id", "distance"])

    return run


def search_batch(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2", block: int = 4096) -> DataFrame:
    """The k nearest of each query (query_id, vec): query_id, rank, id,
    distance. Queries go out in blocks of a bounded size, each against one
    scan by matrix products; a task returns k rows per query."""
    spark = vectors.sparkSession
    n = queries.count()
    found: DataFrame | None = None
    for b in range(max(1, -(-n // block))):
        # bounded by block, not by the number of queries
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n // block)))) == b).select("query_id", "vec").collect()
        if not rows:
            continue
        packed = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)))
        part = vectors.select("id", F.col("vec").cast("array<double>")).mapInArrow(_block_nearest(packed, k, metric), "query_id long, id long, distance double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "distance")


def touches(found: DataFrame, now: int) -> DataFrame:
    """What a search leaves in the log of touches: (id, ts)."""
    return found.select("id", F.lit(now).cast("bigint").alias("ts"))


def explain(records: DataFrame, vectors: DataFrame, record_id: int, query: list[float] | Column, now: int, decay: Decay = Decay()) -> DataFrame:
    """How a record's score comes about. Its distance is plain, not squared,
    so its similarity differs from that of a search."""
    q = query if isinstance(query, Column) else query_vector(query)
    row = records.where(F.col("id") == record_id).join(vectors.where(F.col("id") == record_id), "id")
    sim = V.similarity(V.l2(F.col("vec"), q))
    stick, fresh = stickiness(F.col("recall_count")), recency(F.col("ts"), F.col("recall_count"), now, decay)
    score = ((1 - decay.time_weight) * sim + decay.time_weight * fresh) * F.col("importance").cast("double")
    return row.select("id", F.round(sim, 6).alias("similarity"), F.round(stick, 6).alias("stickiness"), F.round(age_days(F.col("ts"), now), 2).alias("age_days"), F.round(fresh, 6).alias("recency"), F.round(F.col("importance").cast("double"), 6).alias("importance"), F.round(F.col("confidence").cast("double"), 6).alias("confidence"), F.round(score, 6).alias("score"))


def search_diverse(candidates: DataFrame, k: int = 10, diversity: float = 0.5) -> DataFrame:
    """Maximal marginal relevance over candidates (id, score, vec) of one
    search: rank, id, score. A search gives min(5k, 200) of them, so one task
    holds them all; the rest of the engine doesn't see this loop."""

    def pick(frame):
        frame = frame.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        m = np.stack(frame["vec"].to_numpy()).astype(np.float64) if len(frame) else np.zeros((0, 1))
        length = np.linalg.norm(m, axis=1)
        cosine = (m @ m.T) / (length[:, None] * length[None] + 1e-9)
        score, left, chosen = frame["score"].to_numpy(), list(range(len(frame))), []
        while left and len(chosen) < k:
            value = [(1 - diversity) * score[i] - diversity * (max(cosine[i, j] for j in chosen) if chosen else 0.0) for i in left]
            chosen.append(left.pop(int(np.argmax(value))))
        out = frame.loc[chosen, ["id", "score"]].reset_index(drop=True)
        out.insert(0, "rank", np.arange(1, len(out) + 1, dtype="int32"))
        return out

    return candidates.select("id", "score", "vec").orderBy(F.desc("score"), "id").limit(min(5 * k, 200)).groupBy(F.lit(1).alias("all")).applyInPandas(pick, "rank int, id long, score double")


def build_ivf(vectors: DataFrame, cells: int = 32, seed: int = 7, sample: float = 1.0, centres: list[list[float]] | None = None) -> tuple[DataFrame, list[list[float]]]:
    """(vectors with their cell, centres), the centres fitted or given. Written
    partitioned by cell, a probe reads only the cells it visits."""
    if centres is None:
        featured = vectors.withColumn("features", array_to_vector(F.col("vec").cast("array<double>")))
        model = KMeans(k=cells, seed=seed, maxIter=15).fit(featured.sample(sample, seed) if sample < 1 else featured)
        return model.transform(featured).withColumnRenamed("prediction", "cell").drop("features"), [c.tolist() for c in model.clusterCenters()]
    ways = F.array(*[F.struct(V.squared_l2(F.col("vec"), query_vector(c)).alias("far"), F.lit(k).alias("cell")) for k, c in enumerate(centres)])
    return vectors.withColumn("cell", F.array_min(ways)["cell"]), centres


def search_ivf(placed: DataFrame, centres: list[list[float]], query: list[float], k: int = 10, nprobe: int = 4) -> DataFrame:
    """Approximate search in the nprobe nearest cells; more cells, more recall."""
    far = ((np.array(centres) - np.array(query)) ** 2).sum(1)
    probed = [int(c) for c in np.argsort(far, kind="stable")[:nprobe]]
    return search(placed.where(F.col("cell").isin(*probed)), query, k)
