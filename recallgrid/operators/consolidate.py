"""Consolidation: clusters of alike records become one."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.functions import vectors as V
from recallgrid.functions.text import hashed_id
from recallgrid.operators.analytics import centroid
from recallgrid.plans.schema import FACT, as_records, live
from recallgrid.plans.session import Rounds, ensure_checkpoint_dir

INTO = "consolidated_into"
EPSILON = 1e-9
#: Components of the vectors of a block, of which a task holds two.
BLOCK_PARTS = 1 << 19


class Consolidation(NamedTuple):
    records: DataFrame
    vectors: DataFrame
    edges: DataFrame
    clusters: DataFrame


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links a-b replaced by (node, smallest node of its component), node > that."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = code[: len(a)], code[len(a) :], np.arange(len(nodes))
    while True:
        least, lower = np.minimum(root[x], root[y]), root.copy()
        np.minimum.at(lower, root[x], least)
        np.minimum.at(lower, root[y], least)
        lower = lower[lower]
        if (lower == root).all():
            other = root != np.arange(len(nodes))
            return nodes[other], nodes[root[other]]
        root = lower


def _verify(least: float, forest: bool):
    """Compares the two blocks of each row; gives the pairs of cosine at least
    least, or a spanning forest of them."""

    def block(rows: pa.ListScalar, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        uid, vec = rows.values.flatten()
        m = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(uid), dim)
        return uid.to_numpy(), m, np.sqrt((m**2).sum(1))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, lo, hi, left, right in zip(*batch.columns, strict=True):
                (xs, x, x_norm), (ys, y, y_norm) = block(left, dim.as_py()), block(right, dim.as_py())
                for i in range(0, len(xs), 256):
                    cosine = (x[i : i + 256] @ y.T) / (x_norm[i : i + 256, None] * y_norm[None] + EPSILON)
                    hit = cosine >= least
                    if lo == hi:
                        hit &= xs[i : i + 256, None] < ys[None]
                    a, b = np.nonzero(hit)
                    found, of = (xs[i + a], ys[b]), cosine[a, b]
                    if forest:
                        found = _forest(*found)
                        of = np.full(len(found[0]), least)
                    yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1]), pa.array(of)], names=["x", "y", "similarity"])

    return run


def _compared(vectors: DataFrame, least: float, forest: bool, block: int | None) -> tuple[DataFrame, DataFrame]:
    """(members, found). members: id, uid, first (the smallest id) and own (the
    cosine with itself) of all vectors, equal ones under one uid. found: x, y
    and similarity of the pairs of uids, or of a spanning forest of them."""
    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    # rows of found's input are whole blocks (a setting of the session)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    some = vectors.where("id is not null and size(vec) > 0").select("id", "vec")
    distinct = some.groupBy("vec").agg(F.min("id").alias("first")).select(F.monotonically_increasing_id().alias("uid"), "first", "vec", F.size("vec").alias("dim")).checkpoint()
    members = some.join(distinct.withColumn("own", V.cosine(F.col("vec"), F.col("vec"), EPSILON)), "vec").select("id", "uid", "first", "own")
    most = F.lit(block) if block else F.greatest(F.lit(1), F.floor(F.lit(BLOCK_PARTS) / F.col("dim")))
    deal = distinct.groupBy("dim").agg(F.count("*").alias("rows")).select("dim", F.ceil(F.col("rows") / most).cast("int").alias("n")).checkpoint()
    dealt = distinct.join(F.broadcast(deal), "dim").withColumn("block", F.pmod(F.xxhash64("uid"), F.col("n")).cast("int"))
    blocks = dealt.groupBy("dim", "n", "block").agg(F.collect_list(F.struct("uid", "vec")).alias("held")).checkpoint()
    left = blocks.select("dim", F.col("block").alias("lo"), F.explode(F.sequence("block", F.col("n") - 1)).alias("hi"), F.col("held").alias("left"))
    right = blocks.select("dim", F.explode(F.sequence(F.lit(0), "block")).alias("lo"), F.col("block").alias("hi"), F.col("held").alias("right"))
    # few rows, but much work for each
    tasks = min(10_000, int(deal.agg(F.sum(F.expr("n * (n + 1) / 2"))).first()[0] or 1))
    key = ["dim", "lo", "hi"]
    both = left.repartition(tasks, *key).join(right.repartition(tasks, *key).hint("merge"), key)
    return members, both.mapInArrow(_verify(least, forest), "x long, y long, similarity double")


def similar_pairs(vectors: DataFrame, least: float = 0.85, block: int | None = None) -> DataFrame:
    """(a, b, similarity), a < b: all pairs of cosine at least least.

    Every two vectors of one dimension are compared, in blocks (of block
    vectors), equal ones as one. Null and empty vectors are in no pair; for
    ids of several vectors the greatest similarity counts."""
    members, found = _compared(vectors, least, False, block)
    x, y = (members.select(F.col("uid").alias(c), F.col("id").alias(f"{c}_id")) for c in ("x", "y"))
    across = found.join(x, "x").join(y, "y").select("x_id", "y_id", "similarity")
    copies = members.where(F.col("own") >= least)
    within = copies.select("uid", F.col("id").alias("x_id"), F.col("own").alias("similarity")).join(copies.select("uid", F.col("id").alias("y_id")), "uid").where("x_id < y_id")
    pairs = across.where("x_id <> y_id").unionByName(within.drop("uid")).select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"), "similarity")
    return pairs.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def similar_links(vectors: DataFrame, least: float = 0.85, block: int | None = None) -> DataFrame:
    """(a, b): links that join just what similar_pairs does, a spanning forest
    of each block's pairs and copies to the first of them."""
    members, found = _compared(vectors, least, True, block)
    # any id of a vector stands for it, if its copies are linked to that
    x, y = (members.where("id = first").select(F.col("uid").alias(c), F.col("id").alias(k)).distinct() for c, k in (("x", "a"), ("y", "b")))
    across = found.join(x, "x").join(y, "y").select("a", "b")
    copies = members.where(F.col("own") >= least).select(F.col("first").alias("a"), F.col("id").alias("b"))
    return across.unionByName(copies).where("a <> b").distinct()


def connected(pairs: DataFrame, most_rounds: int = 30) -> DataFrame:
    """(id, root): the smallest id of each component of pairs (a, b).

    Large-star and small-star rounds, whose number grows with the logarithm of
    the ids however the pairs chain. Every round is written to the session's
    spark.checkpoint.dir."""
    rounds = Rounds(pairs.sparkSession, "connected")
    links = rounds.keep(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    now = links.where("a <> b")
    for _ in range(most_rounds):
        many = now.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        if not many and not now.select(F.col("b").alias("a")).join(now.select("a"), "a", "left_semi").limit(1).count():
            labels = links.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(now.withColumnRenamed("a", "id"), "id", "left").select("id", F.coalesce("b", "id").alias("root"))
            labels = rounds.keep(labels)
            rounds.drop_all_but_last()
            return labels
        # larger neighbours go to the smallest of a node and its neighbours
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = rounds.keep(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")))
        large = rounds.keep(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # a node and its smaller neighbours go to the smallest of these
        least = rounds.keep(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = rounds.keep(small.unionByName(least.withColumnRenamed("m", "b")).distinct())
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _summarised(clusters: DataFrame, summarise: Callable[[list[str]], str]) -> DataFrame:
    @F.pandas_udf("string")
    def summary(contents: pd.Series) -> pd.Series:
        def one(texts) -> str | None:
            try:
                return summarise(list(texts)) or None
            except Exception:  # a model's failure leaves the plain content
                return None

        return contents.map(one)

    return clusters.withColumn("content", F.coalesce(summary("contents"), "content"))


def consolidate(records: DataFrame, vectors: DataFrame, edges: DataFrame, now: int, namespace: str | None = None, least: float = 0.85, recent_seconds: int | None = None, least_members: int = 2, summarise: Callable[[list[str]], str] | None = None) -> Consolidation:
    """Makes a fact record of each cluster of live records that are linked by
    cosines of at least least: its vector the members' centroid, content the
    first 200 characters of each joined by " | ", importance their greatest,
    confidence their mean. Members get an edge to it and importance 0.3. Its
    id is a hash of the members' ids, so that a second run makes the same.
    summarise makes the content from the members' first 200 characters, in
    the order of ids; where it fails or gives nothing, these are joined."""
    hit = live(records).where(F.col("importance") > 0.01)
    if namespace is not None:
        hit = hit.where(F.col("namespace_id") == namespace)
    if recent_seconds is not None:
        hit = hit.where(F.col("ts") >= now - recent_seconds)
    chosen = vectors.join(hit.select("id"), "id", "left_semi")
    labels = connected(similar_links(chosen, least))
    members = hit.join(labels, "id")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("id", F.substring("content", 1, 200).alias("content")))), lambda m: m["content"])
    clusters = members.groupBy("root").agg(
        F.count("*").alias("members"), F.array_join(ordered, " | ").alias("content"), ordered.alias("contents"), F.max("importance").alias("importance"), F.avg(F.col("confidence").cast("double")).cast("float").alias("confidence"),
        F.min("namespace_id").alias("namespace_id"), F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("ids"),
    ).where(F.col("members") >= least_members).withColumn("id", hashed_id(F.concat(F.lit("cluster:"), F.col("ids"))))
    if summarise is not None:
        clusters = _summarised(clusters, summarise)
    made = clusters.select("id", F.lit(now).cast("bigint").alias("ts"), "importance", F.lit(FACT).cast("tinyint").alias("type"), F.lit("consolidation").alias("source"), "content", "namespace_id", "confidence")
    lowered = records.join(members.join(clusters.select("root"), "root", "left_semi").select("id", F.lit(True).alias("__hit")), "id", "left")
    lowered = lowered.withColumn("importance", F.when(F.col("__hit"), F.lit(0.3).cast("float")).otherwise(F.col("importance"))).select(*records.columns)
    placed = chosen.join(labels, "id").join(clusters.select("root", F.col("id").alias("cluster")), "root")
    mean = centroid(placed.select("modality", "cluster", "vec"), ["modality", "cluster"]).select("modality", F.col("cluster").alias("id"), F.col("vec").cast("array<float>").alias("vec"))
    new_edges = members.join(clusters.select("root", F.col("id").alias("dst")), "root").select(F.col("id").alias("src"), "dst", F.lit(INTO).alias("rel_type"), F.lit(1.0).cast("float").alias("weight"))
    return Consolidation(lowered.unionByName(as_records(made)), vectors.unionByName(mean.select(*vectors.columns)), edges.unionByName(new_edges.select(*edges.columns)), clusters.select("id", "root", "members"))
