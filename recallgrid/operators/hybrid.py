"""Fusion of rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallgrid.functions.scoring import Decay
from recallgrid.operators.keyword import bm25
from recallgrid.operators.search import OVERFETCH, search_records
from recallgrid.plans.filters import FilterSpec
from recallgrid.plans.schema import live


def rrf(arms: list[DataFrame], k: int = 10, rrf_k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of arms (id, place; places from 1): (id, score),
    ties to the larger id. Arms hold a few times k rows."""
    stacked = reduce(DataFrame.unionByName, [a.select("id", "place") for a in arms])
    fused = stacked.groupBy("id").agg(F.sum(1.0 / (rrf_k + F.col("place"))).alias("score"))
    return fused.orderBy(F.desc(F.round("score", 12)), F.desc("id")).limit(k)


def placed(ranked: DataFrame, *order: Column) -> DataFrame:
    """A bounded ranking with its places."""
    return ranked.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def hybrid_search(records: DataFrame, vectors: DataFrame, query: list[float] | Column, text: str, now: int, k: int = 10, rrf_k: int = 60, where: FilterSpec | None = None, decay: Decay | None = None) -> DataFrame:
    """(id, score): the 3k best by vector and the 3k best by BM25, fused. The
    filter holds in both arms, and neither returns too few for it."""
    near = search_records(records, vectors, query, now, OVERFETCH * k, where, decay)
    alive = live(records)
    words = bm25(alive, text, OVERFETCH * k, alive.where(where.column()) if where is not None else None)
    return rrf([placed(near, F.desc("score"), F.asc("id")), placed(words, F.desc(F.round("score", 9)), F.desc("id"))], k, rrf_k)


def recall(records: DataFrame, vectors: DataFrame, query: list[float] | Column, text: str, now: int, k: int = 5, namespace: str | None = None, decay: Decay = Decay()) -> DataFrame:
    """Hybrid search with decay within a namespace: (id, score, content cut to 300 characters)."""
    where = FilterSpec().namespace(namespace) if namespace is not None else None
    found = hybrid_search(records, vectors, query, text, now, 2 * k, where=where, decay=decay).orderBy(F.desc("score"), F.desc("id")).limit(k)
    return found.join(records.select("id", F.substring("content", 1, 300).alias("content")), "id")
