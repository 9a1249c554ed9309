"""Retrieval plans: typed steps that build one DataFrame."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.functions.scoring import Decay
from recallgrid.operators import graph, hierarchy, keyword
from recallgrid.operators.hybrid import hybrid_search
from recallgrid.operators.search import search_records
from recallgrid.plans.filters import FilterSpec


@dataclass(frozen=True)
class Step:
    kind: str
    params: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Plan:
    query: str
    steps: tuple[Step, ...]


def plan(query: str, k: int = 10, where: FilterSpec | None = None, decay: Decay | None = None) -> Plan:
    """One hybrid search; callers add steps as they like."""
    return Plan(query, (Step("hybrid_search", {"k": k, "where": where, "decay": decay}),))


def execute(plan: Plan, records: DataFrame, vectors: DataFrame, edges: DataFrame, vector: list[float] | None, now: int, nodes: DataFrame | None = None) -> DataFrame:
    """(id, score) of the last step; a hybrid search without a vector is one by
    keywords. Unknown steps give a warning."""
    found: DataFrame | None = None
    for step in plan.steps:
        p = step.params
        if step.kind == "hybrid_search" and vector is not None:
            found = hybrid_search(records, vectors, vector, plan.query, now, p.get("k", 10), where=p.get("where"), decay=p.get("decay"))
        elif step.kind == "vector_search" and vector is not None:
            found = search_records(records, vectors, vector, now, p.get("k", 10), p.get("where"), p.get("decay")).select("id", "score")
        elif step.kind in ("hybrid_search", "vector_search", "keyword_search"):
            found = keyword.keyword_search(records, plan.query, p.get("k", 10), p.get("where"))
        elif step.kind == "attribute_scan":
            found = records.where(p["where"].column()).select("id", F.lit(1.0).alias("score"))
        elif step.kind == "expand_graph" and found is not None:
            seeds = found.select("id", F.col("score").alias("similarity"))
            found = graph.context_chain(records, edges, seeds, p.get("hops", 2))[0].select("id", "score")
        elif step.kind == "hierarchy_walk" and nodes is not None:
            found = hierarchy.descendants(nodes, p["root"]).select("id", (1 / (1 + F.col("steps"))).alias("score"))
        else:
            warnings.warn(f"step {step.kind!r} can't run here", stacklevel=2)
    return found if found is not None else records.limit(0).select("id", F.lit(0.0).alias("score"))
