"""Trees of nodes (id, parent_id, level, name), parents above their children."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = ("brand", "channel", "campaign", "adset", "ad", "creative")


def problems(nodes: DataFrame, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """(id, problem): a level that isn't known, a parent that is missing or not above."""
    place = F.element_at(F.create_map(*[F.lit(x) for k, name in enumerate(levels) for x in (name, k)]), F.col("level"))
    known = nodes.select("id", "parent_id", place.alias("at"))
    parent = known.select(F.col("id").alias("parent_id"), F.col("at").alias("parent_at"), F.lit(True).alias("there"))
    joined = known.join(parent, "parent_id", "left")
    problem = F.when(F.col("at").isNull(), "unknown level").when(F.col("parent_id").isNotNull() & F.col("there").isNull(), "missing parent").when(F.col("parent_at") >= F.col("at"), "parent not above")
    return joined.select("id", problem.alias("problem")).where("problem is not null")


def ancestors(nodes: DataFrame, most: int = len(LEVELS)) -> DataFrame:
    """(id, ancestor, steps) for all nodes, up to most steps, one join a step;
    a node is not its own ancestor, and a cycle ends after most steps."""
    up = nodes.where("parent_id is not null").select("id", F.col("parent_id").alias("ancestor"))
    front = up.withColumn("steps", F.lit(1))
    out = front
    parents = up.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("next"))
    for k in range(2, most + 1):
        front = front.join(parents, "ancestor").select("id", F.col("next").alias("ancestor"), F.lit(k).alias("steps"))
        out = out.unionByName(front)
    return out.where("id <> ancestor").groupBy("id", "ancestor").agg(F.min("steps").alias("steps"))


def children(nodes: DataFrame, node_id: int) -> DataFrame:
    return nodes.where(F.col("parent_id") == node_id)


def descendants(nodes: DataFrame, node_id: int, most: int = len(LEVELS)) -> DataFrame:
    """(id, steps) below a node."""
    return ancestors(nodes, most).where(F.col("ancestor") == node_id).select("id", "steps")


def lowest_common(nodes: DataFrame, pairs: DataFrame, most: int = len(LEVELS)) -> DataFrame:
    """(a, b, lca) of pairs (a, b): the nearest node that both are or lie
    under; null if there is none."""
    closed = ancestors(nodes, most).unionByName(nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("steps")))
    left = pairs.join(closed.withColumnRenamed("id", "a"), "a").withColumnRenamed("steps", "up_a")
    right = pairs.join(closed.withColumnRenamed("id", "b"), "b").withColumnRenamed("steps", "up_b")
    common = left.join(right, ["a", "b", "ancestor"]).groupBy("a", "b").agg(F.min_by("ancestor", F.struct(F.col("up_a") + F.col("up_b"), F.col("ancestor"))).alias("lca"))
    return pairs.join(common, ["a", "b"], "left").select("a", "b", "lca")
