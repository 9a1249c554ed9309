"""The typed, weighted graph of a store: edges (src, dst, rel_type, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallgrid.functions import vectors as V
from recallgrid.functions.scoring import stickiness
from recallgrid.operators.search import search_batch
from recallgrid.plans.schema import dead, live
from recallgrid.plans.session import ensure_checkpoint_dir

# Relation types.
RELATIONS = ("related_to", "derived_from", "caused_by", "contradicts", "supports", "precedes", "part_of", "references", "multimodal_of")


def out_edges(edges: DataFrame, record_id: int) -> DataFrame:
    return edges.where(F.col("src") == record_id)


def in_edges(edges: DataFrame, record_id: int) -> DataFrame:
    return edges.where(F.col("dst") == record_id)


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge as (id, other, rel_type, weight, way) from either end."""
    ends = F.array(
        F.struct(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit("out").alias("way")),
        F.struct(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit("in").alias("way")),
    )
    return edges.select("rel_type", "weight", F.explode(ends).alias("e")).select("e.id", "e.other", "rel_type", "weight", "e.way")


def related(edges: DataFrame, records: DataFrame, record_id: int, way: str = "both", rel_type: str | None = None) -> DataFrame:
    """Neighbours of a record that are there: other, rel_type, weight, way, content."""
    near = both_ways(edges).where(F.col("id") == record_id)
    if way != "both":
        near = near.where(F.col("way") == way)
    if rel_type is not None:
        near = near.where(F.col("rel_type") == rel_type)
    return near.join(records.select(F.col("id").alias("other"), "content"), "other").select("other", "rel_type", "weight", "way", "content")


def link(edges: DataFrame, new: DataFrame, records: DataFrame, order: str | None = None) -> DataFrame:
    """edges with new ones: those whose source is a record and whose (src, dst,
    rel_type) isn't there yet. Of equal ones the first stays, by the column
    order of new, or by their place in new if that isn't given."""
    placed = new.withColumn("__order", F.col(order) if order else F.monotonically_increasing_id())
    fresh = placed.join(records.select(F.col("id").alias("src")), "src", "left_semi").join(edges.select("src", "dst", "rel_type"), ["src", "dst", "rel_type"], "left_anti")
    first = fresh.groupBy("src", "dst", "rel_type").agg(F.min_by("weight", "__order").alias("weight"))
    return edges.unionByName(first.select(*edges.columns))


def unlink(edges: DataFrame, src: int, dst: int) -> DataFrame:
    """Without the edges of any type from src to dst."""
    return edges.where(~((F.col("src") == src) & (F.col("dst") == dst)))


def prune_dead(edges: DataFrame, records: DataFrame) -> DataFrame:
    """Without the edges of live sources to what is missing or dead."""
    state = records.select("id", dead().alias("dead"))
    sources = state.select(F.col("id").alias("src"), F.col("dead").alias("src_dead"))
    alive = state.where("not dead").select(F.col("id").alias("dst"), F.lit(True).alias("dst_alive"))
    joined = edges.join(sources, "src", "left").join(alive, "dst", "left")
    return joined.where(F.coalesce("src_dead", F.lit(True)) | F.col("dst_alive").isNotNull()).select(*edges.columns)


def auto_link(records: DataFrame, vectors: DataFrame, edges: DataFrame, threshold: float = 0.8, rel_type: str = "related_to", candidates: int = 15) -> DataFrame:
    """New edges of live records to their nearest: of each one's candidates
    nearest others those with 1 / (1 + squared distance) of at least
    threshold, weight that similarity, which aren't there yet."""
    alive = vectors.join(live(records).select("id"), "id", "left_semi").select("id", "vec")
    near = search_batch(alive, alive.select(F.col("id").alias("query_id"), "vec"), candidates + 1)
    made = near.where("query_id <> id").select(F.col("query_id").alias("src"), F.col("id").alias("dst"), F.lit(rel_type).alias("rel_type"), V.similarity(F.col("distance")).alias("weight"), "rank")
    nth = F.row_number().over(Window.partitionBy("src").orderBy("rank"))
    made = made.withColumn("nth", nth).where((F.col("nth") <= candidates) & (F.col("weight") >= threshold)).drop("nth", "rank")
    return made.join(edges.select("src", "dst", "rel_type"), ["src", "dst", "rel_type"], "left_anti").select("src", "dst", "rel_type", "weight")


def hops(edges: DataFrame, seeds: DataFrame, most: int = 2) -> DataFrame:
    """(id, hop): what a walk along edges in both directions reaches from
    seeds (id), with the fewest steps. Each hop is one join and one
    aggregation of what was reached before, in a table of its own."""
    ensure_checkpoint_dir(edges.sparkSession)
    steps = both_ways(edges).select("id", "other")
    seen = seeds.select("id").distinct().withColumn("hop", F.lit(0))
    for hop in range(1, most + 1):
        front = seen.where(F.col("hop") == hop - 1).select("id").join(steps, "id").select(F.col("other").alias("id"), F.lit(hop).alias("hop"))
        seen = seen.unionByName(front).groupBy("id").agg(F.min("hop").alias("hop"))
        if hop < most:
            seen = seen.checkpoint()
    return seen


def context_chain(records: DataFrame, edges: DataFrame, seeds: DataFrame, most: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, hop, similarity, score) and edges around the results of a
    search, seeds (id, similarity). A seed scores similarity x importance x
    stickiness, others importance x stickiness / (1 + hop); what isn't a
    record counts with importance 1 and no recalls. Edges are those of nodes
    within less than most hops."""
    reach = hops(edges, seeds, most)
    known = records.select("id", F.col("importance").cast("double").alias("importance"), "recall_count")
    nodes = reach.join(seeds.select("id", "similarity"), "id", "left").join(known, "id", "left")
    weight = F.coalesce("importance", F.lit(1.0)) * stickiness(F.coalesce("recall_count", F.lit(0)))
    similarity = F.when(F.col("hop") == 0, F.coalesce("similarity", F.lit(0.0))).otherwise(0.0)
    score = F.when(F.col("hop") == 0, similarity).otherwise(1 / (1 + F.col("hop"))) * weight
    inner = reach.where(F.col("hop") < most).select("id")
    touched = edges.join(inner.select(F.col("id").alias("src")), "src", "left_semi").unionByName(edges.join(inner.select(F.col("id").alias("dst")), "dst", "left_semi").select(*edges.columns))
    return nodes.select("id", "hop", similarity.alias("similarity"), score.alias("score")), touched.dropDuplicates(["src", "dst", "rel_type"])


def export_nodes(records: DataFrame, namespace: str | None = None, entity: str | None = None) -> DataFrame:
    """(id, label, namespace_id, entity_id) of live records; labels are the first 60 bytes."""
    hit = live(records)
    if namespace is not None:
        hit = hit.where(F.col("namespace_id") == namespace)
    if entity is not None:
        hit = hit.where(F.col("entity_id") == entity)
    label = F.decode(F.substring(F.encode("content", "UTF-8"), 1, 60), "UTF-8")
    return hit.select("id", F.when(F.octet_length("content") <= 60, F.col("content")).otherwise(label).alias("label"), "namespace_id", "entity_id")


def export_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends among nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "rel_type", "weight")


def as_json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON text, for a sink of lines."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def degree(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("id").agg(F.count_if(F.col("way") == "out").alias("n_out"), F.count_if(F.col("way") == "in").alias("n_in"))


def pair_key(a: Column, b: Column) -> Column:
    """The same for (a, b) and (b, a)."""
    return F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))
