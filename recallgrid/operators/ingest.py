"""Texts into a store: embedded, classified, checked against what is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recallgrid.functions import vectors as V
from recallgrid.functions.text import hashed_id, keyword_class
from recallgrid.operators.graph import link
from recallgrid.operators.lifecycle import Tables, add
from recallgrid.operators.search import search_batch
from recallgrid.plans.schema import as_records

#: What a caller may set, whatever the classes say.
HINTS = ("namespace", "entity_type", "importance", "confidence", "ttl", "source")


def classified(texts: DataFrame, now: int, hints: dict | None = None, classify: Callable[[Column], Column] = keyword_class) -> DataFrame:
    """Records of texts (content, and id or a hash of content and now): class,
    importance and confidence by classify, hints before these. Blank texts
    make none."""
    hints = hints or {}
    kept = texts.where(F.trim("content") != "")
    record_id = F.col("id") if "id" in texts.columns else hashed_id(F.concat_ws("\x1f", F.lit(str(now)), "content"))
    rows = kept.select(record_id.alias("id"), "content", classify(F.col("content")).alias("c"))
    kind = F.lit(hints["entity_type"]) if "entity_type" in hints else F.col("c.entity_type")

    def held(name: str) -> Column:
        value = F.lit(float(hints[name])) if name in hints else F.col(f"c.{name}")
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)).cast("float").alias(name)

    return as_records(rows.select(
        "id", "content", F.lit(now).cast("bigint").alias("ts"), held("importance"), held("confidence"), F.lit(hints.get("namespace", "")).alias("namespace_id"),
        F.lit(hints.get("source", "ingest")).alias("source"), F.lit(int(hints.get("ttl", 0))).cast("bigint").alias("ttl"), F.create_map(F.lit("entity_type"), kind).alias("attributes"),
    ))


def related_edges(stored: DataFrame, new: DataFrame, least: float = 0.8, k: int = 5) -> DataFrame:
    """related_to edges from new vectors (id, vec) to the nearest of stored
    ones, with their similarity of least at least."""
    near = search_batch(stored, new.select(F.col("id").alias("query_id"), "vec"), k)
    found = near.select(F.col("query_id").alias("src"), F.col("id").alias("dst"), F.lit("related_to").alias("rel_type"), V.similarity(F.col("distance")).cast("float").alias("weight"))
    return found.where((F.col("src") != F.col("dst")) & (F.col("weight") >= least))


def contradicting(tables: Tables, new: DataFrame, vectors: DataFrame, least: float = 0.9, k: int = 10) -> DataFrame:
    """contradicts edges from new records to stored ones that are alike by
    their vectors but come from another source or say otherwise."""
    near = search_batch(tables.vectors, vectors.select(F.col("id").alias("query_id"), "vec"), k)
    alike = near.withColumn("weight", V.similarity(F.col("distance")).cast("float")).where(F.col("weight") >= least)
    said = tables.records.select("id", F.col("content").alias("old"), F.col("source").alias("old_source"))
    asked = new.select(F.col("id").alias("query_id"), "content", "source")
    joined = alike.join(said, "id").join(asked, "query_id").where((F.col("query_id") != F.col("id")) & (F.col("old") != F.col("content")) & (F.col("old_source") != F.col("source")))
    return joined.select(F.col("query_id").alias("src"), F.col("id").alias("dst"), F.lit("contradicts").alias("rel_type"), "weight")


def ingest_texts(tables: Tables, texts: DataFrame, embed: Callable[[Column], Column], now: int, hints: dict | None = None, classify: Callable[[Column], Column] = keyword_class, link_least: float = 0.8, contradict_least: float = 0.9) -> tuple[Tables, DataFrame]:
    """(tables with texts, their ids (id)): embedded, classified, linked to
    what they are near, and to what of another source they contradict."""
    records = classified(texts, now, hints, classify)
    vectors = records.select(F.lit("text").alias("modality"), "id", embed(F.col("content")).cast("array<float>").alias("vec"))
    grown = add(tables, records, vectors)
    made = related_edges(tables.vectors, vectors, link_least).unionByName(contradicting(tables, records, vectors, contradict_least))
    return grown._replace(edges=link(grown.edges, made.select(*grown.edges.columns), grown.records)), records.select("id")


def ingest_stream(texts: DataFrame, store, embed: Callable[[Column], Column], checkpoint: str, hints: dict | None = None, every: str | None = None) -> StreamingQuery:
    """A stream of texts (content, ts) into a store (open(), save()), each
    batch checked against what was there before it. every: the least time
    between saves, as a trigger's interval; without it what is there is taken
    and the stream ends. A batch that comes again writes the same ids."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        last = batch.agg(F.max("ts")).first()[0]
        if last is not None:
            grown, _ = ingest_texts(store.open(), batch.drop("ts"), embed, int(last), hints)
            store.save(grown)

    writer = texts.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
