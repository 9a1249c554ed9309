"""Standing queries, buckets and replay over streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recallgrid.functions import vectors as V


def watch_matches(nodes: DataFrame, watches: DataFrame) -> DataFrame:
    """(node_id, watch_id, similarity) of nodes (node_id, vec), a stream or a
    table, with watches (watch_id, vec, threshold) by cosine. Watches are a
    static table that people keep, at most a few thousand, and are sent to
    all executors; zero vectors match nothing."""
    w = F.broadcast(watches.select("watch_id", F.col("vec").alias("__w"), "threshold", V.norm(F.col("vec")).alias("__wn")).where("__wn > 1e-9"))
    joined = nodes.withColumn("__n", V.norm(F.col("vec"))).where("__n > 1e-9").join(w)
    similarity = V.inner_product(F.col("vec"), F.col("__w")) / (F.col("__n") * F.col("__wn"))
    return joined.withColumn("similarity", similarity).where("similarity >= threshold").select("node_id", "watch_id", "similarity")


def on_matches(nodes: DataFrame, watches: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Hands each batch's matches to callback(matches, batch_id). A batch may
    come again after a failure, under the same id."""
    writer = watch_matches(nodes, watches).writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def tumbling(ops: DataFrame, width: str = "1 hour", late: str = "10 minutes", origin: str | None = None) -> DataFrame:
    """(start, op, n, errors) of ops (ts: timestamp, op, status) in windows
    that start at origin; rows later than late are dropped."""
    window = F.window("ts", width, width, origin) if origin else F.window("ts", width)
    grouped = ops.withWatermark("ts", late).groupBy(window.alias("w"), "op")
    return grouped.agg(F.count("*").alias("n"), F.count_if(F.col("status") >= 400).alias("errors")).select(F.col("w.start").alias("start"), "op", "n", "errors")


def sliding(ops: DataFrame, width: str, step: str, late: str = "10 minutes") -> DataFrame:
    grouped = ops.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w"), "op")
    return grouped.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "op", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events with no gap longer than gap."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def apply_log(ops: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """A log of operations applied batch by batch: apply(batch, batch_id)
    saves a store after each, so that saves are as far apart as triggers."""
    return ops.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def feedback_stream(spark, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(path)
