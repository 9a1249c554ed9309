"""Logs and foreign files: operations, feedback, ad exports, vector files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.operators.graph import link
from recallgrid.operators.lifecycle import Tables, forget, last_wins, upsert
from recallgrid.plans.schema import FEEDBACK, RECORDS, VECTORS, as_records

OPS = f"seq bigint, op string, id bigint, record struct<{RECORDS.replace('id bigint, ', '', 1)}>, vectors array<struct<modality:string,vec:array<float>>>, importance float, dst bigint, rel_type string, weight float, edges array<struct<dst:bigint,rel_type:string,weight:float>>"
KINDS = ("fact_corrected", "fact_endorsed", "fact_retracted", "retrieval_thumbs_up", "retrieval_thumbs_down", "entity_merged", "contradiction_resolved")


def append_ops(ops: DataFrame, path: str) -> None:
    """Appends operations (OPS) to a log: ADD, UPDATE, UIMP, LINK, FORGET."""
    ops.write.mode("append").parquet(path)


def read_ops(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OPS).parquet(path)


def replay(tables: Tables, ops: DataFrame) -> Tables:
    """The tables after all operations in the order of seq. Each record's
    last full write, the importance set after it, and whether it was forgotten
    later are found by aggregation, not one operation at a time. A full write
    with edges, and every UPDATE, puts its edges in the place of the record's;
    later links add to them. Logs without the column edges have none."""
    if "edges" not in ops.columns:
        ops = ops.withColumn("edges", F.lit(None).cast("array<struct<dst:bigint,rel_type:string,weight:float>>"))
    full = ops.where(F.col("op").isin("ADD", "UPDATE"))
    last = last_wins(full, ["id"], F.col("seq"))
    written = as_records(last.select("id", "record.*"))
    base = upsert(tables.records, written, ["id"])
    since = last.select("id", F.col("seq").alias("since"))
    later = ops.where(F.col("op") == "UIMP").join(since, "id", "left").where(F.col("seq") > F.coalesce("since", F.lit(-1)))
    importance = later.groupBy("id").agg(F.max_by("importance", "seq").alias("__importance"))
    base = base.join(importance, "id", "left").withColumn("importance", F.coalesce("__importance", "importance")).select(*tables.records.columns)
    gone = ops.where(F.col("op") == "FORGET").join(since, "id", "left").where(F.col("seq") > F.coalesce("since", F.lit(-1))).select("id").distinct()
    adds = last_wins(ops.where(F.col("op") == "ADD").select("seq", "id", F.explode("vectors").alias("v")).select("seq", F.col("v.modality").alias("modality"), "id", F.col("v.vec").alias("vec")), ["modality", "id"], F.col("seq"))
    vectors = upsert(tables.vectors, adds.select("modality", "id", "vec"), ["modality", "id"])
    # the last write of a record's edges, which earlier edges and links don't survive
    reset = last_wins(full.where((F.col("op") == "UPDATE") | (F.size("edges") > 0)), ["id"], F.col("seq")).select(F.col("id").alias("src"), F.col("seq").alias("reset"), "edges")
    kept = tables.edges.join(reset.select("src"), "src", "left_anti").select(*tables.edges.columns)
    own = reset.select("src", F.explode("edges").alias("e")).select("src", "e.dst", "e.rel_type", "e.weight")
    standing = kept.unionByName(own.groupBy("src", "dst", "rel_type").agg(F.first("weight").alias("weight")).select(*tables.edges.columns))
    links = ops.where(F.col("op") == "LINK").select(F.col("id").alias("src"), "dst", "rel_type", "weight", "seq").join(reset.select("src", "reset"), "src", "left")
    links = links.where(F.col("seq") > F.coalesce("reset", F.lit(-1))).drop("reset")
    return Tables(forget(base, gone), vectors, link(standing, links, base, "seq"))


def append_feedback(events: DataFrame, path: str) -> None:
    """Appends feedback; unknown kinds are refused before anything is written."""
    bad = events.where(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))).select("kind").distinct().limit(5).collect()
    if bad:
        raise ValueError(f"unknown kinds of feedback: {[r[0] for r in bad]}")
    events.write.mode("append").json(path)


def read_feedback(spark: SparkSession, path: str, namespace: str | None = None, kind: str | None = None, target: int | None = None, user: str | None = None, since: int | None = None, until: int | None = None) -> DataFrame:
    """Feedback events; bounds of time are inclusive, lines that aren't JSON are skipped."""
    out = spark.read.schema(FEEDBACK).option("mode", "DROPMALFORMED").json(path)
    for column, value in (("namespace_id", namespace), ("kind", kind), ("target_id", target), ("user_id", user)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if since is not None:
        out = out.where(F.col("timestamp") >= since)
    return out.where(F.col("timestamp") <= until) if until is not None else out


def with_event_ids(events: DataFrame) -> DataFrame:
    """event_id from what the event says, so that a second append is seen as the same."""
    said = F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("kind", "namespace_id", "notes", "payload", "target_id", "timestamp", "user_id")]))
    return events.withColumn("event_id", F.substring(F.sha2(said, 256), 1, 12))


#: Fixed value: how exports of ads write a missing value.
NULL = "ᴺᵁᴸᴸ"


def read_ad_export(spark: SparkSession, path: str, numbers: tuple[str, ...] = ("roas", "total_spend", "ctr")) -> DataFrame:
    """An export of ads: column names first, one to a line, then rows parted
    by tabs, a row's number in front. Rows of another width are left out;
    numbers that don't read are null."""
    lines = spark.read.text(path)
    names = []
    for row in lines.limit(500).collect():  # the head of one file
        if "\t" in row[0]:
            break
        if row[0].strip():
            names.append(row[0].strip())
    parts = F.split(F.trim("value"), "\t", -1)
    rows = lines.where(F.col("value").contains("\t")).select(parts.alias("p")).where(F.size("p") == len(names) + 1)
    columns = [F.element_at("p", 1).try_cast("bigint").alias("row_num")]
    for k, name in enumerate(names):
        value = F.nullif(F.trim(F.element_at("p", k + 2)), F.lit(NULL))
        columns.append((value.try_cast("double") if name in numbers else value).alias(name))
    return rows.select(*columns)


def _vector_file(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                flat = np.frombuffer(content, dtype="<i4")
                if not len(flat):
                    continue
                rows = flat.reshape(-1, flat[0] + 1)[:, 1:]
                values = np.ascontiguousarray(rows).view("<f4") if kind == "f" else rows
                for i in range(0, len(values), 4096):
                    part = values[i : i + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(part), dtype=np.int64)), pa.array(list(part), pa.list_(pa.float32() if kind == "f" else pa.int32()))], names=["id", "vec"])

    return run


def read_fvecs(spark: SparkSession, path: str) -> DataFrame:
    """(id: place in the file, vec)."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_vector_file("f"), "id bigint, vec array<float>")


def read_ivecs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_vector_file("i"), "id bigint, vec array<int>")


def vectors_of(df: DataFrame, modality: str = "text") -> DataFrame:
    """(id, vec) as a store's vectors."""
    return df.select(F.lit(modality).alias("modality"), "id", F.col("vec").cast("array<float>").alias("vec")).to(df.sparkSession.createDataFrame([], VECTORS).schema)
