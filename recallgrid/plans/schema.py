"""The three tables of a store, and what makes a record dead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDS = (
    "id bigint, ts bigint, importance float, type tinyint, source string, content string, tags_json string, recall_count bigint, last_recalled_at bigint, "
    "namespace_id string, entity_id string, attributes map<string,string>, ttl bigint, confidence float"
)
VECTORS = "modality string, id bigint, vec array<float>"
EDGES = "src bigint, dst bigint, rel_type string, weight float"
FEEDBACK = "kind string, target_id bigint, namespace_id string, timestamp bigint, user_id string, payload string, notes string, event_id string"

FACT, PREFERENCE, EVENT, CONVERSATION = range(4)
FORGOTTEN = "_forgotten"
DELETED = "_deleted"

#: What a missing field of a record means.
DEFAULTS = {
    "ts": "0L", "importance": "1.0F", "type": "0Y", "source": "''", "content": "''", "tags_json": "''", "recall_count": "0L", "last_recalled_at": "0L",
    "namespace_id": "''", "entity_id": "''", "attributes": "cast(map() as map<string,string>)", "ttl": "0L", "confidence": "1.0F",
}


def as_records(df: DataFrame) -> DataFrame:
    """df with all columns of RECORDS, in order; missing and null ones get
    their defaults, so that there are no nulls but in id."""
    types = dict(part.strip().split(" ", 1) for part in _fields(RECORDS))
    columns = []
    for name, kind in types.items():
        default = F.expr(DEFAULTS[name]) if name in DEFAULTS else None
        value = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
        columns.append((F.coalesce(value, default) if default is not None else value).alias(name))
    return df.select(*columns)


def _fields(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for k, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:k])
            start = k + 1
    return [*out, schema[start:]]


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def dead() -> Column:
    """True for forgotten and deleted records."""
    return (F.col("source") == FORGOTTEN) | F.coalesce(F.element_at("attributes", DELETED) == "true", F.lit(False))


def live(records: DataFrame) -> DataFrame:
    return records.where(~dead())
