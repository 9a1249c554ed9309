"""Changes of a store's tables, each as a function of tables to tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallgrid.plans.schema import DELETED, FORGOTTEN, dead


class Tables(NamedTuple):
    records: DataFrame
    vectors: DataFrame
    edges: DataFrame


def last_wins(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Of rows with equal keys the last by order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))
    return rows.withColumn("__n", place).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new in place of rows of old with its keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def add(tables: Tables, records: DataFrame, vectors: DataFrame, edges: DataFrame | None = None) -> Tables:
    """Adds or replaces records and their vectors. A record that comes without
    edges keeps those it has; one with edges loses them to the new ones."""
    kept = tables.edges
    if edges is not None:
        incoming = edges.join(records.select(F.col("id").alias("src")), "src", "left_semi").select(*kept.columns)
        kept = kept.join(incoming.select("src").distinct(), "src", "left_anti").select(*kept.columns).unionByName(incoming)
    return Tables(upsert(tables.records, records, ["id"]), upsert(tables.vectors, vectors, ["modality", "id"]), kept)


def dimension_errors(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """(modality, id, dim, expected): new vectors of another dimension than
    their modality has. The first vector, by id, sets it where there is none."""
    have = vectors.groupBy("modality").agg(F.first(F.size("vec")).alias("had"))
    given = new.groupBy("modality").agg(F.min_by(F.size("vec"), F.col("id")).alias("first"))
    expected = given.join(have, "modality", "left").select("modality", F.coalesce("had", "first").alias("expected"))
    return new.join(expected, "modality").where(F.size("vec") != F.col("expected")).select("modality", "id", F.size("vec").alias("dim"), "expected")


def update_metadata(tables: Tables, records: DataFrame, edges: DataFrame) -> Tables:
    """Replaces records with all their edges; unknown ids become records without a vector."""
    others = tables.edges.join(records.select(F.col("id").alias("src")), "src", "left_anti").select(*tables.edges.columns)
    own = edges.join(records.select(F.col("id").alias("src")), "src", "left_semi").select(*tables.edges.columns)
    return Tables(upsert(tables.records, records, ["id"]), tables.vectors, others.unionByName(own))


def update_importance(records: DataFrame, record_id: int, value: float) -> DataFrame:
    return records.withColumn("importance", F.when(F.col("id") == record_id, F.lit(value).cast("float")).otherwise(F.col("importance")))


def set_attribute(records: DataFrame, record_id: int, key: str, value: str) -> DataFrame:
    others = F.map_filter("attributes", lambda k, _: k != key)
    return records.withColumn("attributes", F.when(F.col("id") == record_id, F.map_concat(others, F.create_map(F.lit(key), F.lit(value)))).otherwise(F.col("attributes")))


def get_attribute(key: str, default: str = "") -> Column:
    return F.coalesce(F.element_at("attributes", key), F.lit(default))


def fold_touches(records: DataFrame, touches: DataFrame) -> DataFrame:
    """Counts the log of touches (id, ts) into records; unknown ids change nothing."""
    folded = touches.groupBy("id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    joined = records.join(folded, "id", "left")
    joined = joined.withColumn("recall_count", F.col("recall_count") + F.coalesce("n", F.lit(0)))
    joined = joined.withColumn("last_recalled_at", F.greatest(F.col("last_recalled_at"), F.coalesce("last", F.lit(0))))
    return joined.select(*records.columns)


def _forgotten(records: DataFrame, hit: Column) -> DataFrame:
    change = {"content": F.lit(""), "source": F.lit(FORGOTTEN), "importance": F.lit(0.0).cast("float"), "ttl": F.lit(0).cast("bigint")}
    return records.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in change.items()})


def forget(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Soft delete of ids (id): the content goes, edges stay."""
    marked = records.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    return _forgotten(marked, F.coalesce("__hit", F.lit(False))).select(*records.columns)


def expired(now: int) -> Column:
    """Strictly past its time to live, and not dead already."""
    return (F.col("ttl") > 0) & (F.lit(now) > F.col("ts") + F.col("ttl")) & ~dead()


def forget_expired(records: DataFrame, now: int) -> DataFrame:
    return _forgotten(records, expired(now))


def mark_deleted(records: DataFrame, ids: DataFrame) -> DataFrame:
    marked = records.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    attributes = F.map_concat(F.map_filter("attributes", lambda k, _: k != DELETED), F.create_map(F.lit(DELETED), F.lit("true")))
    return marked.withColumn("attributes", F.when(F.col("__hit"), attributes).otherwise(F.col("attributes"))).select(*records.columns)


def purge(tables: Tables, namespace: str) -> Tables:
    """Hard delete of a namespace: records, vectors, and edges at either end."""
    gone = tables.records.where(F.col("namespace_id") == namespace).select("id")
    edges = tables.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return Tables(tables.records.where(F.col("namespace_id") != namespace), tables.vectors.join(gone, "id", "left_anti").select(*tables.vectors.columns), edges.select(*tables.edges.columns))


def compact(tables: Tables) -> Tables:
    """Without dead records and their vectors and edges."""
    gone = tables.records.where(dead()).select("id")
    return Tables(tables.records.where(~dead()), tables.vectors.join(gone, "id", "left_anti").select(*tables.vectors.columns), tables.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").select(*tables.edges.columns))


def dead_share(tables: Tables) -> DataFrame:
    """(modality, share): how much of each modality's vectors is dead."""
    state = tables.records.select("id", dead().alias("dead"))
    return tables.vectors.join(state, "id").groupBy("modality").agg(F.avg(F.col("dead").cast("double")).alias("share"))


def compact_if(tables: Tables, ratio: float) -> Tables:
    """Compacts once a modality's dead share reaches ratio; 0: never."""
    if ratio > 0 and dead_share(tables).where(F.col("share") >= ratio).limit(1).count():
        return compact(tables)
    return tables


def batch_delete(tables: Tables, ids: DataFrame, entities: list[str] = (), prune: bool = True) -> tuple[Tables, DataFrame]:
    """Forgets ids and all members of entities; (tables, report), the report
    with one row: deleted, not_found. prune: edges into them go."""
    members = tables.records.where(F.col("entity_id").isin(*entities)).select("id") if entities else tables.records.limit(0).select("id")
    asked = ids.select("id").union(members).distinct()
    known = tables.records.where(~dead()).select("id", F.lit(True).alias("known"))
    report = asked.join(known, "id", "left").agg(F.count_if(F.col("known").isNotNull()).alias("deleted"), F.count_if(F.col("known").isNull()).alias("not_found"))
    edges = tables.edges.join(asked.withColumnRenamed("id", "dst"), "dst", "left_anti").select(*tables.edges.columns) if prune else tables.edges
    return Tables(forget(tables.records, asked), tables.vectors, edges), report


def merge_records(target: DataFrame, source: DataFrame, policy: str = "keep_target") -> DataFrame:
    """Records of two stores. policy for ids in both: keep_target, keep_source
    or merge (target's fields, attributes of both with the source's first,
    the greater importance and confidence)."""
    if policy == "keep_target":
        return target.unionByName(source.join(target.select("id"), "id", "left_anti").select(*target.columns))
    if policy == "keep_source":
        return upsert(target, source.select(*target.columns), ["id"])
    if policy != "merge":
        raise ValueError(f"unknown policy {policy!r}")
    t, s = target.alias("t"), source.alias("s")
    joined = t.join(s, F.col("t.id") == F.col("s.id"), "full_outer")

    def both(c: str) -> Column:
        left, right = F.col(f"t.{c}"), F.col(f"s.{c}")
        if c == "attributes":
            none = F.create_map().cast("map<string,string>")
            own = F.map_filter(F.coalesce(left, none), lambda k, _: ~F.map_contains_key(F.coalesce(right, none), k))
            return F.map_concat(own, F.coalesce(right, none)).alias(c)
        if c in ("importance", "confidence"):
            return F.greatest(left, right).alias(c)
        return F.coalesce(left, right).alias(c)

    return joined.select(*[both(c) for c in target.columns])


def merge(target: Tables, source: Tables, policy: str = "keep_target", modalities: list[str] | None = None) -> Tables:
    """Both stores in one. Only source records with a vector come. Those that
    are new bring their vectors and all their edges. Of ids in both, records
    follow the policy; under keep_source the source's vectors and, if it has
    any, edges take the place of the target's, under the others the target's
    vectors stay and source edges to records that are there are added. The
    target's other edges stay as they are; of edges alike in src, dst and
    rel_type the target's is the one that stays."""
    incoming = source.vectors if modalities is None else source.vectors.where(F.col("modality").isin(*modalities))
    chosen = source.records.join(incoming.select("id").distinct(), "id", "left_semi")
    incoming = incoming.join(chosen.select("id"), "id", "left_semi").select(*target.vectors.columns)
    records = merge_records(target.records, chosen, policy)
    offered = source.edges.join(chosen.select(F.col("id").alias("src")), "src", "left_semi").select(*target.edges.columns)
    kept = target.edges
    if policy == "keep_source":
        vectors = upsert(target.vectors, incoming, ["modality", "id"])
        kept = kept.join(offered.select("src").distinct(), "src", "left_anti").select(*target.edges.columns)
    else:
        known = target.records.select("id")
        vectors = target.vectors.unionByName(incoming.join(known, "id", "left_anti").select(*target.vectors.columns))
        new = offered.join(known.withColumnRenamed("id", "src"), "src", "left_anti").select(*target.edges.columns)
        more = offered.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(records.select(F.col("id").alias("dst")), "dst", "left_semi")
        offered = new.unionByName(more.select(*target.edges.columns))
    key = ["src", "dst", "rel_type"]
    fresh = offered.join(kept.select(*key), key, "left_anti").groupBy(*key).agg(F.max("weight").alias("weight"))
    return Tables(records, vectors, kept.unionByName(fresh.select(*target.edges.columns)))
