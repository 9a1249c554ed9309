"""Figures about a store: health, tiers, schema, roll-ups, feedback, metrics."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallgrid.functions import vectors as V
from recallgrid.operators.graph import both_ways
from recallgrid.operators.lifecycle import expired
from recallgrid.plans.schema import live
from recallgrid.plans.session import ensure_checkpoint_dir

LEVELS = ("brand", "channel", "campaign", "adset", "ad", "creative")


def health_report(records: DataFrame, edges: DataFrame, now: int) -> DataFrame:
    """One row: total, cold / warm / hot by recalls (0, 1-5, more), a histogram
    of recalls, orphans (without edges), expired, mean importance and confidence."""
    alive = live(records)
    linked = both_ways(edges).select("id").distinct().withColumn("linked", F.lit(True))
    c = F.col("recall_count")
    return alive.join(linked, "id", "left").agg(
        F.count("*").alias("total"), F.count_if(c == 0).alias("cold"), F.count_if(c.between(1, 5)).alias("warm"), F.count_if(c > 5).alias("hot"),
        F.count_if(c.between(6, 20)).alias("recalled_6_20"), F.count_if(c.between(21, 100)).alias("recalled_21_100"), F.count_if(c > 100).alias("recalled_over_100"),
        F.count_if(F.col("linked").isNull()).alias("orphans"), F.count_if(expired(now)).alias("expired"),
        F.round(F.avg(F.col("importance").cast("double")), 3).alias("avg_importance"), F.round(F.avg(F.col("confidence").cast("double")), 3).alias("avg_confidence"),
    )


def tiers(records: DataFrame, now: int) -> DataFrame:
    """(id, score, tier): the first tenth by 0.4 recalls + 60 / (1 + days since
    the last) is hot, the next three tenths warm, at least one of each. Places
    come from a global sort without one task for all: counts of ranges first."""
    days = (F.lit(now) - F.col("last_recalled_at")) / 86400.0
    score = 0.4 * F.col("recall_count") + F.when(F.col("last_recalled_at") > 0, 60 / (1 + F.greatest(F.lit(0.0), days))).otherwise(0.0)
    scored = live(records).select("id", score.alias("score"))
    ranked = global_rank(scored, [F.desc("score"), F.asc("id")])
    n = F.col("total")
    hot = F.greatest(F.lit(1), F.floor(n * 0.1))
    warm = F.greatest(F.lit(1), F.floor(n * 0.3))
    tier = F.when(F.col("place") <= hot, "hot").when(F.col("place") <= hot + warm, "warm").otherwise("cold")
    return ranked.select("id", "score", tier.alias("tier"))


def global_rank(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with place (from 1 by order, which must be total) and total. Rows are
    dealt out by ranges of the order and numbered within; only the ranges'
    sizes meet in one place."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ensure_checkpoint_dir(spark)
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = dealt.select("*", F.monotonically_increasing_id().alias("__at"))
    split = numbered.withColumn("__part", F.shiftright("__at", 33)).withColumn("__in", F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at")
    # ranges are drawn from a sample: both uses below must see the same
    split = split.checkpoint()
    sizes = split.groupBy("__part").count().withColumn("__before", F.sum("count").over(Window.orderBy("__part")) - F.col("count"))
    sizes = sizes.select("__part", "__before", F.sum("count").over(Window.partitionBy(F.lit(0))).alias("total"))
    # one row per partition
    joined = split.join(F.broadcast(sizes), "__part")
    return joined.withColumn("place", F.col("__before") + F.col("__in") + 1).drop("__part", "__in", "__before")


def namespace_sizes(records: DataFrame, most: int = 50) -> DataFrame:
    return live(records).groupBy("namespace_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "namespace_id").limit(most)


def list_namespaces(records: DataFrame) -> DataFrame:
    return live(records).select("namespace_id").where("namespace_id <> ''").distinct()


def overview(stores: DataFrame, most: int = 10) -> DataFrame:
    """(store, n, total) of the largest stores; stores: (store, id) of live records."""
    sizes = stores.groupBy("store").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    return sizes.orderBy(F.desc("n"), "store").limit(most).join(F.broadcast(total))


def discover_schema(records: DataFrame, samples: int = 8) -> DataFrame:
    """Of each attribute not starting with "_": records, different values
    (counted to 64), the first samples by value, and the type that its values
    have: int, float, bool or str, or mixed if they differ."""
    pairs = live(records).select(F.explode("attributes").alias("key", "value")).where(~F.col("key").startswith("_"))
    values = pairs.groupBy("key", "value").agg(F.count("*").alias("n"))
    v = F.col("value")
    kind = F.when(v.try_cast("bigint").isNotNull(), "int").when(v.try_cast("double").isNotNull(), "float").when(v.isin("true", "false", "True", "False"), "bool").otherwise("str")
    found = values.groupBy("key").agg(F.sum("n").alias("records"), F.least(F.count("*"), F.lit(64)).alias("different"), F.min(kind).alias("least"), F.max(kind).alias("most"))
    # tasks keep the first samples of a key before these meet
    first = values.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("value"))).where(F.col("nth") <= samples)
    shown = first.groupBy("key").agg(F.array_sort(F.collect_list("value")).alias("samples"))
    return found.join(shown, "key").select("key", "records", "different", "samples", F.when(F.col("least") == F.col("most"), F.col("least")).otherwise("mixed").alias("kind"))


def discover_names(records: DataFrame, namespaces: int = 20, sources: int = 10, entities: int = 20) -> DataFrame:
    """(what, name, n) of live records: the largest namespaces and sources, by
    number and then name, and entities of the smallest record ids (one row
    each, n null)."""
    alive = live(records)

    def largest(column: str, most: int) -> DataFrame:
        counted = alive.where(F.col(column) != "").groupBy(column).agg(F.count("*").alias("n"))
        return counted.orderBy(F.desc("n"), column).limit(most).select(F.lit(column).alias("what"), F.col(column).alias("name"), "n")

    met = alive.where("entity_id <> ''").orderBy("id").limit(entities).select(F.lit("entity_id").alias("what"), F.col("entity_id").alias("name"), F.lit(None).cast("bigint").alias("n"))
    return largest("namespace_id", namespaces).unionByName(largest("source", sources)).unionByName(met)


def roll_up(records: DataFrame, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """(path, depth, n): live records below each node of brand / channel / ...;
    a path ends at the first empty level, and the namespace stands in for a
    missing brand."""
    value = [F.coalesce(F.element_at("attributes", name), F.lit("")) for name in levels]
    value[0] = F.when(value[0] == "", F.col("namespace_id")).otherwise(value[0])
    named = live(records).select(F.array(*value).alias("all")).withColumn("gap", F.array_position("all", ""))
    depth = F.when(F.col("gap") == 0, F.size("all")).otherwise(F.col("gap").cast("int") - 1)
    paths = named.select(F.slice("all", F.lit(1), depth).alias("path")).where(F.size("path") > 0).groupBy("path").agg(F.count("*").alias("n"))
    prefixes = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", F.lit(1), k))).alias("path"), "n")
    return prefixes.groupBy(F.array_join("path", "/").alias("path"), F.size("path").alias("depth")).agg(F.sum("n").alias("n"))


def top_recalled(records: DataFrame, most: int = 10) -> DataFrame:
    return live(records).orderBy(F.desc("recall_count"), F.desc("last_recalled_at"), "id").limit(most).select("id", "recall_count", "last_recalled_at")


def timeline(records: DataFrame, where: Column, most: int = 20) -> DataFrame:
    """The newest matches, with total, the number of all."""
    hit = live(records).where(where)
    total = hit.agg(F.count("*").alias("total"))
    return hit.orderBy(F.desc("ts"), "id").limit(most).select("id", "ts", "namespace_id", "entity_id").join(F.broadcast(total))


def feedback_counts(feedback: DataFrame) -> DataFrame:
    """Of each target: counts by kind, all, and the last time."""
    def n(kind: str) -> Column:
        return F.count_if(F.col("kind") == kind)

    return feedback.groupBy("target_id").agg(
        n("fact_corrected").alias("corrected"), n("fact_endorsed").alias("endorsed"), n("fact_retracted").alias("retracted"), n("retrieval_thumbs_up").alias("up"), n("retrieval_thumbs_down").alias("down"),
        F.count("*").alias("total"), F.max("timestamp").alias("last_ts"),
    )


def metrics_snapshot(ops: DataFrame, now: float, seconds: float = 3600) -> DataFrame:
    """Of each op in the last seconds: count, errors (status from 400), and of
    the latencies p50 (the upper middle), p95 and p99 (place int(q n), from
    1). The places are found by counts of equal latencies, not in a list."""
    recent = ops.where((F.col("ts") >= now - seconds) & (F.col("ts") <= now))
    basic = recent.groupBy("op").agg(F.count("*").alias("n"), F.count_if(F.col("status") >= 400).alias("errors"))
    values = recent.groupBy("op", "latency_ms").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("op").orderBy("latency_ms"))
    placed = values.withColumn("upto", upto).join(basic.select("op", "n"), "op")

    def at(place: Column) -> Column:
        return F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), place), F.col("latency_ms")))

    n = F.col("n")
    marks = placed.groupBy("op").agg(at(F.floor(n / 2) + 1).alias("p50"), at(F.floor(n * 0.95)).alias("p95"), at(F.floor(n * 0.99)).alias("p99"))
    return basic.join(marks, "op").select("op", "n", "errors", "p50", "p95", "p99")


def latency_stats(samples: DataFrame) -> DataFrame:
    """Nearest rank: the value in place ceil(q n)."""
    q = {f"p{p}": F.expr(f"percentile_disc({p / 100}) within group (order by latency_ms)") for p in (50, 95, 99)}
    return samples.agg(F.count("*").alias("n"), F.avg("latency_ms").alias("mean"), *[c.alias(k) for k, c in q.items()])


def op_buckets(ops: DataFrame, now: int, window: int, width: int) -> DataFrame:
    """(start, n, errors) for every width seconds of the last window, zeros
    included; buckets start at now - window."""
    origin = now - window
    inside = ops.where((F.col("ts") >= origin) & (F.col("ts") < now))
    counted = inside.groupBy(F.floor((F.col("ts") - origin) / width).alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("status") >= 400).alias("errors"))
    frame = ops.sparkSession.range(-(-window // width)).withColumnRenamed("id", "k")
    return frame.join(counted, "k", "left").select((F.lit(origin) + F.col("k") * width).alias("start"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("errors", F.lit(0)).alias("errors"))


def activity(ops: DataFrame, most: int = 50) -> DataFrame:
    return ops.orderBy(F.desc("ts"), "op").limit(most)


def recall_at_k(predicted: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, recall) of predicted (query_id, rank, id) against truth alike."""
    hits = predicted.where(F.col("rank") <= k).select("query_id", "id").join(truth.where(F.col("rank") <= k).select("query_id", "id"), ["query_id", "id"])
    got = hits.groupBy("query_id").agg(F.count("*").alias("hits"))
    wanted = truth.where(F.col("rank") <= k).groupBy("query_id").agg(F.count("*").alias("wanted"))
    return wanted.join(got, "query_id", "left").select("query_id", (F.coalesce("hits", F.lit(0)) / F.col("wanted")).alias("recall"))


def ndcg_at_k(predicted: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg) with gains 1 for relevant (query_id, id), discounts log2(1 + rank)."""
    def discount(rank: Column) -> Column:
        return 1 / F.log2(rank + 1)

    gained = predicted.where(F.col("rank") <= k).join(relevant, ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.sum(discount(F.col("rank"))).alias("dcg"))
    ideal = relevant.groupBy("query_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("m"))
    best = F.aggregate(F.sequence(F.lit(1), F.col("m")), F.lit(0.0), lambda s, r: s + discount(r))
    return ideal.join(gained, "query_id", "left").select("query_id", (F.coalesce("dcg", F.lit(0.0)) / best).alias("ndcg"))


def mean_by(scores: DataFrame, axis: str, value: str) -> DataFrame:
    return scores.groupBy(axis).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def centroid(vectors: DataFrame, by: list[str]) -> DataFrame:
    """The mean of each group's vectors, normalized."""
    parts = vectors.select(*by, F.posexplode(F.col("vec").cast("array<double>")).alias("at", "x")).groupBy(*by, "at").agg(F.avg("x").alias("x"))
    whole = parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("vec"))
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    return whole.withColumn("vec", F.when(length > 0, F.transform("vec", lambda x: x / length)).otherwise(F.col("vec")))


def plane(vectors: DataFrame, k: int = 2) -> DataFrame:
    """(id, x): vectors (id, vec) of one dimension on their first k principal
    axes, centred; each axis has the sign that makes its largest weight
    positive."""
    featured = vectors.select("id", array_to_vector(F.col("vec").cast("array<double>")).alias("v"))
    axes = PCA(k=k, inputCol="v", outputCol="p").fit(featured).pc.toArray()
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)])
    # one row: the mean of each component
    mean = np.asarray(featured.select(Summarizer.mean(F.col("v")).alias("m")).first()["m"].toArray())
    shift = (mean @ axes).tolist()
    return vectors.select("id", F.array(*[V.inner_product(F.col("vec"), F.array(*[F.lit(float(w)) for w in axes[:, j]])) - shift[j] for j in range(k)]).alias("x"))


def stratified(rows: DataFrame, by: str, order: list[Column], most: int) -> DataFrame:
    """most rows, in turn one of each kind."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("nth", nth).orderBy("nth", by).limit(most).drop("nth")


def pca_2d(vectors: DataFrame, dim: int) -> DataFrame:
    """(id, x, y): vectors (id, vec) seen along their two main directions, from
    their mean. Of a direction's two senses the one in which its largest
    component (the first of them, if several) is positive. Vectors that are
    null, of another dimension or hold null or non-finite components count for
    nothing and get null; so do all where fewer than two count or dim is
    below 2. What reaches the driver is dim x 2 numbers and the mean."""
    sound = F.coalesce(F.size("vec") == dim, F.lit(False)) & F.forall("vec", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    dense = vectors.where(sound).select(array_to_vector(F.transform("vec", lambda v: v.cast("double"))).alias("v"))
    if dim < 2 or dense.limit(2).count() < 2:
        return vectors.select("id", *(F.lit(None).cast("double").alias(c) for c in ("x", "y")))
    mean = dense.agg(Summarizer.mean(F.col("v"))).first()[0]
    axes = PCA(k=2, inputCol="v", outputCol="p").fit(dense).pc.toArray().T
    centred = F.zip_with("vec", F.lit(mean.toArray().tolist()), lambda v, m: v - m)
    out = []
    for name, axis in zip(("x", "y"), axes, strict=True):
        axis = axis * (1 if axis[abs(axis).argmax()] > 0 else -1)
        along = F.aggregate(F.zip_with(centred, F.lit(axis.tolist()), lambda v, a: v * a), F.lit(0.0), lambda s, x: s + x)
        out.append(F.when(sound, along).alias(name))
    return vectors.select("id", *out)
