"""Keyword search by BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.functions.text import once, tokens
from recallgrid.plans.schema import live
from recallgrid.plans.session import ensure_checkpoint_dir

K1, B = 1.2, 0.75


def postings(docs: DataFrame) -> DataFrame:
    """(id, term, tf, dl) of docs (id, content); texts without tokens have none."""
    listed = docs.select("id", tokens(F.col("content")).alias("ts")).withColumn("dl", F.size("ts"))
    return listed.select("id", "dl", F.explode("ts").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """(n, avg_dl) over the texts that have tokens."""
    lengths = docs.select(F.size(tokens(F.col("content"))).alias("dl")).where("dl > 0")
    return lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avg_dl"))


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, df, cf): texts with the term, and its occurrences."""
    return postings(docs).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def query_terms(spark: SparkSession, query: str) -> list[str]:
    """The different terms of one query."""
    return [r[0] for r in spark.range(1).select(F.explode(F.array_distinct(tokens(F.lit(query)))).alias("term")).collect()]


def _ranked(scored: DataFrame, k: int, hits: DataFrame | None) -> DataFrame:
    if hits is not None:
        scored = scored.join(hits.select("id"), "id", "left_semi")
    return scored.orderBy(F.desc(F.round("score", 9)), F.desc("id")).limit(k)


def _part(n: Column, avg_dl: Column, df: Column, tf: Column, dl: Column) -> Column:
    idf = F.log((n - df + 0.5) / (df + 0.5) + 1)
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avg_dl))


def bm25(docs: DataFrame, query: str, k: int = 10, hits: DataFrame | None = None) -> DataFrame:
    """(id, score), best first, ties to the larger id. hits: ids that count as
    results; statistics are those of all docs. Terms of the query count once.
    The texts are read once: what is left of each, its length and the counts
    of the query's terms, is written to a table, from which statistics and
    scores come."""
    spark = docs.sparkSession
    terms = query_terms(spark, query)
    if not terms:
        return spark.createDataFrame([], "id long, score double")
    ensure_checkpoint_dir(spark)

    def occurrences(ts: Column, word: str) -> Column:
        return F.size(F.filter(ts, lambda t: t == word))

    counts = once(tokens(F.col("content")), lambda ts: F.struct(F.size(ts).alias("dl"), F.array(*[occurrences(ts, w) for w in terms]).alias("tf")))
    listed = docs.select("id", counts.alias("c")).select("id", "c.dl", "c.tf").where("dl > 0").checkpoint()
    df = [F.count_if(F.col("tf")[i] > 0) for i in range(len(terms))]
    stats = listed.agg(F.count("*").alias("n"), F.avg("dl").alias("avg_dl"), F.array(*df).alias("df"))
    # one row of statistics
    weighed = listed.where(F.exists("tf", lambda x: x > 0)).join(F.broadcast(stats))
    score = sum((F.when(F.col("tf")[i] > 0, _part(F.col("n"), F.col("avg_dl"), F.col("df")[i], F.col("tf")[i], F.col("dl"))).otherwise(0.0) for i in range(len(terms))), F.lit(0.0))
    return _ranked(weighed.select("id", score.alias("score")), k, hits)


def build_index(docs: DataFrame, buckets: int = 64) -> tuple[DataFrame, DataFrame]:
    """(postings, statistics) of docs (id, content). postings: bucket (of the
    term's hash), term, id, tf, dl. Written partitioned by bucket, a query
    reads only its terms' buckets."""
    posted = postings(docs).select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"), "term", "id", "tf", "dl")
    return posted.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "term"), corpus_stats(docs).withColumn("buckets", F.lit(buckets))


def search_index(posted: DataFrame, stats: DataFrame, query: str, k: int = 10, hits: DataFrame | None = None) -> DataFrame:
    """bm25() from an index."""
    spark = posted.sparkSession
    terms = query_terms(spark, query)
    known = stats.first()
    if not terms or known is None or not known["n"]:
        return spark.createDataFrame([], "id long, score double")
    asked = spark.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(known["buckets"])).cast("int"))
    found = posted.where(F.col("bucket").isin(*{r[0] for r in asked.collect()}) & F.col("term").isin(*terms)).select("term", "id", "tf", "dl")
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    # one row for each term of the query
    part = _part(F.lit(known["n"]), F.lit(known["avg_dl"]), F.col("df"), F.col("tf"), F.col("dl"))
    return _ranked(found.join(F.broadcast(df), "term").groupBy("id").agg(F.sum(part).alias("score")), k, hits)


def keyword_search(records: DataFrame, query: str, k: int = 10, where=None) -> DataFrame:
    """BM25 over live records; where: a FilterSpec on the results."""
    alive = live(records)
    hits = alive.where(where.column()) if where is not None else None
    return bm25(alive, query, k, hits)
