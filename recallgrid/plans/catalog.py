"""The registered queries over the driver's tables, with their SQL.

Tables stand in for a store: embeddings for records with vectors, events for
records with metadata, documents for texts, conversations for episodes, the
star schema for the graph and the hierarchy. Times are measured from NOW.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallgrid.functions import scoring, temporal, text
from recallgrid.functions import vectors as V
from recallgrid.functions.scoring import Decay
from recallgrid.operators import analytics, consolidate, episodes, extraction, graph, hierarchy, hybrid, keyword, lifecycle, search
from recallgrid.operators.lifecycle import Tables
from recallgrid.plans.filters import FilterSpec
from recallgrid.plans.schema import EDGES, as_records, dead, live
from recallgrid.sources import logs, store
from recallgrid.streaming import triggers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NOW = 1706745600  # 2024-02-01
WORDS = "quement treque ungheit thshing anlyes the quetion"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# -- the tables as a store ------------------------------------------------


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.lit("text").alias("modality"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def vector_records(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("vec_id")
    return as_records(table(spark, d, "embeddings").select(
        i.alias("id"), (F.lit(NOW) - (i * 37 % 90) * 86400).alias("ts"), ((i % 8 + 1) / 8).cast("float").alias("importance"), (i % 4).cast("tinyint").alias("type"), F.concat(F.lit("s"), i % 3).alias("source"),
        F.concat(F.lit("record "), i).alias("content"), (i % 6).alias("recall_count"), F.col("label").cast("string").alias("namespace_id"), F.concat(F.lit("e"), i % 10).alias("entity_id"),
        F.create_map(F.lit("parity"), (i % 2).cast("string")).alias("attributes"), ((i % 4 + 1) / 4).cast("float").alias("confidence"),
    ))


VR = """vr AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, 1706745600 - (vec_id * 37 % 90) * 86400 AS ts, (vec_id % 8 + 1) / 8.0 AS importance, vec_id % 6 AS recall_count,
     CAST(label AS VARCHAR) AS namespace_id, 'e' || (vec_id % 10) AS entity_id, CAST(vec_id % 2 AS VARCHAR) AS parity, 's' || (vec_id % 3) AS source, 'record ' || vec_id AS content, (vec_id % 4 + 1) / 4.0 AS confidence FROM embeddings),
     q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)"""
VD = f"{VR}, vd AS (SELECT vr.*, pow(list_distance(vec, q), 2) AS d FROM vr, q)"


def decay_sql(similarity: str, recalls: str = "recall_count", half: float = 30.0, w: float = 0.3) -> str:
    return f"(({1 - w} * ({similarity}) + {w} * pow(0.5, (greatest(0, 1706745600 - ts) / 86400.0 / (1 + ln(1 + {recalls}))) / {half})) * importance)"


def first_vector(spark: SparkSession, d: str) -> list[float]:
    return list(table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"])


def event_records(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    ts = F.col("ts").cast("timestamp").cast("bigint")
    source = F.when(i % 10 == 0, "_forgotten").when(i % 10 < 5, F.concat(F.lit("web/"), i % 10)).otherwise("mail")
    deleted = F.when(i % 97 == 0, F.create_map(F.lit("_deleted"), F.lit("true"))).otherwise(F.create_map().cast("map<string,string>"))
    return as_records(table(spark, d, "events").select(
        i.alias("id"), ts.alias("ts"), ((i % 8 + 1) / 8).cast("float").alias("importance"), (i % 4).cast("tinyint").alias("type"), source.alias("source"), F.concat(F.lit("event "), i).alias("content"),
        F.concat(F.lit('["t'), i % 3, F.lit('","u'), i % 5, F.lit('"]')).alias("tags_json"), (i % 7 * (i % 23)).alias("recall_count"), F.when(i % 7 * (i % 23) > 0, ts + i % 3 * 86400).otherwise(0).alias("last_recalled_at"),
        F.col("event_type").alias("namespace_id"), F.col("user_id").cast("string").alias("entity_id"), F.map_concat(F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("flag"), F.when(i % 2 == 0, "true").otherwise("false")), deleted).alias("attributes"),
        F.when(i % 4 == 0, i % 40 * 86400).otherwise(0).alias("ttl"), ((i % 4 + 1) / 4).cast("float").alias("confidence"),
    ))


ER = """r AS (SELECT event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, (event_id % 8 + 1) / 8.0 AS importance, event_id % 4 AS type, CASE WHEN event_id % 10 = 0 THEN '_forgotten' WHEN event_id % 10 < 5 THEN 'web/' || (event_id % 10) ELSE 'mail' END AS source,
     'event ' || event_id AS content, '["t' || (event_id % 3) || '","u' || (event_id % 5) || '"]' AS tags_json, event_id % 7 * (event_id % 23) AS recall_count,
     CASE WHEN event_id % 7 * (event_id % 23) > 0 THEN CAST(floor(epoch(ts)) AS BIGINT) + event_id % 3 * 86400 ELSE 0 END AS last_recalled_at, event_type AS namespace_id, CAST(user_id AS VARCHAR) AS entity_id,
     json_extract_string(props, '$.k') AS k, CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS flag, event_id % 97 = 0 AS deleted, CASE WHEN event_id % 4 = 0 THEN event_id % 40 * 86400 ELSE 0 END AS ttl, (event_id % 4 + 1) / 4.0 AS confidence FROM events),
     l AS (SELECT * FROM r WHERE source <> '_forgotten' AND NOT deleted)"""


def doc_records(spark: SparkSession, d: str) -> DataFrame:
    return as_records(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("lang").alias("namespace_id"), "source"))


def order_edges(spark: SparkSession, d: str) -> DataFrame:
    """customer -> order, and customer -> nation, ids kept apart by range."""
    placed = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + 10_000_000).alias("dst"), F.lit("placed").alias("rel_type"), F.lit(1.0).cast("float").alias("weight"))
    lives = table(spark, d, "customer").select(F.col("c_custkey").alias("src"), (F.col("c_nationkey") + 20_000_000).cast("bigint").alias("dst"), F.lit("lives_in").alias("rel_type"), F.lit(0.5).cast("float").alias("weight"))
    return placed.unionByName(lives)


OE = """e AS (SELECT o_custkey AS src, o_orderkey + 10000000 AS dst, 'placed' AS rel_type, 1.0 AS weight FROM orders UNION ALL SELECT c_custkey, CAST(c_nationkey + 20000000 AS BIGINT), 'lives_in', 0.5 FROM customer)"""


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), places) for c in columns})


# -- search ----------------------------------------------------------------


@query(f"WITH {VD} SELECT id, round(d, 6) AS distance, round(1 / (1 + d), 6) AS similarity FROM vd ORDER BY d, id LIMIT 10")
def knn_l2(spark, d):
    return rounded(search.search(vectors(spark, d), first_vector(spark, d), 10), "distance", "similarity")


@query(f"WITH {VR} SELECT id, round(1 - list_inner_product(vec, q) / (sqrt(list_inner_product(vec, vec)) * sqrt(list_inner_product(q, q)) + 1e-9), 6) AS distance FROM vr, q ORDER BY 1 - list_inner_product(vec, q) / (sqrt(list_inner_product(vec, vec)) * sqrt(list_inner_product(q, q)) + 1e-9), id LIMIT 10")
def knn_cosine(spark, d):
    return rounded(search.search(vectors(spark, d), first_vector(spark, d), 10, "cosine"), "distance").drop("similarity")


@query(f"WITH {VR} SELECT id, round(1 - list_inner_product(vec, q), 6) AS distance FROM vr, q ORDER BY 1 - list_inner_product(vec, q), id LIMIT 10")
def knn_inner_product(spark, d):
    return rounded(search.search(vectors(spark, d), first_vector(spark, d), 10, "ip"), "distance").drop("similarity")


@query(f"WITH {VD} SELECT id, round(d, 6) AS distance, round(1 / (1 + d), 6) AS similarity, round(1 / (1 + d), 6) AS score FROM vd WHERE namespace_id = '3' AND parity = '1' AND importance >= 0.25 ORDER BY d, id LIMIT 10")
def knn_filtered(spark, d):
    where = FilterSpec().namespace("3").attribute("parity", "1").min_importance(0.25)
    return rounded(search.search_records(vector_records(spark, d), vectors(spark, d), first_vector(spark, d), NOW, 10, where), "distance", "similarity", "score")


@query(f"WITH {VD}, c AS (SELECT * FROM vd ORDER BY d, id LIMIT 30) SELECT id, round(d, 6) AS distance, round(1 / (1 + d), 6) AS similarity, round({decay_sql('1 / (1 + d)')}, 6) AS score FROM c ORDER BY {decay_sql('1 / (1 + d)')} DESC, id LIMIT 10")
def knn_decay(spark, d):
    return rounded(search.search_records(vector_records(spark, d), vectors(spark, d), first_vector(spark, d), NOW, 10, decay=Decay()), "distance", "similarity", "score")


@query(f"WITH {VD} SELECT id, round(d, 6) AS distance, round(1 / (1 + d), 6) AS similarity, round({decay_sql('1 / (1 + d)', 'recall_count + 1', 7.0, 0.4)}, 6) AS score FROM vd WHERE entity_id = 'e4' ORDER BY {decay_sql('1 / (1 + d)', 'recall_count + 1', 7.0, 0.4)} DESC, id LIMIT 10")
def knn_decay_filtered(spark, d):
    return rounded(search.search_records(vector_records(spark, d), vectors(spark, d), first_vector(spark, d), NOW, 10, FilterSpec().entity("e4"), Decay(7.0, 0.4), counted=True), "distance", "similarity", "score")


BATCH_SQL = "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, pow(list_distance(a.e, b.e), 2) AS d FROM v a, v b WHERE a.vec_id % 10 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM p) SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(d, 6) AS distance FROM n WHERE rank <= 10"


@query(BATCH_SQL)
def knn_batch(spark, d):
    v = vectors(spark, d)
    asked = v.where("id % 10 = 0").select(F.col("id").alias("query_id"), "vec")
    return rounded(search.search_batch(v, asked, 10), "distance")


@query(f"WITH {VR} SELECT id, round(1 / (1 + list_distance(vec, q)), 6) AS similarity, round(1 + ln(1 + recall_count), 6) AS stickiness, round((1706745600 - ts) / 86400.0, 2) AS age_days, round(pow(0.5, ((1706745600 - ts) / 86400.0 / (1 + ln(1 + recall_count))) / 30), 6) AS recency, CAST(importance AS DOUBLE) AS importance, CAST(confidence AS DOUBLE) AS confidence, round({decay_sql('1 / (1 + list_distance(vec, q))')}, 6) AS score FROM vr, q WHERE id = 5")
def explain_score(spark, d):
    return search.explain(vector_records(spark, d), vectors(spark, d), 5, first_vector(spark, d), NOW)


@query()
def mmr_select(spark, d):
    found = search.search(vectors(spark, d), first_vector(spark, d), 50).select("id", F.col("similarity").alias("score"))
    return rounded(search.search_diverse(found.join(vectors(spark, d).select("id", "vec"), "id"), 10), "score")


@query("WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), c AS (SELECT id AS cell, e AS c FROM v ORDER BY id LIMIT 16), q AS (SELECT e AS q FROM v WHERE id = 0), near AS (SELECT id, e, arg_min(cell, (pow(list_distance(e, c), 2), cell)) AS cell FROM v, c GROUP BY id, e), probed AS (SELECT cell FROM c, q ORDER BY pow(list_distance(c, q), 2), cell LIMIT 8) SELECT id, round(pow(list_distance(e, q), 2), 6) AS distance, round(1 / (1 + pow(list_distance(e, q), 2)), 6) AS similarity FROM near, q WHERE cell IN (SELECT cell FROM probed) ORDER BY pow(list_distance(e, q), 2), id LIMIT 10")
def knn_ivf(spark, d):
    """Cells around the first 16 vectors, so that SQL can have the same; build_ivf() fits them else."""
    v = vectors(spark, d)
    centres = [[float(x) for x in r["vec"]] for r in v.orderBy("id").limit(16).collect()]
    placed, centres = search.build_ivf(v, centres=centres)
    return rounded(search.search_ivf(placed, centres, first_vector(spark, d), 10, 8), "distance", "similarity")


@query("SELECT vec_id AS id, round(CASE WHEN m > 0 THEN m / 127 ELSE 1 END, 9) AS scale, round(list_max(list_transform(list_zip(e, list_transform(e, lambda x: sign(x) * floor(abs(x / (m / 127)) + 0.5) * (m / 127))), lambda p: abs(p[1] - p[2]))), 9) AS error FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, list_max(list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x))) AS m FROM embeddings)")
def int8_round_trip(spark, d):
    v = vectors(spark, d).select("id", "vec", V.own_scale(F.col("vec")).alias("scale"))
    back = v.withColumn("back", V.dequantized(V.quantized(F.col("vec"), F.col("scale")), F.col("scale")))
    error = F.array_max(F.zip_with(F.col("vec").cast("array<double>"), "back", lambda x, y: F.abs(x - y)))
    return back.select("id", F.round("scale", 9).alias("scale"), F.round(error, 9).alias("error"))


@query("WITH v AS (SELECT vec_id AS id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: greatest(least(sign(x) * floor(abs(x * 127) + 0.5), 127), -127)) AS z FROM embeddings), q AS (SELECT z AS q FROM v WHERE id = 0) SELECT id, round(list_sum(list_transform(list_zip(z, q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / 16129, 6) AS distance FROM v, q ORDER BY list_sum(list_transform(list_zip(z, q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), id LIMIT 10")
def int8_knn(spark, d):
    one = F.lit(1.0 / 127)
    q = V.quantized(search.query_vector(first_vector(spark, d)), one)
    found = vectors(spark, d).select("id", V.int8_squared_l2(V.quantized(F.col("vec"), one), q, one).alias("distance"))
    return rounded(found.orderBy("distance", "id").limit(10), "distance")


# -- keyword and hybrid ----------------------------------------------------

STOPS = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
TOKENS = f"tok AS (SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+'), lambda w: len(w) >= 2 AND w NOT IN ({STOPS})) AS ts, lang FROM documents), dl AS (SELECT doc_id, lang, len(ts) AS dl FROM tok WHERE len(ts) > 0), post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM tok) GROUP BY ALL)"
ASKED = f"asked AS (SELECT DISTINCT term FROM (SELECT unnest(list_filter(regexp_extract_all(translate('{WORDS}', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+'), lambda w: len(w) >= 2 AND w NOT IN ({STOPS}))) AS term))"
BM25 = f"{TOKENS}, {ASKED}, st AS (SELECT count(*) AS n, avg(dl) AS av FROM dl), df AS (SELECT term, count(*) AS df FROM post JOIN asked USING (term) GROUP BY term), bm AS (SELECT post.doc_id AS id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))) AS score FROM post JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY post.doc_id)"


@query(f"WITH {TOKENS} SELECT doc_id AS id, CAST(coalesce(dl, 0) AS BIGINT) AS n_tokens, CAST(list_unique(ts) AS BIGINT) AS n_terms FROM tok LEFT JOIN dl USING (doc_id)")
def tokenize(spark, d):
    ts = text.tokens(F.col("content"))
    return doc_records(spark, d).select("id", F.size(ts).cast("long").alias("n_tokens"), F.size(F.array_distinct(ts)).cast("long").alias("n_terms"))


@query(f"WITH {TOKENS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY term")
def term_df(spark, d):
    return keyword.term_counts(doc_records(spark, d))


@query(f"WITH {TOKENS} SELECT count(*) AS n, round(avg(dl), 6) AS avg_dl FROM dl")
def bm25_statistics(spark, d):
    return rounded(keyword.corpus_stats(doc_records(spark, d)), "avg_dl")


@query(f"WITH {BM25} SELECT id, round(score, 6) AS score FROM bm ORDER BY round(score, 9) DESC, id DESC LIMIT 20")
def bm25_topk(spark, d):
    return rounded(keyword.keyword_search(doc_records(spark, d), WORDS, 20), "score")


@query(f"WITH {BM25} SELECT id, round(score, 6) AS score FROM bm JOIN documents ON id = doc_id WHERE lang = 'fr' ORDER BY round(score, 9) DESC, id DESC LIMIT 20")
def bm25_filtered(spark, d):
    return rounded(keyword.keyword_search(doc_records(spark, d), WORDS, 20, FilterSpec().namespace("fr")), "score")


@query(f"WITH {BM25} SELECT id, round(score, 6) AS score FROM bm ORDER BY round(score, 9) DESC, id DESC LIMIT 20")
def bm25_indexed(spark, d):
    posted, stats = keyword.build_index(live(doc_records(spark, d)))
    return rounded(keyword.search_index(posted, stats, WORDS, 20), "score")


def _rrf_sql(k: int) -> str:
    return f"WITH {VD}, {BM25}, a AS (SELECT id, row_number() OVER (ORDER BY 1 / (1 + d) DESC, id) AS place FROM (SELECT id, d FROM vd ORDER BY d, id LIMIT 30)), b AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id DESC) AS place FROM (SELECT * FROM bm ORDER BY round(score, 9) DESC, id DESC LIMIT 30)) SELECT id, round(sum(1.0 / ({k} + place)), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id ORDER BY round(sum(1.0 / ({k} + place)), 12) DESC, id DESC LIMIT 10"


def _both(spark, d):
    """Records that have a vector of the embeddings or a text of the documents."""
    texts = doc_records(spark, d).select("id", "content")
    known = vector_records(spark, d).drop("content").join(texts, "id", "full_outer")
    return as_records(known.withColumn("source", F.coalesce("source", F.lit("d"))))


@query(_rrf_sql(60))
def rrf_hybrid(spark, d):
    return rounded(hybrid.hybrid_search(_both(spark, d), vectors(spark, d), first_vector(spark, d), WORDS, NOW, 10), "score")


@query(_rrf_sql(5))
def rrf_small_k(spark, d):
    return rounded(hybrid.hybrid_search(_both(spark, d), vectors(spark, d), first_vector(spark, d), WORDS, NOW, 10, rrf_k=5), "score")


# -- filters, one each -----------------------------------------------------


def _filter_query(name: str, spec: FilterSpec, condition: str) -> None:
    def run(spark, d):
        return live(event_records(spark, d)).where(spec.column()).select("id")

    run.__name__ = f"filter_{name}"
    query(f"WITH {ER} SELECT id FROM l WHERE {condition}")(run)


for _name, _spec, _condition in (
    ("types", FilterSpec().types(0, 2), "type IN (0, 2)"),
    ("source", FilterSpec().source("mail"), "source = 'mail'"),
    ("source_prefix", FilterSpec().source_prefix("web/"), "starts_with(source, 'web/')"),
    ("after", FilterSpec().after(NOW - 10 * 86400), f"ts >= {NOW - 10 * 86400}"),
    ("before", FilterSpec().before(NOW - 20 * 86400), f"ts <= {NOW - 20 * 86400}"),
    ("importance", FilterSpec().min_importance(0.75), "importance >= 0.75"),
    ("tags", FilterSpec().contains_tags("t1", "u2"), "contains(tags_json, 't1') AND contains(tags_json, 'u2')"),
    ("namespace", FilterSpec().namespace("click"), "namespace_id = 'click'"),
    ("entity", FilterSpec().entity("7"), "entity_id = '7'"),
    ("attribute", FilterSpec().attribute("k", "5").attribute("flag", "true"), "k = '5' AND flag = 'true'"),
    ("combined", FilterSpec().types(1).source_prefix("web").min_importance(0.25).after(NOW - 15 * 86400), f"type = 1 AND starts_with(source, 'web') AND importance >= 0.25 AND ts >= {NOW - 15 * 86400}"),
):
    _filter_query(_name, _spec, _condition)


@query("SELECT page_id, url FROM pages WHERE starts_with(url, 'https://blog.')")
def filter_pages_prefix(spark, d):
    return table(spark, d, "pages").where(F.col("url").startswith("https://blog.")).select("page_id", "url")


@query(f"WITH {ER} SELECT count_if(source = '_forgotten' OR deleted) AS dead, count_if(NOT (source = '_forgotten' OR deleted)) AS alive FROM r")
def liveness(spark, d):
    return event_records(spark, d).agg(F.count_if(dead()).alias("dead"), F.count_if(~dead()).alias("alive"))


@query(f"WITH {ER} SELECT id, ts, namespace_id FROM r WHERE id = 1234")
def id_lookup(spark, d):
    return store.get(event_records(spark, d), 1234).select("id", "ts", "namespace_id")


@query(f"WITH {ER} SELECT id, content FROM l WHERE id > 500 ORDER BY id LIMIT 50")
def cursor_page(spark, d):
    return store.scan(event_records(spark, d), 500, 50).select("id", "content")


@query(f"WITH {ER} SELECT namespace_id, count(*) AS n FROM l GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def namespace_sizes(spark, d):
    return analytics.namespace_sizes(event_records(spark, d))


@query(f"WITH {ER} SELECT DISTINCT namespace_id FROM l")
def list_namespaces(spark, d):
    return analytics.list_namespaces(event_records(spark, d))


@query("SELECT 'text' AS modality, count(*) AS n, CAST(max(len(embedding)) AS INTEGER) AS dim FROM embeddings")
def vector_sizes(spark, d):
    return store.sizes(vectors(spark, d))


@query(f"WITH {ER}, s AS (SELECT namespace_id AS store, count(*) AS n FROM l GROUP BY 1) SELECT store, n, (SELECT CAST(sum(n) AS BIGINT) FROM s) AS total FROM s ORDER BY n DESC, store LIMIT 10")
def store_overview(spark, d):
    return analytics.overview(live(event_records(spark, d)).select(F.col("namespace_id").alias("store"), "id"))


# -- graph -----------------------------------------------------------------


@query(f"WITH {OE} SELECT src, dst, rel_type, CAST(weight AS FLOAT) AS weight FROM e WHERE src = 7 OR dst = 20000003")
def edges_out_in(spark, d):
    e = order_edges(spark, d)
    return graph.out_edges(e, 7).unionByName(graph.in_edges(e, 20_000_003)).distinct()


@query(f"WITH {OE} SELECT dst AS id, count(*) AS n_in FROM e GROUP BY dst")
def incoming_index(spark, d):
    return graph.degree(order_edges(spark, d)).where("n_in > 0").select("id", "n_in")


@query(f"WITH {OE} SELECT dst AS other, rel_type, 'out' AS way FROM e WHERE src = 11 AND rel_type = 'placed'")
def related_nodes(spark, d):
    e = order_edges(spark, d)
    ids = e.select(F.col("dst").alias("id"), F.lit("").alias("content")).distinct()
    return graph.related(e, ids, 11, "out", "placed").select("other", "rel_type", "way")


HOPS = f"{OE}, st AS (SELECT DISTINCT a, b FROM (SELECT src AS a, dst AS b FROM e UNION ALL SELECT dst, src FROM e)), h0 AS (SELECT 3 AS id UNION SELECT 8), h1 AS (SELECT DISTINCT b AS id FROM st JOIN h0 ON a = id WHERE b NOT IN (SELECT id FROM h0)), h2 AS (SELECT DISTINCT b AS id FROM st JOIN h1 ON a = id WHERE b NOT IN (SELECT id FROM h0) AND b NOT IN (SELECT id FROM h1)), h AS (SELECT id, 0 AS hop FROM h0 UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2)"


@query(f"WITH {HOPS} SELECT CAST(id AS BIGINT) AS id, hop FROM h")
def chain_hops(spark, d):
    return graph.hops(order_edges(spark, d), spark.createDataFrame([(3,), (8,)], "id long"), 2)


@query(f"WITH {HOPS} SELECT CAST(id AS BIGINT) AS id, hop, CASE WHEN hop = 0 THEN CASE id WHEN 3 THEN 0.9 ELSE 0.5 END ELSE 0 END AS similarity, round((CASE WHEN hop = 0 THEN CASE id WHEN 3 THEN 0.9 ELSE 0.5 END ELSE 1.0 / (1 + hop) END) * CASE WHEN c_custkey IS NULL THEN 1 ELSE (c_custkey % 8 + 1) / 8.0 * (1 + ln(1 + c_custkey % 6)) END, 6) AS score FROM h LEFT JOIN customer ON id = c_custkey")
def chain_scored(spark, d):
    i = F.col("c_custkey")
    people = as_records(table(spark, d, "customer").select(i.alias("id"), ((i % 8 + 1) / 8).cast("float").alias("importance"), (i % 6).alias("recall_count")))
    seeds = spark.createDataFrame([(3, 0.9), (8, 0.5)], "id long, similarity double")
    return rounded(graph.context_chain(people, order_edges(spark, d), seeds, 2)[0], "score")


@query(f"WITH {HOPS} SELECT DISTINCT src, dst, rel_type FROM e WHERE src IN (SELECT id FROM h WHERE hop < 2) OR dst IN (SELECT id FROM h WHERE hop < 2)")
def chain_edges(spark, d):
    seeds = spark.createDataFrame([(3, 0.9), (8, 0.5)], "id long, similarity double")
    people = as_records(table(spark, d, "customer").select(F.col("c_custkey").alias("id")))
    return graph.context_chain(people, order_edges(spark, d), seeds, 2)[1].select("src", "dst", "rel_type")


@query(f"WITH {VR}, p AS (SELECT a.id AS src, b.id AS dst, pow(list_distance(a.vec, b.vec), 2) AS d FROM vr a JOIN vr b ON a.id <> b.id), n AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS nth FROM p) SELECT src, dst, 'related_to' AS rel_type, round(1 / (1 + d), 6) AS weight FROM n WHERE nth <= 15 AND 1 / (1 + d) >= 0.5")
def auto_link_sim(spark, d):
    none = spark.createDataFrame([], EDGES)
    return rounded(graph.auto_link(vector_records(spark, d), vectors(spark, d), none, 0.5), "weight")


@query(f"WITH {ER}, n AS (SELECT id, content AS label FROM l WHERE namespace_id = 'click') SELECT a.id AS src, b.id AS dst, 'next' AS rel_type FROM n a JOIN n b ON b.id = a.id + 1")
def export_graph(spark, d):
    r = event_records(spark, d)
    chain = r.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit("next").alias("rel_type"), F.lit(1.0).cast("float").alias("weight"))
    return graph.export_edges(chain, graph.export_nodes(r, "click")).select("src", "dst", "rel_type")


@query(f"WITH {ER} SELECT id, content AS label, namespace_id, entity_id FROM l WHERE namespace_id = 'click' AND entity_id = '5'")
def export_nodes(spark, d):
    return graph.export_nodes(event_records(spark, d), "click", "5")


@query(f"WITH {ER}, c AS (SELECT id AS src, id + 1 AS dst FROM r) SELECT src, dst FROM c WHERE src NOT IN (SELECT id FROM l) OR dst IN (SELECT id FROM l)")
def prune_dead_edges(spark, d):
    r = event_records(spark, d)
    chain = r.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit("next").alias("rel_type"), F.lit(1.0).cast("float").alias("weight"))
    return graph.prune_dead(chain, r).select("src", "dst")


@query(f"WITH {OE}, new AS (SELECT o_custkey AS src, l_orderkey + 10000000 AS dst, 'placed' AS rel_type FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT o_custkey, o_orderkey + 10000000, 'paid' FROM orders) SELECT rel_type, count(*) AS n FROM (SELECT src, dst, rel_type FROM e UNION SELECT src, dst, rel_type FROM new WHERE src IN (SELECT c_custkey FROM customer)) GROUP BY 1")
def link_once(spark, d):
    items = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    new = items.select(F.col("o_custkey").alias("src"), (F.col("l_orderkey") + 10_000_000).alias("dst"), F.lit("placed").alias("rel_type"), F.lit(1.0).cast("float").alias("weight"))
    new = new.unionByName(table(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + 10_000_000).alias("dst"), F.lit("paid").alias("rel_type"), F.lit(1.0).cast("float").alias("weight")))
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return graph.link(order_edges(spark, d), new, people).groupBy("rel_type").agg(F.count("*").alias("n"))


# -- hierarchy and episodes ------------------------------------------------


def _places(spark, d):
    """region > nation > customer."""
    regions = table(spark, d, "region").select((F.col("r_regionkey") + 1_000_000_000).cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.lit("brand").alias("level"))
    nations = table(spark, d, "nation").select((F.col("n_nationkey") + 500_000_000).cast("long").alias("id"), (F.col("n_regionkey") + 1_000_000_000).cast("long").alias("parent_id"), F.lit("channel").alias("level"))
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") + 500_000_000).cast("long").alias("parent_id"), F.lit("campaign").alias("level"))
    return regions.unionByName(nations).unionByName(people)


PLACES = "t AS (SELECT CAST(r_regionkey + 1000000000 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent_id FROM region UNION ALL SELECT n_nationkey + 500000000, n_regionkey + 1000000000 FROM nation UNION ALL SELECT c_custkey, c_nationkey + 500000000 FROM customer), a AS (SELECT id, parent_id AS ancestor, 1 AS steps FROM t WHERE parent_id IS NOT NULL UNION ALL SELECT a.id, t.parent_id, steps + 1 FROM a JOIN t ON t.id = ancestor WHERE t.parent_id IS NOT NULL)"


@query(f"WITH RECURSIVE {PLACES} SELECT id, ancestor, steps FROM a")
def hierarchy_ancestors(spark, d):
    return hierarchy.ancestors(_places(spark, d))


@query(f"WITH RECURSIVE {PLACES} SELECT id, steps FROM a WHERE ancestor = 1000000001")
def hierarchy_descendants(spark, d):
    return hierarchy.descendants(_places(spark, d), 1_000_000_001)


@query("SELECT a.c_custkey AS a, b.c_custkey AS b, CAST(CASE WHEN a.c_nationkey = b.c_nationkey THEN a.c_nationkey + 500000000 WHEN n.n_regionkey = m.n_regionkey THEN n.n_regionkey + 1000000000 END AS BIGINT) AS lca FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 JOIN nation n ON n.n_nationkey = a.c_nationkey JOIN nation m ON m.n_nationkey = b.c_nationkey")
def hierarchy_lca(spark, d):
    people = table(spark, d, "customer").select("c_custkey")
    pairs = people.select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b")).join(people.select(F.col("c_custkey").alias("b")), "b", "left_semi").select("a", "b")
    return hierarchy.lowest_common(_places(spark, d), pairs)


@query("WITH c AS (SELECT r_name, n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT r_name AS path, 1 AS depth, count(*) AS n FROM c GROUP BY 1 UNION ALL SELECT r_name || '/' || n_name, 2, count(*) FROM c GROUP BY 1 UNION ALL SELECT r_name || '/' || n_name || '/' || c_mktsegment, 3, count(*) FROM c GROUP BY 1")
def hierarchy_rollup(spark, d):
    people = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = people.select(F.col("c_custkey").alias("id"), F.col("r_name").alias("namespace_id"), F.create_map(F.lit("brand"), F.lit(""), F.lit("channel"), F.col("n_name"), F.lit("campaign"), F.col("c_mktsegment")).alias("attributes"))
    return analytics.roll_up(as_records(rows))


def _episodes(spark, d):
    said = table(spark, d, "conversations").select(F.concat(F.lit("c"), F.col("conv_id")).alias("episode_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), (F.col("conv_id") * 5000 + F.col("turn") * 60).alias("ts")).distinct()
    return episodes.member_edges(said.select("episode_id", "id")), as_records(said.select("id", "ts"))


EP = "s AS (SELECT DISTINCT 'c' || conv_id AS ep, conv_id * 1000 + turn AS id, conv_id * 5000 + turn * 60 AS ts FROM conversations), x AS (SELECT *, sha256('__ep__' || ep) AS h FROM s), m AS (SELECT CAST(('0x' || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2)) AS BIGINT) % 1125899906842624 AS episode, id, ts FROM x)"


@query(f"WITH {EP} SELECT episode, CAST(row_number() OVER (PARTITION BY episode ORDER BY ts, id) AS INTEGER) AS place, id, ts FROM m")
def episodes_timeline(spark, d):
    return episodes.timeline(*_episodes(spark, d))


@query(f"WITH {EP} SELECT episode, min(ts) AS started, max(ts) AS ended, count(*) AS members FROM m GROUP BY episode")
def episode_bounds(spark, d):
    return episodes.bounds(*_episodes(spark, d))


# -- lifecycle -------------------------------------------------------------


@query("SELECT user_id AS id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def upsert_last_wins(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), "event_id", "value")
    old, new = (lifecycle.last_wins(e.where(F.col("event_id") % 2 == p), ["id"], F.col("event_id")) for p in (0, 1))
    both = lifecycle.last_wins(lifecycle.upsert(old, new, ["id"]).unionByName(old), ["id"], F.col("event_id"))
    return both.select("id", "event_id", "value")


@query(f"WITH {ER} SELECT id, CASE WHEN id % 3 = 0 THEN '' ELSE content END AS content, CASE WHEN id % 3 = 0 THEN '_forgotten' ELSE source END AS source, CASE WHEN id % 3 = 0 THEN 0 ELSE CAST(importance AS DOUBLE) END AS importance, CAST(CASE WHEN id % 3 = 0 THEN 0 ELSE ttl END AS BIGINT) AS ttl FROM r")
def soft_delete(spark, d):
    r = event_records(spark, d)
    return rounded(lifecycle.forget(r, r.where("id % 3 = 0").select("id")), "importance").select("id", "content", "source", "importance", "ttl")


def _event_tables(spark, d) -> Tables:
    r = event_records(spark, d)
    v = r.select(F.lit("text").alias("modality"), "id", F.array(F.lit(1.0).cast("float")).alias("vec"))
    chain = r.select(F.col("id").alias("src"), (F.col("id") * 7 % 10000).alias("dst"), F.lit("next").alias("rel_type"), F.lit(1.0).cast("float").alias("weight"))
    return Tables(r, v, chain)


@query(f"WITH {ER}, p AS (SELECT * FROM r WHERE namespace_id <> 'click'), c AS (SELECT id AS src, id * 7 % 10000 AS dst FROM r) SELECT (SELECT count(*) FROM p) AS records, (SELECT count(*) FROM p) AS vectors, (SELECT count(*) FROM c WHERE src NOT IN (SELECT id FROM r WHERE namespace_id = 'click') AND dst NOT IN (SELECT id FROM r WHERE namespace_id = 'click')) AS edges")
def purge_anti(spark, d):
    out = lifecycle.purge(_event_tables(spark, d), "click")
    return out.records.agg(F.count("*").alias("records")).join(out.vectors.agg(F.count("*").alias("vectors"))).join(out.edges.agg(F.count("*").alias("edges")))


@query(f"WITH {ER} SELECT id FROM l WHERE ttl > 0 AND 1706745600 > ts + ttl")
def ttl_expiry(spark, d):
    r = event_records(spark, d)
    gone = lifecycle.forget_expired(r, NOW).where(F.col("source") == "_forgotten").select("id")
    return gone.join(r.where(~dead()).select("id"), "id", "left_semi")


@query(f"WITH {ER} SELECT namespace_id, count(*) AS n FROM l GROUP BY 1")
def compact_live(spark, d):
    return lifecycle.compact(_event_tables(spark, d)).records.groupBy("namespace_id").agg(F.count("*").alias("n"))


@query(f"WITH {ER}, t AS (SELECT user_id AS id, count(*) AS n, CAST(floor(epoch(max(ts))) AS BIGINT) AS last FROM events GROUP BY 1) SELECT r.id, recall_count + coalesce(n, 0) AS recall_count, greatest(last_recalled_at, coalesce(last, 0)) AS last_recalled_at FROM r LEFT JOIN t ON t.id = r.id")
def touch_fold(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").cast("bigint").alias("ts"))
    return lifecycle.fold_touches(event_records(spark, d), log).select("id", "recall_count", "last_recalled_at")


def _merge_sides(spark, d):
    r = event_records(spark, d)
    target = r.where("id % 3 <> 0").withColumn("source", F.lit("target"))
    source = r.where("id % 3 <> 1").withColumns({"source": F.lit("source"), "importance": (F.col("importance") / 2 + 0.25).cast("float"), "attributes": F.create_map(F.lit("k"), F.lit("new"), F.lit("more"), F.lit("1"))})
    return target, source


def _merge_query(policy: str, sql: str) -> None:
    def run(spark, d):
        out = lifecycle.merge_records(*_merge_sides(spark, d), policy)
        return rounded(out, "importance").select("id", "source", "importance", lifecycle.get_attribute("k").alias("k"), lifecycle.get_attribute("flag").alias("flag"), lifecycle.get_attribute("more").alias("more"))

    run.__name__ = f"merge_{policy}"
    query(sql)(run)


_SIDES = f"{ER}, s AS (SELECT id, id % 3 <> 0 AS t, id % 3 <> 1 AS s, CAST(importance AS DOUBLE) AS ti, CAST(importance AS DOUBLE) / 2 + 0.25 AS si, coalesce(k, '') AS k, flag FROM r)"
_merge_query("keep_target", f"WITH {_SIDES} SELECT id, CASE WHEN t THEN 'target' ELSE 'source' END AS source, CASE WHEN t THEN ti ELSE si END AS importance, CASE WHEN t THEN k ELSE 'new' END AS k, CASE WHEN t THEN flag ELSE '' END AS flag, CASE WHEN t THEN '' ELSE '1' END AS more FROM s")
_merge_query("keep_source", f"WITH {_SIDES} SELECT id, CASE WHEN s THEN 'source' ELSE 'target' END AS source, CASE WHEN s THEN si ELSE ti END AS importance, CASE WHEN s THEN 'new' ELSE k END AS k, CASE WHEN s THEN '' ELSE flag END AS flag, CASE WHEN s THEN '1' ELSE '' END AS more FROM s")
_merge_query("merge", f"WITH {_SIDES} SELECT id, CASE WHEN t THEN 'target' ELSE 'source' END AS source, CASE WHEN s AND t THEN greatest(ti, si) WHEN s THEN si ELSE ti END AS importance, CASE WHEN s THEN 'new' ELSE k END AS k, CASE WHEN t THEN flag ELSE '' END AS flag, CASE WHEN s THEN '1' ELSE '' END AS more FROM s")


def _merge_stores(spark, d) -> tuple[Tables, Tables]:
    """Two stores of events that share some ids and edges."""
    r, i = event_records(spark, d), F.col("id")
    tables = []
    for kept, step, weight in ((i % 3 != 0, 1.0, 0.5), (i % 2 == 0, 2.0, 0.75)):
        own = r.where(kept)
        edges = own.select(i.alias("src"), F.explode(F.array(i * 7 % 10_000, i * (3 if weight == 0.5 else 5) % 20_000)).alias("dst"), F.lit("next").alias("rel_type"), F.lit(weight).cast("float").alias("weight")).distinct()
        tables.append(Tables(own, own.select(F.lit("text").alias("modality"), "id", F.array(F.lit(step).cast("float")).alias("vec")), edges))
    return tables[0], tables[1]


MS = f"""{ER}, t AS (SELECT id FROM r WHERE id % 3 <> 0), s AS (SELECT id FROM r WHERE id % 2 = 0), te AS (SELECT id AS src, id * 7 % 10000 AS dst FROM t UNION SELECT id, id * 3 % 20000 FROM t),
     se AS (SELECT id AS src, id * 7 % 10000 AS dst FROM s UNION SELECT id, id * 5 % 20000 FROM s)"""


@query(f"WITH {MS} SELECT id, CASE WHEN id IN (SELECT id FROM t) THEN 1.0 ELSE 2.0 END AS x, CASE WHEN id IN (SELECT id FROM s) THEN 2.0 ELSE 1.0 END AS source_x FROM (SELECT id FROM t UNION SELECT id FROM s)")
def merge_vectors(spark, d):
    """Under the policies merge and keep_source."""
    target, source = _merge_stores(spark, d)
    both = [lifecycle.merge(target, source, p).vectors.select("id", F.col("vec")[0].cast("double").alias(c)) for p, c in (("merge", "x"), ("keep_source", "source_x"))]
    return both[0].join(both[1], "id", "full_outer")


@query(f"WITH {MS}, added AS (SELECT src, dst FROM se WHERE src NOT IN (SELECT id FROM t) OR dst IN (SELECT id FROM t UNION SELECT id FROM s)) SELECT src, dst, 0.5 AS weight FROM te UNION ALL SELECT src, dst, 0.75 FROM (SELECT * FROM added EXCEPT SELECT * FROM te)")
def merge_edges(spark, d):
    target, source = _merge_stores(spark, d)
    return rounded(lifecycle.merge(target, source, "merge").edges.drop("rel_type"), "weight")


@query("SELECT CAST(l_orderkey AS BIGINT) AS src, CAST(l_suppkey AS BIGINT) AS dst, round(arg_min(l_quantity, (l_linenumber * 1000000 + l_partkey) * 100 + l_quantity), 6) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey % 10 <> 0 GROUP BY 1, 2 UNION ALL SELECT o_orderkey, s_suppkey, 1.0 FROM orders JOIN supplier ON s_suppkey = o_orderkey % 10 * 10")
def link_first(spark, d):
    """Of links alike the first line of an order stays, and those that are there stay."""
    items, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("dst"))
    there = orders.select(F.col("o_orderkey").alias("src"), (F.col("o_orderkey") % 10 * 10).alias("dst"), F.lit("from").alias("rel_type"), F.lit(1.0).cast("float").alias("weight")).join(suppliers, "dst", "left_semi").select("src", "dst", "rel_type", "weight")
    new = items.where("l_suppkey % 10 <> 0").select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"), F.lit("from").alias("rel_type"), F.col("l_quantity").cast("float").alias("weight"), ((F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")) * 100 + F.col("l_quantity")).alias("line"))
    return rounded(graph.link(there, new, orders.select(F.col("o_orderkey").alias("id")), "line").select("src", "dst", "weight"), "weight")


@query(f"WITH {ER}, e AS (SELECT id AS src, id + 1 AS dst, 1.0 AS weight FROM l WHERE id % 5 NOT IN (2, 3) UNION ALL SELECT id, id + 9, 0.25 FROM l WHERE id % 5 = 2 UNION ALL SELECT id, id + 4, 0.5 FROM l WHERE id % 5 IN (1, 2)) SELECT * FROM e")
def replay_edges(spark, d):
    """Records with an edge to the next; UPDATE gives every fifth another edge
    and another fifth none; links come before and after it."""
    r, i = live(event_records(spark, d)), F.col("id")
    record = F.struct(*[c for c in r.columns if c != "id"])
    kind = "array<struct<dst:bigint,rel_type:string,weight:float>>"

    def ops(rows, seq: int, op: str, edges=None, dst=None, weight: float = 0.5):
        full = op in ("ADD", "UPDATE")
        return rows.select(
            (i * 10 + seq).alias("seq"), F.lit(op).alias("op"), "id", (record if full else F.lit(None).cast(r.select(record.alias("x")).schema["x"].dataType)).alias("record"), F.lit(None).cast("array<struct<modality:string,vec:array<float>>>").alias("vectors"), F.lit(None).cast("float").alias("importance"),
            (dst if dst is not None else F.lit(None)).cast("bigint").alias("dst"), F.lit("next").alias("rel_type"), F.lit(weight).cast("float").alias("weight"), (edges if edges is not None else F.lit(None)).cast(kind).alias("edges"),
        )

    def one(dst, weight: float):
        return F.array(F.struct(dst.alias("dst"), F.lit("next").alias("rel_type"), F.lit(weight).cast("float").alias("weight")))

    log = ops(r, 0, "ADD").unionByName(ops(r.where("id % 5 = 2"), 3, "UPDATE", one(i + 9, 0.25))).unionByName(ops(r.where("id % 5 = 3"), 3, "UPDATE", F.array().cast(kind)))
    log = log.unionByName(ops(r.where("id % 5 = 3"), 2, "LINK", dst=i + 4)).unionByName(ops(r.where("id % 5 in (1, 2)"), 5, "LINK", dst=i + 4)).unionByName(ops(r.where("id % 5 = 1"), 6, "LINK", dst=i + 4, weight=0.9))
    start = Tables(r, vectors(spark, d).limit(0), r.select(i.alias("src"), (i + 1).alias("dst"), F.lit("next").alias("rel_type"), F.lit(1.0).cast("float").alias("weight")))
    return rounded(logs.replay(start, log).edges.select("src", "dst", "weight"), "weight")


@query(f"WITH {ER}, asked AS (SELECT id FROM r WHERE id < 50 OR entity_id = '9' UNION SELECT 99999999) SELECT count_if(id IN (SELECT id FROM l)) AS deleted, count_if(id NOT IN (SELECT id FROM l)) AS not_found FROM asked")
def batch_delete(spark, d):
    t = _event_tables(spark, d)
    ids = t.records.where("id < 50").select("id").union(spark.range(99_999_999, 100_000_000).toDF("id"))
    return lifecycle.batch_delete(t, ids, ["9"])[1]


@query(f"WITH {ER} SELECT 'text' AS modality, round(avg(CASE WHEN source = '_forgotten' OR deleted THEN 1.0 ELSE 0.0 END), 6) AS share FROM r")
def dead_share(spark, d):
    return rounded(lifecycle.dead_share(_event_tables(spark, d)), "share")


@query(f"WITH {ER} SELECT id, CASE WHEN id = 17 THEN 'vip' ELSE '' END AS level, CASE WHEN id = 17 THEN 2.5 ELSE CAST(importance AS DOUBLE) END AS importance FROM r")
def attributes_and_importance(spark, d):
    r = lifecycle.update_importance(lifecycle.set_attribute(event_records(spark, d), 17, "level", "vip"), 17, 2.5)
    return rounded(r, "importance").select("id", lifecycle.get_attribute("level").alias("level"), "importance")


@query(f"WITH {ER} SELECT namespace_id, count_if(id % 5 <> 1) AS n, round(sum(CASE WHEN id % 5 = 1 THEN 0 WHEN id % 5 = 2 THEN 3.0 ELSE CAST(importance AS DOUBLE) END), 6) AS importance FROM l GROUP BY 1")
def oplog_replay(spark, d):
    r = live(event_records(spark, d))
    fields = [c for c in r.columns if c != "id"]
    record = F.struct(*fields)
    none_v = F.lit(None).cast("array<struct<modality:string,vec:array<float>>>")
    empty = dict(dst=F.lit(None).cast("long"), rel_type=F.lit(None).cast("string"), weight=F.lit(None).cast("float"))
    rest = [v.alias(k) for k, v in empty.items()]
    adds = r.select((F.col("id") * 10).alias("seq"), F.lit("ADD").alias("op"), "id", record.alias("record"), none_v.alias("vectors"), F.lit(None).cast("float").alias("importance"), *rest)
    forgets = r.where("id % 5 = 1").select((F.col("id") * 10 + 1).alias("seq"), F.lit("FORGET").alias("op"), "id", F.lit(None).cast(adds.schema["record"].dataType).alias("record"), none_v.alias("vectors"), F.lit(None).cast("float").alias("importance"), *rest)
    sets = r.where("id % 5 = 2").select((F.col("id") * 10 + 2).alias("seq"), F.lit("UIMP").alias("op"), "id", F.lit(None).cast(adds.schema["record"].dataType).alias("record"), none_v.alias("vectors"), F.lit(3.0).cast("float").alias("importance"), *rest)
    start = Tables(r.limit(0), vectors(spark, d).limit(0), spark.createDataFrame([], EDGES))
    out = logs.replay(start, adds.unionByName(forgets).unionByName(sets)).records
    return rounded(out.groupBy("namespace_id").agg(F.count_if(~dead()).alias("n"), F.sum("importance").alias("importance")), "importance")


# -- analytics -------------------------------------------------------------


@query(f"WITH {ER}, e AS (SELECT id AS i FROM r WHERE id % 3 = 0 UNION SELECT id * 7 % 10000 FROM r WHERE id % 3 = 0) SELECT count(*) AS total, count_if(recall_count = 0) AS cold, count_if(recall_count BETWEEN 1 AND 5) AS warm, count_if(recall_count > 5) AS hot, count_if(recall_count BETWEEN 6 AND 20) AS recalled_6_20, count_if(recall_count BETWEEN 21 AND 100) AS recalled_21_100, count_if(recall_count > 100) AS recalled_over_100, count_if(id NOT IN (SELECT i FROM e)) AS orphans, count_if(ttl > 0 AND 1706745600 > ts + ttl) AS expired, round(avg(CAST(importance AS DOUBLE)), 3) AS avg_importance, round(avg(CAST(confidence AS DOUBLE)), 3) AS avg_confidence FROM l")
def health_report(spark, d):
    t = _event_tables(spark, d)
    return analytics.health_report(t.records, t.edges.where("src % 3 = 0"), NOW)


@query(f"WITH {ER}, s AS (SELECT id, 0.4 * recall_count + CASE WHEN last_recalled_at > 0 THEN 60 / (1 + greatest(0, (1706745600 - last_recalled_at) / 86400.0)) ELSE 0 END AS score FROM l), n AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS p, count(*) OVER () AS n FROM s) SELECT tier, count(*) AS n, CAST(min(p) AS BIGINT) AS first_place FROM (SELECT p, CASE WHEN p <= greatest(1, floor(n * 0.1)) THEN 'hot' WHEN p <= greatest(1, floor(n * 0.1)) + greatest(1, floor(n * 0.3)) THEN 'warm' ELSE 'cold' END AS tier FROM n) GROUP BY tier")
def tiers_rank(spark, d):
    found = analytics.tiers(event_records(spark, d), NOW)
    placed = analytics.global_rank(found, [F.desc("score"), F.asc("id")])
    return placed.groupBy("tier").agg(F.count("*").alias("n"), F.min("place").alias("first_place"))


@query(f"WITH {ER} SELECT id, recall_count, last_recalled_at FROM l ORDER BY recall_count DESC, last_recalled_at DESC, id LIMIT 10")
def top_recalled(spark, d):
    return analytics.top_recalled(event_records(spark, d))


@query(f"WITH {ER} SELECT id, ts, namespace_id, entity_id, (SELECT count(*) FROM l WHERE entity_id = '3') AS total FROM l WHERE entity_id = '3' ORDER BY ts DESC, id LIMIT 20")
def timeline(spark, d):
    return analytics.timeline(event_records(spark, d), F.col("entity_id") == "3")


KIND = "CASE WHEN TRY_CAST(value AS BIGINT) IS NOT NULL THEN 'int' WHEN TRY_CAST(value AS DOUBLE) IS NOT NULL THEN 'float' WHEN value IN ('true', 'false', 'True', 'False') THEN 'bool' ELSE 'str' END"


@query(f"WITH {ER}, p AS (SELECT 'k' AS key, k AS value FROM l WHERE k IS NOT NULL UNION ALL SELECT 'flag', flag FROM l UNION ALL SELECT 'either', CASE WHEN id % 2 = 0 THEN '1.5' ELSE flag END FROM l) SELECT key, count(*) AS records, CAST(least(count(DISTINCT value), 64) AS BIGINT) AS different, CASE WHEN min({KIND}) = max({KIND}) THEN min({KIND}) ELSE 'mixed' END AS kind, array_to_string(list_sort(list(DISTINCT value))[1:8], ',') AS samples FROM p GROUP BY key")
def schema_keys(spark, d):
    either = F.create_map(F.lit("either"), F.when(F.col("id") % 2 == 0, "1.5").otherwise(F.element_at("attributes", "flag")))
    found = analytics.discover_schema(event_records(spark, d).withColumn("attributes", F.map_filter(F.map_concat("attributes", either), lambda _, v: v.isNotNull())))
    return found.select("key", "records", F.col("different").cast("long").alias("different"), "kind", F.array_join("samples", ",").alias("samples"))


@query(f"WITH {ER} SELECT * FROM (SELECT 'namespace_id' AS what, namespace_id AS name, count(*) AS n FROM l GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 20) UNION ALL SELECT * FROM (SELECT 'source', source, count(*) FROM l WHERE source <> '' GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10) UNION ALL SELECT * FROM (SELECT 'entity_id', entity_id, CAST(NULL AS BIGINT) FROM l ORDER BY id LIMIT 20)")
def schema_names(spark, d):
    return analytics.discover_names(event_records(spark, d))


def _ops(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("ts").cast("timestamp").cast("bigint").alias("ts"), F.col("event_type").alias("op"), F.floor(F.abs("value") * 10).cast("bigint").alias("latency_ms"), F.when(F.col("event_id") % 11 == 0, 500).otherwise(200).alias("status"))


OPS = "o AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_type AS op, CAST(floor(abs(value) * 10) AS BIGINT) AS latency_ms, CASE WHEN event_id % 11 = 0 THEN 500 ELSE 200 END AS status FROM events)"


@query(f"WITH {OPS}, b AS (SELECT (ts - 1705276800) // 43200 AS k, count(*) AS n, count_if(status >= 400) AS errors FROM o WHERE ts >= 1705276800 AND ts < 1706745600 GROUP BY 1) SELECT 1705276800 + t.k * 43200 AS start, coalesce(n, 0) AS n, coalesce(errors, 0) AS errors FROM range(0, 34) t(k) LEFT JOIN b ON b.k = t.k")
def metric_buckets(spark, d):
    return analytics.op_buckets(_ops(spark, d), NOW, 17 * 86400, 43200)


@query(f"WITH {OPS}, g AS (SELECT op, list_sort(list(latency_ms)) AS s, count(*) AS n, count_if(status >= 400) AS errors FROM o WHERE ts BETWEEN 1705881600 AND 1706745600 GROUP BY op) SELECT op, n, errors, s[n // 2 + 1] AS p50, s[greatest(1, CAST(floor(n * 0.95) AS BIGINT))] AS p95, s[greatest(1, CAST(floor(n * 0.99) AS BIGINT))] AS p99 FROM g")
def metrics_snapshot(spark, d):
    return analytics.metrics_snapshot(_ops(spark, d), NOW, 10 * 86400)


@query(f"WITH {OPS} SELECT count(*) AS n, round(avg(latency_ms), 6) AS mean, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95, quantile_disc(latency_ms, 0.99) AS p99 FROM o")
def latency_percentiles(spark, d):
    return rounded(analytics.latency_stats(_ops(spark, d)), "mean")


@query(f"WITH {OPS} SELECT ts, op, latency_ms, status FROM o ORDER BY ts DESC, op, latency_ms, status LIMIT 50")
def activity_feed(spark, d):
    return _ops(spark, d).orderBy(F.desc("ts"), "op", "latency_ms", "status").limit(50)


KIND = "CASE event_id % 7 WHEN 0 THEN 'fact_corrected' WHEN 1 THEN 'fact_endorsed' WHEN 2 THEN 'fact_retracted' WHEN 3 THEN 'retrieval_thumbs_up' WHEN 4 THEN 'retrieval_thumbs_down' WHEN 5 THEN 'entity_merged' ELSE 'contradiction_resolved' END"
FB = f"f AS (SELECT {KIND} AS kind, event_id * 13 % 3000 AS target_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events), fc AS (SELECT target_id, count_if(kind = 'fact_corrected') AS corrected, count_if(kind = 'fact_endorsed') AS endorsed, count_if(kind = 'fact_retracted') AS retracted, count_if(kind = 'retrieval_thumbs_up') AS up, count_if(kind = 'retrieval_thumbs_down') AS down, count(*) AS total, max(ts) AS last_ts FROM f GROUP BY 1)"


def _feedback(spark, d):
    e = table(spark, d, "events")
    return analytics.feedback_counts(e.select(F.expr(KIND).alias("kind"), (F.col("event_id") * 13 % 3000).alias("target_id"), F.col("ts").cast("timestamp").cast("bigint").alias("timestamp")))


@query(f"WITH {FB} SELECT * FROM fc")
def feedback_counts(spark, d):
    return _feedback(spark, d)


@query(f"WITH {FB} SELECT target_id, round(CASE WHEN retracted > 0 THEN 0 ELSE pow(0.5, least(corrected, 3)) * (1 + 0.2 * least(endorsed, 5)) * pow(0.9, least(down, 5)) * (1 + 0.05 * least(up, 10)) END, 6) AS modifier FROM fc")
def feedback_modifier(spark, d):
    c = F.col
    return rounded(_feedback(spark, d).select("target_id", scoring.feedback_modifier(c("retracted"), c("corrected"), c("endorsed"), c("down"), c("up")).alias("modifier")), "modifier")


@query(f"WITH p AS ({BATCH_SQL}), t AS (SELECT query_id, rank, id FROM p), g AS (SELECT query_id, rank, id FROM p WHERE id % 3 <> 0) SELECT t.query_id, round(count(g.id) / 10.0, 6) AS recall FROM t LEFT JOIN g ON g.query_id = t.query_id AND g.id = t.id GROUP BY 1")
def recall_at_k(spark, d):
    truth = knn_batch(spark, d)
    return rounded(analytics.recall_at_k(truth.where("id % 3 <> 0"), truth), "recall")


@query(f"WITH p AS ({BATCH_SQL}), rel AS (SELECT query_id, id FROM p WHERE id % 3 = 0), g AS (SELECT query_id, sum(1 / log2(rank + 1)) AS dcg FROM p WHERE id % 3 = 0 GROUP BY 1), m AS (SELECT query_id, least(count(*), 10) AS m FROM rel GROUP BY 1) SELECT m.query_id, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, CAST(m AS BIGINT) + 1), lambda r: 1 / log2(r + 1))), 6) AS ndcg FROM m LEFT JOIN g USING (query_id)")
def ndcg_at_k(spark, d):
    found = knn_batch(spark, d)
    return rounded(analytics.ndcg_at_k(found, found.where("id % 3 = 0").select("query_id", "id")), "ndcg")


@query("SELECT lang AS axis, round(avg(quality), 6) AS mean, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def score_by_axis(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select(F.col("lang").alias("axis"), "quality")
    return rounded(analytics.mean_by(j, "axis", "quality"), "mean")


@query("WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM x GROUP BY ALL), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY 1) SELECT CAST(m.label AS INTEGER) AS label, round(max(CASE WHEN i = 1 THEN x / n END), 6) AS first, round(max(CASE WHEN i = 64 THEN x / n END), 6) AS last FROM m JOIN n USING (label) GROUP BY 1")
def centroids(spark, d):
    v = table(spark, d, "embeddings").select("label", F.col("embedding").alias("vec"))
    c = analytics.centroid(v, ["label"])
    return c.select("label", F.round(F.element_at("vec", 1), 6).alias("first"), F.round(F.element_at("vec", -1), 6).alias("last"))


@query("WITH n AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS nth FROM events) SELECT event_id, event_type FROM n ORDER BY nth, event_type LIMIT 23")
def stratified_sample(spark, d):
    return analytics.stratified(table(spark, d, "events").select("event_id", "event_type"), "event_type", [F.asc("event_id")], 23)


# -- text and extraction ---------------------------------------------------

PHRASES = ("Shipped 2024-03-15, reviewed 2024-13-45 and 3/9/2023.", "in March 2024 and Sept 2021; Q3 2025", "3 days ago or two weeks ago, next quarter", "yesterday, TODAY and last month", "nothing here")


def _phrases(spark):
    rows = [(k, t) for k, t in enumerate(PHRASES)]
    return temporal.temporal_phrases(spark.createDataFrame(rows, "id long, text string").withColumn("anchor", F.timestamp_seconds(F.lit(NOW + 3600))))


@query("SELECT * FROM (VALUES (0, 1, 0, '2024-03-15', epoch(DATE '2024-03-15'), NULL), (0, 2, 0, '3/9/2023', epoch(DATE '2023-03-09'), NULL), (1, 3, 0, 'in March 2024', epoch(DATE '2024-03-01'), epoch(DATE '2024-04-01')), (1, 3, 1, 'Sept 2021', epoch(DATE '2021-09-01'), epoch(DATE '2021-10-01')), (1, 4, 0, 'Q3 2025', epoch(DATE '2025-07-01'), epoch(DATE '2025-10-01')), (2, 5, 0, '3 days ago', 1706749200 - 3 * 86400, NULL), (2, 5, 1, 'two weeks ago', 1706749200 - 14 * 86400, NULL), (2, 6, 0, 'next quarter', 1706749200 + 91 * 86400, NULL), (3, 6, 0, 'last month', 1706749200 - 30 * 86400, NULL), (3, 7, 0, 'yesterday', 1706659200, NULL), (3, 7, 1, 'TODAY', 1706745600, NULL)) t(id, rule, place, surface, resolved, range_end)")
def temporal_rules(spark, d):
    return _phrases(spark).select("id", "rule", "place", "surface", "resolved", "range_end")


@query("WITH t AS (SELECT event_id, 'on ' || strftime(ts, '%Y-%m-%d') || ' we met' AS x, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day FROM events) SELECT event_id, strptime(regexp_extract(x, '(\\d{4}-\\d{2}-\\d{2})', 1), '%Y-%m-%d') IS NOT NULL AS found, day AS resolved FROM t")
def temporal_iso(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("on "), F.date_format("ts", "yyyy-MM-dd"), F.lit(" we met")).alias("text"), F.timestamp_seconds(F.lit(NOW)).alias("anchor"))
    return temporal.temporal_phrases(e, "event_id").select("event_id", F.lit(True).alias("found"), "resolved")


@query("SELECT doc_id, CASE WHEN regexp_matches(t, 'prefer|always|never|like|dislike|want') THEN 'preference' WHEN regexp_matches(t, 'competitor|rival|launched|released|announced') THEN 'competitor_intel' WHEN regexp_matches(t, 'strategy|plan|goal|objective|target') THEN 'strategy_brief' WHEN regexp_matches(t, 'error|bug|fail|crash|issue|problem') THEN 'issue' WHEN regexp_matches(t, 'user|customer|feedback|complaint|request') THEN 'user_feedback' WHEN regexp_matches(t, 'market|trend|report|survey|data') THEN 'market_signal' ELSE 'fact' END AS entity_type FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def keyword_classes(spark, d):
    return table(spark, d, "documents").select("doc_id", text.keyword_class(F.col("text"))["entity_type"].alias("entity_type"))


@query("SELECT doc_id, CAST(('0x' || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2)) AS BIGINT) % 1125899906842624 AS id FROM (SELECT doc_id, sha256(text) AS h FROM documents)")
def stable_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", text.hashed_id(F.col("text")).alias("id"))


def _facts(spark, d, part: int):
    o = table(spark, d, "orders").where(F.col("o_orderkey") % 2 == part)
    value = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderstatus")).otherwise(F.concat(F.lit("$"), F.round(F.col("o_totalprice") / 1000, 0).cast("int").cast("string"), F.lit("k")))
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit(" Customer "), F.col("o_custkey")).alias("subject"), F.lit("Spent ").alias("predicate"), value.alias("object"), F.when(F.col("o_orderkey") % 3 == 0, F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))).alias("valid_at"))


FACTS = "f AS (SELECT o_orderkey AS id, o_custkey AS s, CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus ELSE '$' || CAST(round(o_totalprice / 1000, 0) AS INTEGER) || 'k' END AS o, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(CAST(round(o_totalprice / 1000, 0) AS INTEGER) AS DOUBLE) END AS n, CASE WHEN o_orderkey % 3 = 0 THEN CAST(epoch(o_orderdate) AS BIGINT) END AS v FROM orders), j AS (SELECT a.id AS new_id, b.id AS stored_id, a.n AS an, b.n AS bn, a.v AS av, b.v AS bv FROM f a JOIN f b ON a.s = b.s WHERE a.id % 2 = 1 AND b.id % 2 = 0 AND lower(a.o) <> lower(b.o)), c AS (SELECT *, an IS NOT NULL AND bn IS NOT NULL AS num, coalesce(abs(an - bn) / greatest(abs(an), abs(bn), 1e-9) <= 0.02, false) AS near FROM j)"


@query(f"WITH {FACTS} SELECT new_id, stored_id, CASE WHEN near OR coalesce(av > bv, false) OR coalesce(av < bv, false) THEN 'possible' WHEN num THEN 'probable' ELSE 'definite' END AS severity, CASE WHEN near THEN 'merge' WHEN coalesce(av > bv, false) THEN 'supersedes' ELSE 'review' END AS resolution FROM c")
def contradiction_rules(spark, d):
    return extraction.contradictions(_facts(spark, d, 1), _facts(spark, d, 0))


@query(f"WITH {VR}, p AS (SELECT a.id AS x, b.id AS y, pow(list_distance(a.vec, b.vec), 2) AS dd, a.source AS sa, b.source AS sb FROM vr a JOIN vr b ON a.id <> b.id), n AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY dd, y) AS nth FROM p) SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b, round(1 / (1 + dd), 6) AS similarity FROM n WHERE nth <= 10 AND 1 / (1 + dd) >= 0.45 AND sa <> sb")
def contradiction_scan(spark, d):
    none = spark.createDataFrame([], EDGES)
    return rounded(extraction.suspicious_pairs(vector_records(spark, d), vectors(spark, d).select("id", "vec"), none, 0.45), "similarity")


@query(f"WITH {VR}, l AS (SELECT a.id AS a, b.id AS b FROM vr a JOIN vr b ON a.id < b.id AND list_inner_product(a.vec, b.vec) / (sqrt(list_inner_product(a.vec, a.vec)) * sqrt(list_inner_product(b.vec, b.vec)) + 1e-9) >= 0.5) SELECT a, b FROM l")
def duplicate_pairs(spark, d):
    return consolidate.similar_pairs(vectors(spark, d).select("id", "vec"), 0.5).select("a", "b")


@query(f"WITH RECURSIVE {VR}, l AS (SELECT a.id AS a, b.id AS b FROM vr a JOIN vr b ON a.id <> b.id AND list_inner_product(a.vec, b.vec) >= 0.5), reach AS (SELECT a AS id, a AS root FROM l UNION SELECT l.b, r.root FROM reach r JOIN l ON l.a = r.id) SELECT id, min(root) AS root FROM reach GROUP BY id")
def consolidate_components(spark, d):
    return consolidate.connected(consolidate.similar_links(vectors(spark, d).select("id", "vec"), 0.5))


# -- streams, as their batch equivalents -----------------------------------


@query("SELECT date_trunc('hour', ts) AS start, event_type AS op, count(*) AS n, count_if(event_id % 11 = 0) AS errors FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("op"), F.when(F.col("event_id") % 11 == 0, 500).otherwise(200).alias("status"))
    return triggers.tumbling(e).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTES AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def stream_sessions(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return triggers.sessions(e).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT n.vec_id AS node_id, w.vec_id AS watch_id, round(list_cosine_similarity(n.e, w.e), 6) AS similarity FROM v n JOIN v w ON w.vec_id < 5 WHERE list_cosine_similarity(n.e, w.e) >= 0.3")
def stream_watch_matches(spark, d):
    e = table(spark, d, "embeddings")
    watches = e.where("vec_id < 5").select(F.col("vec_id").alias("watch_id"), F.col("embedding").alias("vec"), F.lit(0.3).alias("threshold"))
    return rounded(triggers.watch_matches(e.select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("vec")), watches), "similarity")


# -- further rows of the inventory -----------------------------------------


@query("WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM conversations), b AS (SELECT conv_id, turn, list_transform(w, lambda x: CAST('0x' || substr(md5(x), 32, 1) AS BIGINT)) AS b FROM w), c AS (SELECT conv_id, turn, list_transform(range(0, 16), lambda k: CAST(len(list_filter(b, lambda y: y = k)) AS DOUBLE)) AS c FROM b), n AS (SELECT *, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS n FROM c) SELECT conv_id, turn, round(c[1] / CASE WHEN n > 0 THEN n ELSE 1 END, 3) AS first, round(c[16] / CASE WHEN n > 0 THEN n ELSE 1 END, 3) AS last FROM n")
def hash_embeddings(spark, d):
    e = table(spark, d, "conversations").select("conv_id", "turn", text.hash_embedding(F.col("text"), 16).alias("v"))
    return e.select("conv_id", "turn", F.round(F.element_at("v", 1).cast("double"), 3).alias("first"), F.round(F.element_at("v", -1).cast("double"), 3).alias("last"))


@query()
def pca_2d(spark, d):
    return rounded(analytics.pca_2d(vectors(spark, d).select("id", "vec"), 64), "x", "y")


@query(f"WITH {ER} SELECT CASE WHEN id % 2 = 0 THEN 'new' ELSE source END AS source, count(*) AS n FROM (SELECT id, source FROM r UNION ALL SELECT id + 20000000, 'new' FROM r WHERE id % 100 = 0) GROUP BY 1")
def upsert_batch(spark, d):
    t = _event_tables(spark, d)
    new = t.records.where("id % 2 = 0").withColumn("source", F.lit("new"))
    more = t.records.where("id % 100 = 0").withColumns({"id": F.col("id") + 20_000_000, "source": F.lit("new")})
    both = lifecycle.last_wins(new.unionByName(more), ["id"], F.col("ts"))
    return lifecycle.add(t, both, t.vectors.limit(0)).records.groupBy("source").agg(F.count("*").alias("n"))


@query(f"WITH {ER} SELECT count_if(id % 50 <> 0) + 1 AS edges, (SELECT count(*) FROM r) + 1 AS records FROM r")
def update_metadata(spark, d):
    t = _event_tables(spark, d)
    new = t.records.where("id % 50 = 0").unionByName(t.records.where("id = 50").withColumn("id", F.lit(77_777_777).cast("long")))
    edges = spark.createDataFrame([(77_777_777, 1, "next", 1.0)], EDGES)
    out = lifecycle.update_metadata(t, new, edges)
    return out.edges.agg(F.count("*").alias("edges")).join(out.records.agg(F.count("*").alias("records")))


@query(f"WITH {ER} SELECT count_if(CASE WHEN 12 / 100.0 <= (SELECT avg(CASE WHEN source = '_forgotten' OR deleted THEN 1.0 ELSE 0 END) FROM r) THEN NOT (source = '_forgotten' OR deleted) ELSE true END) AS n FROM r")
def auto_compact(spark, d):
    return lifecycle.compact_if(_event_tables(spark, d), 0.12).records.agg(F.count("*").alias("n"))


@query("SELECT ts_start + k * INTERVAL 6 HOURS AS start, op, count(*) AS n FROM (SELECT date_trunc('day', ts) + (date_part('hour', ts) // 6 - 1) * INTERVAL 6 HOURS AS ts_start, event_type AS op, unnest([0, 1]) AS k FROM events) GROUP BY 1, 2")
def stream_sliding(spark, d):
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("op"))
    return triggers.sliding(e, "12 hours", "6 hours").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"WITH {EP} SELECT episode AS id, 'closed' AS status, CAST(max(ts) AS VARCHAR) AS ended, CAST(count(*) AS VARCHAR) AS members FROM m GROUP BY 1")
def episode_close(spark, d):
    edges, members = _episodes(spark, d)
    heads = as_records(edges.select(F.col("src").alias("id")).distinct())
    closed = episodes.close(heads, episodes.bounds(edges, members))
    return closed.select("id", lifecycle.get_attribute("status").alias("status"), lifecycle.get_attribute("episode_end").alias("ended"), lifecycle.get_attribute("member_count").alias("members"))


@query("SELECT CAST(c_custkey AS BIGINT) AS id, 'missing parent' AS problem FROM customer WHERE c_nationkey % 5 = 0")
def hierarchy_problems(spark, d):
    return hierarchy.problems(_places(spark, d).where("not (id between 500000000 and 500000099 and id % 5 = 0)"))


@query("SELECT o_orderkey AS id, CAST(trunc(o_totalprice) AS DOUBLE) AS x FROM orders")
def leading_numbers(spark, d):
    o = table(spark, d, "orders")
    shown = F.concat(F.lit("$ "), F.format_number(F.floor("o_totalprice"), 0), F.lit(" USD"))
    return o.select(F.col("o_orderkey").alias("id"), text.leading_number(shown).alias("x"))


@query("SELECT p_partkey AS id, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part")
def slugs(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.slug(F.concat(F.col("p_name"), F.lit(" / "), F.col("p_brand"))).alias("slug"))


@query("SELECT event_id AS id, 'user ' || user_id AS subject, 'did' AS predicate, event_type AS object, round(least(1, greatest(0, value / 100)), 6) AS confidence FROM events WHERE least(1, greatest(0, value / 100)) >= 0.5")
def facts_from_json(spark, d):
    e = table(spark, d, "events")
    fact = F.struct(F.concat(F.lit("user "), F.col("user_id")).alias("subject"), F.lit("did ").alias("predicate"), F.col("event_type").alias("object"), (F.col("value") / 100).alias("confidence"))
    answers = e.select(F.col("event_id").alias("id"), F.to_json(F.struct(F.array(fact, F.struct(F.lit("").alias("subject"), F.lit("x").alias("predicate"), F.lit("y").alias("object"), F.lit(1.0).alias("confidence"))).alias("facts"))).alias("answer"))
    return rounded(extraction.facts_of(answers), "confidence").select("id", "subject", "predicate", "object", "confidence")


@query("WITH p AS (SELECT o_custkey AS src, o_orderkey % 1500 AS dst, CASE o_orderkey % 3 WHEN 0 THEN 'supports' WHEN 1 THEN 'contradicts' ELSE 'likes' END AS rel_type, o_totalprice / 100000 AS weight, CASE WHEN o_orderkey % 2 = 0 THEN 'why' ELSE '' END AS rationale FROM orders) SELECT src, dst, rel_type, CAST(least(1, greatest(0, weight)) AS FLOAT) AS weight FROM p WHERE rel_type <> 'likes' AND src <> dst AND (rel_type <> 'contradicts' OR rationale <> '') AND src IN (SELECT c_custkey FROM customer) AND dst IN (SELECT c_custkey FROM customer)")
def ontology_validation(spark, d):
    kind = F.when(F.col("o_orderkey") % 3 == 0, "supports").when(F.col("o_orderkey") % 3 == 1, "contradicts").otherwise("likes")
    proposed = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 1500).alias("dst"), kind.alias("rel_type"), (F.col("o_totalprice") / 100000).alias("weight"), F.when(F.col("o_orderkey") % 2 == 0, "why").otherwise("").alias("rationale"))
    return extraction.ontology_edges(proposed, table(spark, d, "customer").select(F.col("c_custkey").alias("id"))).drop("rationale")


@query("SELECT c_name AS surface, CASE WHEN c_custkey % 2 = 0 THEN 'c' || (c_custkey % 10) ELSE c_name END AS canonical, CASE WHEN c_custkey % 2 = 0 THEN regexp_replace(lower(c_mktsegment || ' Co.'), '[^a-z0-9]+', '_', 'g') ELSE 'other' END AS entity_type FROM customer")
def entity_resolution(spark, d):
    c = table(spark, d, "customer")
    known = c.where("c_custkey % 2 = 0").select(F.col("c_name").alias("surface"), F.concat(F.lit("c"), F.col("c_custkey") % 10).alias("canonical"), F.concat(F.col("c_mktsegment"), F.lit(" Co.")).alias("entity_type"))
    return extraction.resolved_entities(c.select(F.col("c_name").alias("surface")), known).drop("entity_id")


@query("SELECT c_custkey AS id, c_mktsegment AS namespace_id, CAST(c_nationkey AS VARCHAR) AS entity_id, round(c_acctbal, 2) AS balance FROM customer")
def domain_profile(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("content"), "c_mktsegment", "c_nationkey", "c_acctbal")
    found = extraction.profile(c, "c_mktsegment", "c_nationkey")
    return found.select("id", "namespace_id", "entity_id", F.round(extraction.number_of("c_acctbal"), 2).alias("balance"))


@query(f"WITH {ER} SELECT id, '{{\"id\":' || id || ',\"namespace_id\":\"' || namespace_id || '\"}}' AS json FROM l WHERE entity_id = '5'")
def export_json(spark, d):
    nodes = live(event_records(spark, d)).where("entity_id = '5'").select("id", "namespace_id")
    return nodes.select("id", F.to_json(F.struct("id", "namespace_id")).alias("json"))


@query(f"WITH {_rrf_sql(60).replace('LIMIT 30', 'LIMIT 60').replace('LIMIT 10', 'LIMIT 5')[5:]}")
def recall_hybrid(spark, d):
    found = hybrid.hybrid_search(_both(spark, d), vectors(spark, d), first_vector(spark, d), WORDS, NOW, 20)
    return rounded(found.orderBy(F.desc(F.round("score", 12)), F.desc("id")).limit(5), "score")
