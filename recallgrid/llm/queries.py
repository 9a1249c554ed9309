"""The registered queries of the training-data operators: each applies one
operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.llm import embedding_dedup, licenses, line_dedup, mixing, permutation_index, quality, sentencepiece_codec, simhash, substrings, warc

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZERS = os.environ.get("RECALLGRID_TOKENIZERS", "/opt/tokenizers")
PIECE_MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents")).drop("spans")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
     win AS (SELECT doc_id, t.p AS p, array_to_string(l[t.p + 1 : t.p + 3], chr(10)) AS k FROM l, unnest(range(0, greatest(len(l) - 2, 0))) AS t(p)),
     numbered AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n FROM win WHERE regexp_matches(k, '[^ 	-
]')),
     gone AS (SELECT DISTINCT doc_id, p + o.o AS pos FROM numbered, unnest(range(0, 3)) AS o(o) WHERE n > 1),
     lines AS (SELECT doc_id, t.pos AS pos, l[t.pos + 1] AS line FROM l, unnest(range(0, len(l))) AS t(pos)),
     kept AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS t FROM lines ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT l.doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(l), 0) - coalesce(n, 0) AS BIGINT) AS n_removed,
       CASE WHEN text IS NOT NULL THEN sha256(coalesce(t, '')) END AS kept_sha256
FROM l LEFT JOIN kept ON l.doc_id = kept.doc_id
"""


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


#: All pairs, in double precision; at most the sizes that SQL can do that for.
OP5_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
     n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
     links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
     reach AS (SELECT vec_id AS id, vec_id AS root FROM n UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id),
     roots AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id),
     degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(degree.n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN roots ON id = vec_id LEFT JOIN degree ON a = vec_id
"""


def op6_permutation_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_quality_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", "text_score", "metadata_score", "score", "keep")


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.capture_log(_table(spark, sf_dir, "pages")))
    headers = F.concat_ws("; ", F.transform(F.map_entries("headers"), lambda h: F.concat(h["key"], F.lit("="), h["value"])))
    return found.select("record_id", "canonical", "captured", "response_id", "response_captured", "status", F.when(F.col("headers").isNotNull(), headers).alias("headers"), "digest")


OP8_SQL = r"""
WITH b AS (SELECT page_id, trim(url) AS url, regexp_replace(trim(url), '#.*$', '') AS bare, sha256(coalesce(html, '')) AS digest, octet_length(encode(html)) AS size FROM pages),
     c AS (SELECT *, regexp_replace(lower(regexp_extract(bare, '^(?i:https?)://(?:[^/?@]*@)?(?:(?i:www)\.)?([^/?]*)', 1)), ':(80|443)?$', '') AS host,
                  regexp_extract(bare, '^(?i:https?)://[^/?]*(/[^?]*)', 1) AS path,
                  list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|gclid|fbclid|sessionid)='))) AS args FROM b),
     p AS (SELECT page_id, digest, size, '"' || substr(digest, 1, 16) || '"' AS tag, strftime(make_timestamp(((page_id * 60) // 86400) * 86400000000), '%Y-%m-%d') AS day,
                  CASE WHEN host = '' THEN url ELSE 'http://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END END AS canonical FROM c),
     responses AS (SELECT page_id * 2 AS response_id, page_id * 60 AS t, canonical, digest, size, page_id % 2 = 0 AS even, tag, day FROM p),
     revisits AS (SELECT page_id * 2 + 1 AS record_id, page_id * 60 + 43200 AS captured, canonical, page_id, page_id % 2 = 0 AS even, CASE WHEN page_id % 7 = 0 THEN '"newer"' ELSE tag END AS tag, day FROM p),
     hit AS (SELECT v.record_id, v.canonical, v.captured, r.response_id, r.t AS response_captured, v.page_id, r.digest, r.size,
                    v.even AND r.even AS tags, v.tag = r.tag AS same_tag, NOT v.even AND NOT r.even AS dates, v.day = r.day AS same_day, r.even AS stored_even, r.tag AS stored_tag, r.day AS stored_day, v.even AS asks_even, v.day AS asks_day
             FROM revisits v ASOF LEFT JOIN responses r ON v.canonical = r.canonical AND v.captured >= r.t),
     done AS (SELECT *, CASE WHEN response_id IS NULL THEN 'missing' WHEN tags AND same_tag OR dates AND same_day THEN 'resolved' WHEN tags OR dates THEN 'changed' ELSE 'unverified' END AS status FROM hit)
SELECT record_id, canonical, CAST(captured AS BIGINT) AS captured, response_id, CAST(response_captured AS BIGINT) AS response_captured, status,
       CASE WHEN status = 'resolved' THEN 'age=' || (page_id % 100) || '; cache-control=max-age=600; content-length=' || size || '; content-type=text/html; '
            || CASE WHEN stored_even THEN 'etag=' || stored_tag ELSE 'last-modified=' || asks_day END END AS headers,
       CASE WHEN status = 'resolved' THEN digest END AS digest
FROM done
"""


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     win AS (SELECT doc_id, t.p AS p, md5(array_to_string(w[t.p + 1 : t.p + 50], ' ')) AS k FROM w, unnest(range(0, greatest(len(w) - 49, 0))) AS t(p)),
     firsts AS (SELECT k, min(doc_id) AS lo FROM win GROUP BY k),
     gone AS (SELECT DISTINCT win.doc_id, win.p + o.o AS pos FROM win JOIN firsts USING (k), unnest(range(0, 50)) AS o(o) WHERE lo < win.doc_id),
     words AS (SELECT doc_id, t.pos AS pos, w[t.pos + 1] AS word FROM w, unnest(range(0, len(w))) AS t(pos)),
     kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS t FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentencepiece_codec.encode(_table(spark, sf_dir, "documents"), PIECE_MODEL)
    back = sentencepiece_codec.decode(encoded, PIECE_MODEL)
    digest = F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256)
    return back.select("doc_id", "n_tokens", digest.alias("ids_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


QUERIES: dict[str, Query] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_source_mix": op2_source_mix,
    "op3_license_scan": op3_license_scan,
    "op4_line_dedup": op4_line_dedup,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_permutation_ann": op6_permutation_ann,
    "op7_quality_co_training": op7_quality_co_training,
    "op8_warc_revisits": op8_warc_revisits,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_sentencepiece": op10_sentencepiece,
}

ORACLE_SQL: dict[str, str] = {"op4_line_dedup": OP4_SQL, "op5_embedding_near_dedup": OP5_SQL, "op8_warc_revisits": OP8_SQL, "op9_substring_dedup": OP9_SQL}
