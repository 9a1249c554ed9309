"""Resolution of WARC not-modified revisits.

A revisit (a 304 answer) holds no content: it stands for the latest full
response that was captured earlier under the same canonical URL. It is
resolved if the validators agree (entity tags by weak comparison, or where one
is missing the Last-Modified dates), and then has that response's headers,
updated by those that a 304 may change.

The as-of join works on slices of time: the last response of each URL and
slice is carried to the next slices, and within a slice rows are ordered by
time. A URL that holds much of the corpus is thus dealt out over its slices,
and a slice that holds much of it is cut finer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallgrid.llm._spark import HOT_KEYS, Scratch

#: Query parameters that name a visit, not a page.
TRACKING = r"^(?:utm_[a-z]+|ref|gclid|fbclid|sessionid)="

#: Header fields of a 304 answer that don't replace those of the stored response.
KEPT_FIELDS = ("connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "etag", "keep-alive", "proxy-authenticate", "te", "trailer", "transfer-encoding", "upgrade")

SLICE_SECONDS = 86_400
#: A slice of a URL with more rows than this, and over 1 / HOT_KEYS of all, is cut in parts of about as many.
SLICE_ROWS = 50_000
MOST_PARTS = 1 << 20


def canonical_url(url: Column) -> Column:
    """http for https, lower-case host without www. and default port, no
    fragment, path "/" if empty, parameters sorted and without those for
    tracking. Null stays null; what isn't http is only trimmed."""
    trimmed = F.trim(url)
    bare = F.regexp_replace(trimmed, r"#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^(?i:https?)://(?:[^/?@]*@)?(?:(?i:www)\.)?([^/?]*)", 1))
    host = F.regexp_replace(host, r":(?:80|443)?$", "")
    path = F.regexp_extract(bare, r"^(?i:https?)://[^/?]*(/[^?]*)", 1)
    asked = F.regexp_extract(bare, r"\?(.*)$", 1)
    left = F.array_sort(F.filter(F.split(asked, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    query = F.when(F.size(left) > 0, F.concat(F.lit("?"), F.concat_ws("&", left))).otherwise("")
    return F.when(host == "", trimmed).otherwise(F.concat(F.lit("http://"), host, F.when(path == "", "/").otherwise(path), query))


def _tag(etag: Column) -> Column:
    return F.regexp_replace(F.trim(etag), r"^W/", "")


def _field(headers: Column, name: str) -> Column:
    return F.element_at(headers, name)


def merged_headers(stored: Column, update: Column) -> Column:
    """The stored response's header fields (lower-case names), each replaced
    by the 304's where that may do so, and the 304's further ones."""
    allowed = F.map_filter(F.coalesce(update, F.create_map().cast("map<string,string>")), lambda name, _: ~name.isin(*KEPT_FIELDS))
    own = F.map_filter(F.coalesce(stored, F.create_map().cast("map<string,string>")), lambda name, _: ~F.coalesce(F.map_contains_key(allowed, name), F.lit(False)))
    return F.map_from_entries(F.array_sort(F.concat(F.map_entries(own), F.map_entries(allowed))))


def _finer(row: DataFrame, total: int, slice_seconds: int, slice_rows: int) -> DataFrame:
    """row with its slice cut in parts where many rows share it. Slices of a
    URL stay in the order of time."""
    sizes = row.where("canonical is not null and slice is not null").groupBy("canonical", "slice").agg(F.count("*").alias("n"))
    hot = sizes.where(F.col("n") > max(slice_rows, total / HOT_KEYS))
    parts = hot.select("canonical", "slice", F.least(F.ceil(F.col("n") / slice_rows), F.lit(MOST_PARTS)).cast("long").alias("parts"))
    # fewer than HOT_KEYS rows
    joined = row.join(F.broadcast(parts), ["canonical", "slice"], "left")
    inside = F.floor((F.col("captured") - F.col("slice") * slice_seconds) * F.coalesce("parts", F.lit(1)) / slice_seconds)
    return joined.withColumn("slice", F.col("slice") * MOST_PARTS + inside).select(*row.columns)


def resolve_revisits(records: DataFrame, slice_seconds: int = SLICE_SECONDS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row for each revisit in records (record_id, url, captured: seconds,
    kind: "response" or "revisit", headers: map with lower-case names,
    digest): record_id, canonical, captured, response_id, response_captured,
    status, headers, digest.

    status: "resolved"; "changed", where validators of both disagree;
    "unverified", where no validator is on both sides; "missing", without an
    earlier response (also where the revisit's URL or time is null). Only
    resolved rows have headers and digest. Responses captured in the same
    second count as earlier; of several at one time the largest record_id is
    taken (null the smallest). Other kinds and other columns are not read;
    repeated rows are kept; an empty table gives no rows.
    """
    scratch = Scratch(records.sparkSession, "warc")
    row = records.where(F.col("kind").isin("response", "revisit")).select(
        F.col("record_id").cast("long").alias("record_id"), canonical_url(F.col("url")).alias("canonical"), F.col("captured").cast("long").alias("captured"), (F.col("kind") == "revisit").alias("asks"), "headers", "digest"
    )
    row = _finer(row.withColumn("slice", F.floor(F.col("captured") / slice_seconds).cast("long")), records.count(), slice_seconds, slice_rows)
    placed = F.col("canonical").isNotNull() & F.col("captured").isNotNull()
    full = F.struct("captured", "record_id")
    slices = row.where(placed).groupBy("canonical", "slice").agg(F.max(F.when(~F.col("asks"), full)).alias("last"), F.max("asks").alias("asked"))
    before = Window.partitionBy("canonical").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.withColumn("carried", F.last("last", ignorenulls=True).over(before)).where("asked").select("canonical", "slice", "carried")
    narrow = row.where(placed).select("canonical", "slice", "captured", "record_id", "asks")
    inside = Window.partitionBy("canonical", "slice").orderBy("captured", "asks", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = narrow.withColumn("near", F.last(F.when(~F.col("asks"), full), ignorenulls=True).over(inside)).where("asks")
    found = seen.join(carried, ["canonical", "slice"]).withColumn("hit", F.coalesce("near", "carried"))
    found = scratch.keep(found.select("record_id", "canonical", "captured", F.col("hit.captured").alias("response_captured"), F.col("hit.record_id").alias("response_id")).distinct())
    asks = row.where("asks").select("record_id", "canonical", "captured", F.col("headers").alias("update"))
    same = [asks[c].eqNullSafe(found[c]) for c in ("record_id", "canonical", "captured")]
    hit = asks.join(found, same, "left").select(asks["record_id"], asks["canonical"], asks["captured"], "update", "response_captured", "response_id")
    stored = row.where("not asks").where(placed).select(F.col("canonical").alias("c"), F.col("captured").alias("t"), F.col("record_id").alias("r"), F.col("headers").alias("stored"), "digest")
    stored = stored.groupBy("c", "t", "r").agg(F.max_by(F.struct("stored", "digest"), F.coalesce("digest", F.lit(""))).alias("s")).select("c", "t", "r", "s.stored", "s.digest")
    full_hit = hit.join(stored, (hit["canonical"] == stored["c"]) & (hit["response_captured"] == stored["t"]) & hit["response_id"].eqNullSafe(stored["r"]), "left")
    tags, dates = (_tag(_field(F.col("update"), "etag")), _tag(_field(F.col("stored"), "etag"))), (_field(F.col("update"), "last-modified"), _field(F.col("stored"), "last-modified"))
    agrees = F.coalesce(tags[0] == tags[1], dates[0] == dates[1])
    status = F.when(F.col("response_captured").isNull(), "missing").when(agrees, "resolved").when(~agrees, "changed").otherwise("unverified")
    done = full_hit.withColumn("status", status)
    resolved = F.col("status") == "resolved"
    return done.select("record_id", "canonical", "captured", "response_id", "response_captured", "status", F.when(resolved, merged_headers(F.col("stored"), F.col("update"))).alias("headers"), F.when(resolved, F.col("digest")).alias("digest"))


def capture_log(pages: DataFrame) -> DataFrame:
    """A capture log of pages (page_id, url, html) for resolve_revisits: each
    page a full response captured page_id minutes after the epoch, and a
    revisit of its URL half a day later, whose entity tag is that of its own
    page or, for every seventh page, that of a later version. Pages of even
    page_id have an entity tag, all others a Last-Modified date alone."""
    at = F.col("page_id") * 60
    digest = F.sha2(F.coalesce("html", F.lit("")), 256)
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    day = F.date_format(F.timestamp_seconds(F.floor(at / 86400) * 86400), "yyyy-MM-dd")
    even = F.col("page_id") % 2 == 0
    validators = F.when(even, F.create_map(F.lit("etag"), tag)).otherwise(F.create_map(F.lit("last-modified"), day))
    response = F.map_concat(validators, F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.octet_length("html").cast("string"), F.lit("cache-control"), F.lit("max-age=60")))
    later = F.when(even & (F.col("page_id") % 7 == 0), F.create_map(F.lit("etag"), F.lit('"newer"'))).when(even, F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag))).otherwise(validators)
    revisit = F.map_concat(later, F.create_map(F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=600"), F.lit("age"), (F.col("page_id") % 100).cast("string")))
    first = F.struct((F.col("page_id") * 2).alias("record_id"), "url", at.alias("captured"), F.lit("response").alias("kind"), response.alias("headers"), digest.alias("digest"))
    second = F.struct((F.col("page_id") * 2 + 1).alias("record_id"), "url", (at + 43200).alias("captured"), F.lit("revisit").alias("kind"), revisit.alias("headers"), F.lit(None).cast("string").alias("digest"))
    return pages.select(F.explode(F.array(first, second)).alias("x")).select("x.*")
