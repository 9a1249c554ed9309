"""Text expressions: tokens, slugs, numbers, keyword classes, ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words.
STOP_WORDS = (
    "a an the and or but in on at to for of with by from is are was were be been have has had do does did will would could should may might shall can "
    "not no it its this that these those i me my we us our you your he him his she her they them their"
).split()

#: Keywords in the order they are tried, class, importance.
KEYWORD_CLASSES = (
    (("prefer", "always", "never", "like", "dislike", "want"), "preference", 0.8),
    (("competitor", "rival", "launched", "released", "announced"), "competitor_intel", 0.9),
    (("strategy", "plan", "goal", "objective", "target"), "strategy_brief", 0.85),
    (("error", "bug", "fail", "crash", "issue", "problem"), "issue", 0.9),
    (("user", "customer", "feedback", "complaint", "request"), "user_feedback", 0.8),
    (("market", "trend", "report", "survey", "data"), "market_signal", 0.75),
)

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits in lower case, of two bytes at least,
    without stop words; other characters part tokens. Null: none."""
    words = F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*STOP_WORDS))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def leading_number(text: Column) -> Column:
    """The number a text starts with, without commas and one currency sign; else null."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(text, ",", "")), r"^[$€£¥₹]\s*", "")
    return F.regexp_extract(bare, r"^[-+]?(?:\d+\.?\d*|\.\d+)", 0).try_cast("double")


def keyword_class(text: Column) -> Column:
    """(entity_type, importance, confidence) by the first class of which a
    keyword occurs anywhere in the text, even inside a word."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.struct(F.lit("fact").alias("entity_type"), F.lit(0.7).alias("importance"), F.lit(0.5).alias("confidence"))
    for words, name, importance in reversed(KEYWORD_CLASSES):
        hit = F.lit(False)
        for word in words:
            hit = hit | low.contains(word)
        out = F.when(hit, F.struct(F.lit(name).alias("entity_type"), F.lit(importance).alias("importance"), F.lit(0.5).alias("confidence"))).otherwise(out)
    return out


def hashed_id(text: Column, bits: int = 50, octets: int = 8) -> Column:
    """The first octets of SHA-256, little-endian, modulo 2**bits (at most 62)."""
    digest = F.sha2(text, 256)
    swapped = F.concat(*[F.substring(digest, 2 * k + 1, 2) for k in range(octets - 1, -1, -1)])
    # the low bits are all that counts
    digits = -(-bits // 4)
    return F.conv(F.right(swapped, F.lit(digits)), 16, 10).cast("bigint").bitwiseAND((1 << bits) - 1)


def hash_embedding(text: Column, dim: int) -> Column:
    """Words counted in dim buckets by their MD5 as one number modulo dim,
    normalized: an embedder that needs no model."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")

    def bucket(word: Column) -> Column:
        parts = F.transform(F.array(*[F.lit(k) for k in (1, 9, 17, 25)]), lambda k: F.conv(F.substring(F.md5(word), k, F.lit(8)), 16, 10).cast("bigint"))
        return F.aggregate(parts, F.lit(0).cast("bigint"), lambda r, x: (r * (1 << 32) + x) % dim).cast("int")

    buckets = F.transform(words, bucket)
    counts = once(buckets, lambda b: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.size(F.filter(b, lambda x: x == k)).cast("double")))

    def unit(c: Column) -> Column:
        length = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
        return once(length, lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(0.0).cast("float")))

    return once(counts, unit)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is worked out a single time for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)
