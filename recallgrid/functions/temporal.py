"""Temporal phrases in texts, by rules, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns, words and days of units.
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|sept|oct|nov|dec"
NUMBERS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
UNIT_DAYS = {"day": 1, "week": 7, "month": 30, "quarter": 91, "year": 365}
ISO = r"\b(\d{4})-(\d{2})-(\d{2})\b"
NUMERIC = r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{4})\b"
MONTH_YEAR = rf"(?i)\b(?:in\s+)?({MONTHS})\s+(\d{{4}})\b"
QUARTER = r"(?i)\bQ([1-4])[\s-]+(\d{4})\b"
AGO = rf"(?i)\b(\d+|{'|'.join(NUMBERS)})\s+(days?|weeks?|months?|years?|quarters?)\s+ago\b"
LAST_NEXT = r"(?i)\b(last|next)\s+(week|month|year|quarter)\b"
DAY = r"(?i)\b(yesterday|today|tomorrow)\b"


def _part(pattern: str, k: int) -> Column:
    return F.regexp_extract("surface", pattern, k)


def _choice(value: Column, table: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value)


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_timestamp(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")).cast("timestamp")


def temporal_phrases(texts: DataFrame, key: str = "id", text: str = "text", anchor: str = "anchor", day_first: bool = False) -> DataFrame:
    """One row for each phrase: key, rule (1 to 7, the order in which rules
    are tried), place (of the rule's phrases in the text), surface, kind,
    resolved and range_end (seconds), confidence.

    Dates are read as month/day/year unless day_first. Phrases are resolved
    against the timestamp column anchor. Dates that don't exist are left out.
    Nulls have no phrases.
    """
    now = F.col("anchor").cast("timestamp")
    unit = F.regexp_replace(F.lower(_part(AGO, 2)), "s$", "")
    amount = F.coalesce(F.lower(_part(AGO, 1)).try_cast("bigint"), _choice(F.lower(_part(AGO, 1)), {w: k + 1 for k, w in enumerate(NUMBERS)}))
    month = _choice(F.substring(F.lower(_part(MONTH_YEAR, 1)), 1, 3), {m: k + 1 for k, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())})
    first = _date(_part(MONTH_YEAR, 2), month.cast("string"), F.lit("1"))
    quarter = _date(_part(QUARTER, 2), (_part(QUARTER, 1).try_cast("int") * 3 - 2).cast("string"), F.lit("1"))
    a, b = (_part(NUMERIC, k) for k in ((2, 1) if day_first else (1, 2)))
    shift = F.when(F.lower(_part(LAST_NEXT, 1)) == "last", -1).otherwise(1) * _choice(F.lower(_part(LAST_NEXT, 2)), UNIT_DAYS)
    day = _choice(F.lower(_part(DAY, 1)), {"yesterday": -1, "today": 0, "tomorrow": 1})
    none = F.lit(None).cast("timestamp")
    days = F.make_dt_interval
    rules = (
        (ISO, "absolute", _date(_part(ISO, 1), _part(ISO, 2), _part(ISO, 3)), none, 1.0),
        (NUMERIC, "absolute", _date(_part(NUMERIC, 3), a, b), none, 0.9),
        (MONTH_YEAR, "range_start", first, F.add_months(first, 1).cast("timestamp"), 1.0),
        (QUARTER, "range_start", quarter, F.add_months(quarter, 3).cast("timestamp"), 1.0),
        (AGO, "relative", now - days((amount * _choice(unit, UNIT_DAYS)).cast("int")), none, 0.85),
        (LAST_NEXT, "relative", now + days(shift), none, 0.7),
        (DAY, "relative", F.date_trunc("day", now + days(day)), none, 1.0),
    )
    # one scan: each text gives the phrases of all rules, and the rule decides how they are read
    lists = F.array(*[F.struct(F.lit(k + 1).alias("rule"), F.regexp_extract_all(F.col("text"), F.lit(rule[0]), F.lit(0)).alias("all")) for k, rule in enumerate(rules)])
    base = texts.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(anchor).alias("anchor"))
    found = base.select("key", "anchor", F.explode(lists).alias("found")).select("key", "anchor", "found.rule", F.posexplode("found.all").alias("place", "surface"))

    def of_rule(at: int) -> Column:
        value = F.lit(None)
        for k, rule in enumerate(rules):
            value = F.when(F.col("rule") == k + 1, rule[at] if isinstance(rule[at], Column) else F.lit(rule[at])).otherwise(value)
        return value

    read = found.select(F.col("key").alias(key), "rule", "place", "surface", of_rule(1).alias("kind"), of_rule(2).cast("bigint").alias("resolved"), of_rule(3).cast("bigint").alias("range_end"), of_rule(4).alias("confidence"))
    return read.where("resolved is not null")
