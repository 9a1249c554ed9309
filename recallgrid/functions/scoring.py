"""Scores of recency and use, and what feedback does to them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Decay:
    """half_life in days; time_weight: the share of recency in the score;
    min_weight: the least recency."""

    half_life: float = 30.0
    time_weight: float = 0.3
    min_weight: float = 0.0


def stickiness(recall_count: Column) -> Column:
    return 1 + F.log1p(recall_count.cast("double"))


def age_days(ts: Column, now: int) -> Column:
    """Never negative: what lies ahead is as fresh as now."""
    return F.greatest(F.lit(0.0), (F.lit(now) - ts) / 86400.0)


def recency(ts: Column, recall_count: Column, now: int, decay: Decay) -> Column:
    effective = age_days(ts, now) / stickiness(recall_count)
    return F.greatest(F.lit(decay.min_weight), F.pow(F.lit(0.5), effective / decay.half_life))


def decayed(similarity: Column, ts: Column, recall_count: Column, importance: Column, now: int, decay: Decay = Decay()) -> Column:
    """((1 - w) similarity + w recency) importance. now is always given: no
    query reads the clock."""
    blend = (1 - decay.time_weight) * similarity + decay.time_weight * recency(ts, recall_count, now, decay)
    return blend * importance.cast("double")


def feedback_modifier(retracted: Column, corrected: Column, endorsed: Column, down: Column, up: Column) -> Column:
    """What a record's weight is multiplied by, from counts of feedback."""
    one = F.lit(1.0)
    grown = F.pow(F.lit(0.5), F.least(corrected, F.lit(3))) * (one + 0.2 * F.least(endorsed, F.lit(5)))
    return F.when(retracted > 0, 0.0).otherwise(grown * F.pow(F.lit(0.9), F.least(down, F.lit(5))) * (one + 0.05 * F.least(up, F.lit(10))))
