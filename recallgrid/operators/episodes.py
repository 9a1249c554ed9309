"""Episodes: ordered groups of records under a header record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallgrid.functions.text import hashed_id

CONTAINS = "episode_contains"


def header_id(episode: Column) -> Column:
    return hashed_id(F.concat(F.lit("__ep__"), episode), 50, 8)


def headers(episodes: DataFrame) -> DataFrame:
    """(id, episode_id) of the header records of episodes (episode_id)."""
    return episodes.select(header_id(F.col("episode_id")).alias("id"), "episode_id").distinct()


def member_edges(members: DataFrame) -> DataFrame:
    """Edges from headers to members (episode_id, id)."""
    return members.select(header_id(F.col("episode_id")).alias("src"), F.col("id").alias("dst"), F.lit(CONTAINS).alias("rel_type"), F.lit(1.0).cast("float").alias("weight")).distinct()


def timeline(edges: DataFrame, records: DataFrame) -> DataFrame:
    """(episode, place, id, ts): members of all episodes, by time."""
    held = edges.where(F.col("rel_type") == CONTAINS).select(F.col("src").alias("episode"), F.col("dst").alias("id")).join(records.select("id", "ts"), "id")
    place = F.row_number().over(Window.partitionBy("episode").orderBy("ts", "id"))
    return held.select("episode", place.alias("place"), "id", "ts")


def bounds(edges: DataFrame, records: DataFrame) -> DataFrame:
    """(episode, started, ended, members): what closing an episode records."""
    held = edges.where(F.col("rel_type") == CONTAINS).select(F.col("src").alias("episode"), F.col("dst").alias("id")).join(records.select("id", "ts"), "id")
    return held.groupBy("episode").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("members"))


def close(records: DataFrame, ended: DataFrame) -> DataFrame:
    """records, headers of ended episodes (episode, ended, members) marked as closed."""
    marks = ended.select(F.col("episode").alias("id"), F.create_map(F.lit("status"), F.lit("closed"), F.lit("episode_end"), F.col("ended").cast("string"), F.lit("member_count"), F.col("members").cast("string")).alias("__marks"))
    joined = records.join(marks, "id", "left")
    kept = F.map_filter("attributes", lambda k, _: ~k.isin("status", "episode_end", "member_count"))
    return joined.withColumn("attributes", F.when(F.col("__marks").isNotNull(), F.map_concat(kept, "__marks")).otherwise(F.col("attributes"))).select(*records.columns)
