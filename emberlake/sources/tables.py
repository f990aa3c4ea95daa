"""Tables of a folder, and the events table as the engine's events and deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with projects, players, actors and sessions made from the user; some have no actor, few no session either."""
    user = F.col("user_id").cast("string")
    at = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("event_id"),
        F.concat(F.lit("game-"), (F.col("user_id") % 4).cast("string")).alias("project_id"),
        F.concat(F.lit("u"), user).alias("player_id"),
        F.when((F.col("user_id") % 50 != 0) & (F.col("user_id") % 7 != 0), F.concat(F.lit("u"), user)).alias("actor_id"),
        F.when(F.col("user_id") % 50 != 0, F.concat(F.lit("s"), user)).alias("session_id"),
        F.col("event_type").alias("type"),
        at.alias("occurred_at"),
        at.alias("received_at"),
        F.col("value").alias("score"),
        F.col("props").alias("payload"),
        F.lit("sdk").alias("source"),
    )


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events once, and every tenth a second time (``attempt`` 1)."""
    once = events(spark, sf_dir)
    again = once.filter(F.col("event_id").cast("long") % 10 == 0)
    return once.withColumn("attempt", F.lit(0)).unionByName(again.withColumn("attempt", F.lit(1)))


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries without repeats."""
    from emberlake.operators import dedup

    return dedup.first_sight(deliveries(spark, sf_dir), order=("attempt",)).drop("attempt")
