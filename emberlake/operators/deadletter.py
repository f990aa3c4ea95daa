"""Dead letters: records that could not be processed, their triage and their replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake import schema


def _source() -> Column:
    return F.struct("topic", "partition", F.col("offset").cast("string").alias("offset"), "key")


def _shaped(rows: DataFrame, original: Column, event: Column, kind: str, reason: Column, attempts: int, failed_at: Column) -> DataFrame:
    made = rows.select(original.alias("originalValue"), event.alias("originalEvent"), F.struct(F.lit(kind).alias("kind"), reason.alias("reason")).alias("error"), F.lit(attempts).alias("attempts"), failed_at.alias("failedAt"), _source().alias("source"))
    return made.select(*(F.col(f.name).cast(f.dataType) for f in schema.DEAD_LETTER))


def of_invalid(records: DataFrame, failed_at: Column, value: str = "value") -> DataFrame:
    """Dead letters of records with ``issues``: the value as it came, no event, one attempt."""
    reason = F.array_join(F.transform("issues", lambda x: F.concat_ws(": ", x["field"], x["reason"])), "; ")
    return _shaped(records, F.col(value), F.lit(None).cast("string"), "validation", reason, 1, failed_at)


def of_failed(records: DataFrame, event_json: Column, reason: str, failed_at: Column, attempts: int = 3) -> DataFrame:
    """Dead letters of valid events that could not be stored; these can be replayed."""
    return _shaped(records, event_json, event_json, "persistence", F.lit(reason), attempts, failed_at)


def message_key(letters: DataFrame) -> DataFrame:
    """With ``key``: the source record's, else the event's project."""
    return letters.withColumn("key", F.coalesce("source.key", F.try_variant_get(F.try_parse_json("originalEvent"), "$.projectId", "string")))


def triage(letters: DataFrame) -> DataFrame:
    return letters.groupBy(F.col("error.kind").alias("kind")).agg(F.count("*").alias("n"))


def replayable(letters: DataFrame) -> DataFrame:
    """Log records (key, value) of failures to store, keyed by project; invalid records can't be replayed as they stand."""
    kept = letters.filter("error.kind = 'persistence' and originalEvent is not null")
    return kept.select(F.try_variant_get(F.try_parse_json("originalEvent"), "$.projectId", "string").alias("key"), F.col("originalEvent").alias("value"))
