"""Event counts by minute and hour, and the bounded read of them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.functions import time


def count_events(events: DataFrame, grain: str) -> DataFrame:
    """(project_id, time_bucket, event_type, count) of events that were deduplicated before."""
    keys = ("project_id", time.bucket(F.col("occurred_at"), grain).alias("time_bucket"), F.col("type").alias("event_type"))
    return events.groupBy(*keys).agg(F.count("*").alias("count"))


def roll_up(by_minute: DataFrame) -> DataFrame:
    """Hour counts from minute counts: a minute bucket starts with its hour's."""
    keys = ("project_id", F.substring("time_bucket", 1, 13).alias("time_bucket"), "event_type")
    return by_minute.groupBy(*keys).agg(F.sum("count").alias("count"))


def read_counts(view: DataFrame, project_id: str, start: str | datetime, end: str | datetime, grain: str = "hour", event_type: str | None = None) -> DataFrame:
    """Whole buckets of a window, newest first and types ascending inside. The window's width is bounded."""
    low, high = time.checked_window(start, end, grain)
    names = time.driver_bucket(low, grain), time.driver_bucket(high, grain)
    found = view.filter((F.col("project_id") == project_id) & F.col("time_bucket").between(*names))
    if event_type is not None:
        found = found.filter(F.col("event_type") == event_type)
    return found.orderBy(F.desc("time_bucket"), F.asc("event_type"))


def nested_counts(found: DataFrame) -> DataFrame:
    """One row for each project with ``buckets``: structs (time_bucket, event_type, count), newest first."""
    order = F.sort_array(F.collect_list(F.struct("time_bucket", "event_type", "count")), asc=True)
    # newest bucket first, then types ascending: sort on the type first, then stably on the bucket
    newest = F.array_sort(order, lambda a, b: F.when(a["time_bucket"] > b["time_bucket"], -1).when(a["time_bucket"] < b["time_bucket"], 1).when(a["event_type"] < b["event_type"], -1).when(a["event_type"] > b["event_type"], 1).otherwise(0))
    return found.groupBy("project_id").agg(newest.alias("buckets"))
