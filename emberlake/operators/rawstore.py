"""The hour-bucketed raw store: idempotent writes, newest-first windows and paging."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake import schema
from emberlake.functions import cursor, time
from emberlake.operators import dedup

KEY = ("project_id", "time_bucket", "occurred_at", "event_id")


def raw_rows(events: DataFrame) -> DataFrame:
    """Events as raw rows: times cut to milliseconds, ids in lower case, the hour as ``time_bucket``."""
    ms = events.withColumns({c: F.date_trunc("millisecond", c) for c in ("occurred_at", "received_at")})
    named = ms.withColumns({"event_id": F.lower("event_id"), "time_bucket": time.hour_bucket(F.col("occurred_at"))})
    return named.select(*(F.col(f.name).cast(f.dataType) for f in schema.RAW))


def upsert_raw(old: DataFrame, new: DataFrame) -> DataFrame:
    """A row of ``new`` replaces the row of its full key; an event with two times is two rows."""
    return dedup.upsert(old, dedup.last_write(new, KEY, ["received_at", "payload"]), KEY, [])


def window(raw: DataFrame, project_id: str, start: str | datetime, end: str | datetime) -> DataFrame:
    """Rows of an event-time window, both ends included, found by bucket first so that partitions are pruned."""
    low, high = time.checked_window(start, end, "hour")
    buckets = F.col("time_bucket").between(time.driver_bucket(low, "hour"), time.driver_bucket(high, "hour"))
    return raw.filter((F.col("project_id") == project_id) & buckets & F.col("occurred_at").between(F.lit(low), F.lit(high)))


def _after(rows: DataFrame, start: str | datetime, end: str | datetime, after: str | None) -> tuple[DataFrame, str | None]:
    """The rows behind a cursor, and its hour; hours that were read are pruned by their name."""
    if after is None:
        return rows, None
    bucket, at, event_id = cursor.decode(after)
    low, high = time.checked_window(start, end, "hour")
    if not time.driver_bucket(low, "hour") <= bucket <= time.driver_bucket(high, "hour"):
        raise ValueError("the cursor is of another window")
    at = F.lit(time.instant(at))
    behind = (F.col("occurred_at") < at) | ((F.col("occurred_at") == at) & (F.col("event_id") > event_id))
    return rows.filter((F.col("time_bucket") <= bucket) & behind), bucket


def _newest_first() -> list[Column]:
    return [F.desc("occurred_at"), F.asc("event_id")]


def _of_keys(rows: DataFrame, first: DataFrame) -> DataFrame:
    """The last written rows of a few keys, newest first; ``first`` is bounded by a page's limit."""
    found = rows.join(F.broadcast(first), ["occurred_at", "event_id"], "left_semi")
    order = [c for c in ("batches", "received_at", "payload") if c in rows.columns]
    return dedup.last_write(found.select(*rows.columns), KEY, order).orderBy(*_newest_first())


def _first_rows(raw: DataFrame, project_id: str, start: str | datetime, end: str | datetime, n: int, after: str | None) -> DataFrame:
    """The first ``n`` keys are found from key columns alone, and only their rows are read whole, so ``raw`` may have several
    writes of a key."""
    rows, _ = _after(window(raw, project_id, start, end), start, end, after)
    first = rows.select("occurred_at", "event_id").distinct().orderBy(*_newest_first()).limit(n)
    return _of_keys(rows, first)


def check_limit(limit: int) -> int:
    if not 1 <= limit <= 1000:
        raise ValueError("limit is from 1 to 1000")
    return limit


def page_rows(raw: DataFrame, project_id: str, start: str | datetime, end: str | datetime, limit: int = 100, after: str | None = None) -> DataFrame:
    """The first ``limit`` rows of a window, newest first and ids ascending, after a cursor's row."""
    return _first_rows(raw, project_id, start, end, check_limit(limit), after)


def read_page(raw: DataFrame, project_id: str, start: str | datetime, end: str | datetime, limit: int = 100, after: str | None = None) -> tuple[list, str | None]:
    """The rows of a page and the cursor of the next, None at the end: one row more than the page is read to know."""
    stamped = _first_rows(raw, project_id, start, end, check_limit(limit) + 1, after).withColumn("__us", F.unix_micros("occurred_at"))
    found = stamped.collect()
    if len(found) <= limit:
        return found, None
    last = found[limit - 1]
    at = datetime.fromtimestamp(0, timezone.utc) + timedelta(microseconds=last["__us"])
    return found[:limit], cursor.encode(last["time_bucket"], at, last["event_id"])


def walk_page(folders: Mapping[str, Sequence[str]], read: Callable[[Sequence[str]], DataFrame], project_id: str, start: str | datetime, end: str | datetime, limit: int = 100, after: str | None = None) -> tuple[DataFrame, str | None]:
    """A page by walking hours, newest first: (its rows, the cursor of the next page or None at the end).

    ``folders`` has the paths of each hour that is there, and ``read`` reads some of them (``Batches.folders`` and
    ``Batches.read_folders``). One hour is read first, then twice as many each time, until the page is full: its keys alone
    come to the driver, ``limit`` + 1 at most. The rows are then read from the hours of these keys.
    """
    low, high = time.checked_window(start, end, "hour")
    hours = [h for h in sorted(folders, reverse=True) if time.driver_bucket(low, "hour") <= h <= time.driver_bucket(high, "hour")]
    spark = SparkSession.active()

    def wanted(names: Sequence[str]) -> DataFrame:
        rows = window(read([p for h in names for p in folders[h]]), project_id, start, end)
        return _after(rows, start, end, after)[0]

    if after is not None:
        _, last = _after(read([]), start, end, after)
        hours = [h for h in hours if h <= last]
    found, step = [], 1
    while hours and len(found) <= check_limit(limit):
        now, hours, step = hours[:step], hours[step:], 2 * step
        keys = wanted(now).select("time_bucket", F.unix_micros("occurred_at").alias("us"), "occurred_at", "event_id").distinct()
        found += keys.orderBy(*_newest_first()).limit(limit + 1 - len(found)).select("time_bucket", "us", "event_id").collect()
    page = found[:limit]
    names = sorted({r["time_bucket"] for r in page}, reverse=True)
    first = spark.createDataFrame([(r["us"], r["event_id"]) for r in page], "us long, event_id string").select(F.timestamp_micros("us").alias("occurred_at"), "event_id")
    rows = _of_keys(wanted(names), first)
    if len(found) <= limit:
        return rows, None
    at = datetime.fromtimestamp(0, timezone.utc) + timedelta(microseconds=page[-1]["us"])
    return rows, cursor.encode(page[-1]["time_bucket"], at, page[-1]["event_id"])


def envelope() -> Column:
    """A raw row as the JSON of an event: millisecond times, the current schema version, nulls left out."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.to_json(
        F.struct(
            F.col("event_id").alias("eventId"),
            F.col("project_id").alias("projectId"),
            F.lit(schema.SCHEMA_VERSION).alias("schemaVersion"),
            "type",
            stamp("occurred_at").alias("occurredAt"),
            stamp("received_at").alias("receivedAt"),
            F.coalesce(F.try_parse_json("payload"), F.parse_json(F.lit("{}"))).alias("payload"),
            F.col("session_id").alias("sessionId"),
            F.col("actor_id").alias("actorId"),
            "source",
        )
    )


def unexpired(raw: DataFrame, written_at: Column, as_of: Column, days: int = 30) -> DataFrame:
    """Rows written less than ``days`` ago."""
    return raw.filter(written_at >= as_of - F.make_interval(days=F.lit(days)))
