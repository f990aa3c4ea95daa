"""Time buckets and bucket arithmetic. Sessions run in UTC; strings are read as ISO 8601 with an offset."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date, time, optional fraction, and Z or an offset.
ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
UNIT_MS = {"minute": 60_000, "hour": 3_600_000}
MOST_BUCKETS = {"minute": 1440, "hour": 168}


def parse_iso(text: Column) -> Column:
    """A timestamp, or null where the text isn't ISO 8601 with an offset. Never throws under ANSI."""
    return F.when(text.rlike(ISO), F.try_to_timestamp(text))


def _known(ts: Column, clock: Column | None) -> Column:
    return F.coalesce(ts, F.current_timestamp() if clock is None else clock)


def hour_bucket(ts: Column, clock: Column | None = None) -> Column:
    """``yyyy-MM-ddTHH`` of a timestamp; a missing one falls into the current hour."""
    return F.date_format(_known(ts, clock), "yyyy-MM-dd'T'HH")


def minute_bucket(ts: Column, clock: Column | None = None) -> Column:
    return F.date_format(_known(ts, clock), "yyyy-MM-dd'T'HH:mm")


def day_period(ts: Column, clock: Column | None = None) -> Column:
    return F.date_format(_known(ts, clock), "yyyy-MM-dd")


def bucket(ts: Column, grain: str) -> Column:
    return {"minute": minute_bucket, "hour": hour_bucket}[grain](ts)


def span_count(start: Column, end: Column, grain: str) -> Column:
    """How many buckets the window touches, both ends included; 0 if it is reversed or an end is null."""
    unit = F.lit(UNIT_MS[grain])
    n = F.floor(F.unix_millis(end) / unit) - F.floor(F.unix_millis(start) / unit) + 1
    return F.when(start.isNull() | end.isNull() | (start > end), F.lit(0)).otherwise(n).cast("long")


def bucket_range(start: Column, end: Column, grain: str) -> Column:
    """The bucket names of the window, newest first; an empty array if it is reversed."""
    low, high = F.date_trunc(grain, start), F.date_trunc(grain, end)
    names = F.transform(F.sequence(high, low, F.expr(f"interval -1 {grain}")), lambda t: bucket(t, grain))
    return F.when(start <= end, names).otherwise(F.array().cast("array<string>"))


def instant(value: str | datetime) -> datetime:
    """A window's end as the caller gave it, in UTC; text must be ISO 8601 with an offset."""
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    if value.tzinfo is None:
        raise ValueError(f"{value}: an offset is needed")
    return value.astimezone(timezone.utc)


def driver_bucket(value: datetime, grain: str) -> str:
    return value.strftime("%Y-%m-%dT%H" if grain == "hour" else "%Y-%m-%dT%H:%M")


def checked_window(start: str | datetime, end: str | datetime, grain: str) -> tuple[datetime, datetime]:
    """Both ends, refused if reversed or wider than a query may ask: counted by arithmetic, without listing buckets."""
    low, high = instant(start), instant(end)
    if low > high:
        raise ValueError("the window is reversed")
    unit = UNIT_MS[grain] // 1000
    if (n := int(high.timestamp() // unit - low.timestamp() // unit + 1)) > MOST_BUCKETS[grain]:
        raise ValueError(f"{n} {grain} buckets; at most {MOST_BUCKETS[grain]} are allowed")
    return low, high
