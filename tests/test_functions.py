from __future__ import annotations

from datetime import datetime, timezone

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberlake.functions import cursor, keys, time
from emberlake.operators import funnel, leaderboard


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "hour", "minute"),
    [
        ("2026-05-30T15:16:50.165Z", "2026-05-30T15", "2026-05-30T15:16"),
        ("2026-05-30T01:30:00.000+03:00", "2026-05-29T22", "2026-05-29T22:30"),
        ("2026-05-30T15:59:59.999Z", "2026-05-30T15", "2026-05-30T15:59"),
        (None, "2026-01-02T09", "2026-01-02T09:45"),
        ("not-a-date", "2026-01-02T09", "2026-01-02T09:45"),
    ],
)
def test_buckets(spark, text, hour, minute):
    clock = F.lit("2026-01-02 09:45:00").cast("timestamp")
    ts = time.parse_iso(F.lit(text).cast("string"))
    assert one(spark, time.hour_bucket(ts, clock)) == hour
    assert one(spark, time.minute_bucket(ts, clock)) == minute
    assert one(spark, time.day_period(ts, clock)) == hour[:10]


def test_time_without_offset_is_refused(spark):
    assert one(spark, time.parse_iso(F.lit("2026-05-30T10:00:00"))) is None
    assert one(spark, time.parse_iso(F.lit("30/05/2026"))) is None


def test_bucket_range(spark):
    ts = lambda s: time.parse_iso(F.lit(s))
    a, b = ts("2026-05-30T13:30:00Z"), ts("2026-05-30T15:10:00Z")
    assert one(spark, time.bucket_range(a, b, "hour")) == ["2026-05-30T15", "2026-05-30T14", "2026-05-30T13"]
    assert one(spark, time.bucket_range(b, a, "hour")) == []
    assert one(spark, time.span_count(a, b, "hour")) == 3
    assert one(spark, time.span_count(b, a, "hour")) == 0
    assert one(spark, time.span_count(F.lit(None).cast("timestamp"), a, "hour")) == 0
    night = time.bucket_range(ts("2026-05-29T23:00:00Z"), ts("2026-05-30T01:00:00Z"), "hour")
    assert one(spark, night) == ["2026-05-30T01", "2026-05-30T00", "2026-05-29T23"]
    assert one(spark, F.size(time.bucket_range(a, b, "minute"))) == one(spark, time.span_count(a, b, "minute")) == 101


def test_window_bounds():
    with pytest.raises(ValueError, match="reversed"):
        time.checked_window("2026-05-30T11:00:00Z", "2026-05-30T10:00:00Z", "hour")
    with pytest.raises(ValueError, match="minute buckets"):
        time.checked_window("2026-05-30T00:00:00Z", "2026-05-31T23:00:00Z", "minute")
    with pytest.raises(ValueError, match="hour buckets"):
        time.checked_window("2026-05-01T00:00:00Z", "2026-05-08T00:00:00Z", "hour")
    time.checked_window("2026-05-01T00:00:00Z", "2026-05-07T23:59:59Z", "hour")


def test_api_key_parts(spark):
    for bad in ("no-dot", ".secret", "cas_abc.", "nope_abc.secret", None):
        assert one(spark, keys.api_key_parts(F.lit(bad).cast("string"))) is None
    got = one(spark, keys.api_key_parts(F.lit("cas_abc.se.cret")))
    assert (got["prefix"], got["secret"]) == ("cas_abc", "se.cret")


def test_small_scalars(spark):
    assert one(spark, keys.retry_seconds(F.lit(0))) == 1
    assert one(spark, keys.retry_seconds(F.lit(1001))) == 2
    assert one(spark, keys.round4(F.lit(1 / 3))) == 0.3333
    assert one(spark, keys.board_key(F.lit("p"), F.lit("alltime"))) == "lb:p:alltime"
    assert one(spark, keys.partition_key(F.lit("s"), F.lit("a"), F.lit("e"))) == "s"
    assert one(spark, keys.partition_key(F.lit(None), F.lit(None), F.lit("e"))) == "e"


@given(st.text(max_size=20), st.datetimes(timezones=st.just(timezone.utc)))
def test_cursor_round_trip(event_id, at):
    assert cursor.decode(cursor.encode("2026-05-30T10", at, event_id)) == ("2026-05-30T10", at, event_id)


@given(st.text(max_size=30))
def test_malformed_cursors_are_errors(text):
    try:
        bucket, at, event_id = cursor.decode(text)
    except ValueError:
        return
    assert isinstance(at, datetime)


def test_argument_checks():
    assert funnel.parse_steps(" a, b ,,c") == ["a", "b", "c"]
    for bad in ("a", "a,a", ",".join("abcdefghijk")):
        with pytest.raises(ValueError, match="funnel"):
            funnel.parse_steps(bad)
    assert leaderboard.check_period("2026-05-30") == "2026-05-30"
    for bad in ("daily", "2026-13-01"):
        with pytest.raises(ValueError):
            leaderboard.check_period(bad)


def test_key_hash_is_that_of_the_log(spark):
    """Published values of the hash for some keys, as signed numbers."""
    known = {"21": -973932308, "foobar": -790332482, "a-little-bit-long-string": -985981536, "a-little-bit-longer-string": -1486304829, "abc": 479470107}
    rows = spark.createDataFrame([(k,) for k in known], "key string").select("key", keys.key_hash(F.col("key")).alias("h"), keys.key_partition(F.col("key"), 6).alias("p")).collect()
    assert {r["key"]: r["h"] - (1 << 32) * (r["h"] >> 31) for r in rows} == known
    assert all(r["p"] == (r["h"] & 0x7FFFFFFF) % 6 for r in rows)


def test_appended_log_has_dense_offsets(spark, tmp_path):
    from emberlake.sources import log
    from emberlake.sources.tables import accepted

    events = accepted(spark, "/root/testdata/sf0.001").withColumn("session_id", F.when(F.col("event_id").cast("long") % 3 == 0, "hot").otherwise(F.col("session_id")))
    for k in range(3):
        log.append_log(spark, events.filter(F.col("event_id").cast("long") % 3 == k), f"file://{tmp_path}/log", 4)
    read = log.replay_files(spark, f"file://{tmp_path}/log")
    rows = read.groupBy("partition").agg(F.collect_list("offset").alias("o")).collect()
    assert all(sorted(r["o"]) == list(range(len(r["o"]))) for r in rows) and sum(len(r["o"]) for r in rows) == events.count()
    assert read.groupBy("key").agg(F.count_distinct("partition").alias("n")).agg(F.max("n")).first()[0] == 1
    late = read.filter("key = 'hot'").select("offset", F.get_json_object("value", "$.occurredAt").alias("at")).orderBy("offset").collect()
    assert [r["at"] for r in late] == sorted(r["at"] for r in late)
