from __future__ import annotations

import json
import time as clock
import uuid

import pytest
from pyspark.sql import functions as F

from emberlake.operators import counts, deadletter, dedup, envelope, funnel, leaderboard, rawstore, reconcile, retention
from emberlake.sources import log
from emberlake.streaming import windows
from emberlake.streaming.views import Views, rebuild, with_retry


def envelope_text(k, kind="level_complete", at="2026-05-30T15:16:05.000Z", actor="a1", **more):
    return json.dumps({"eventId": str(uuid.UUID(int=k)), "projectId": "g", "type": kind, "occurredAt": at, "receivedAt": at, "payload": {"playerId": f"p{k % 3}", "score": k}, "actorId": actor, **more})


TEXTS = [
    envelope_text(1, at="2026-05-30T15:17:30.000Z"),
    envelope_text(2, at="2026-05-30T15:16:30.000Z"),
    envelope_text(3, at="2026-05-30T14:59:00.000Z", actor="a2"),
    "this-is-not-json",
    envelope_text(4, "purchase"),
    envelope_text(2, at="2026-05-30T15:16:30.000Z"),
    envelope_text(5, "session_start", "2026-05-31T00:18:00.000Z"),
    envelope_text(1, at="2026-05-30T15:17:30.000Z"),
]


def records(spark, texts, start=0):
    rows = [(None, t, "raw-events", 0, start + k) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "key string, value string, topic string, partition int, offset long")


def state(views):
    return {"hour": views.by_hour.state(), "minute": views.by_minute.state(), "board": views.board.state(), "steps": views.steps.state(), "days": views.days.state(), "raw": views.raw.state()}


def same(a, b):
    return all(reconcile.difference(x, b[name]).count() == 0 for name, x in a.items())


def batch_state(spark):
    good, _ = envelope.split(records(spark, TEXTS))
    fresh = dedup.first_sight(good)
    return {"hour": counts.count_events(fresh, "hour"), "minute": counts.count_events(fresh, "minute"), "board": leaderboard.best_scores(leaderboard.score_events(fresh)), "steps": funnel.first_seen(fresh), "days": retention.active_days(fresh), "raw": rawstore.raw_rows(fresh)}


def test_stream_equals_batch(spark, tmp_path):
    for k in range(2):  # two files, one batch each: duplicates cross batches
        records(spark, TEXTS[4 * k : 4 * k + 4], 4 * k).coalesce(1).write.mode("append").json(f"{tmp_path}/log")
    views = Views(spark, f"file://{tmp_path}/views")
    views.run(log.stream_files(spark, f"{tmp_path}/log", files_per_batch=1), f"{tmp_path}/checkpoint").awaitTermination()
    got = state(views)
    assert same(got, batch_state(spark))
    assert {(r["time_bucket"], r["event_type"]): r["count"] for r in got["hour"].collect()} == {("2026-05-30T15", "level_complete"): 2, ("2026-05-30T14", "level_complete"): 1, ("2026-05-30T15", "purchase"): 1, ("2026-05-31T00", "session_start"): 1}
    letters = views.letters.read().collect()
    assert [(r["error"]["kind"], r["attempts"], r["originalValue"]) for r in letters] == [("validation", 1, "this-is-not-json")]
    assert same(state(rebuild(spark, f"file://{tmp_path}/again", log.replay_files(spark, f"{tmp_path}/log"))), got)


def test_a_batch_applied_twice_changes_nothing(spark, tmp_path):
    views = Views(spark, f"file://{tmp_path}/views")
    views.apply(records(spark, TEXTS), 0)
    views.apply(records(spark, TEXTS), 0)
    views.apply(records(spark, TEXTS, 100), 1)
    assert same(state(views), batch_state(spark))


def test_folds_change_nothing(spark, tmp_path):
    views = Views(spark, f"file://{tmp_path}/views")
    for k in range(4):
        views.apply(records(spark, TEXTS[2 * k : 2 * k + 2], 2 * k), k)
    want = batch_state(spark)
    assert len(views.by_hour.parts()) > 2 and same(state(views), want)
    views.fold(1)
    assert same(state(views), want)
    views.apply(records(spark, TEXTS[6:8], 6), 3)  # a batch after the fold comes again
    views.fold(3)
    assert len(views.by_hour.parts()) == 1 and same(state(views), want)
    views.by_hour.put(views.by_hour.state(), 2)  # what a fold cut short would leave behind: a part that the fold contains
    assert same(state(views), want)


def test_a_batch_reads_its_own_parts_only(spark, tmp_path):
    views = Views(spark, f"file://{tmp_path}/views")
    for k in range(3):
        views.apply(records(spark, TEXTS[2 * k : 2 * k + 2], 2 * k), k)
    assert views.accepted.values() == []  # gone once the batch was written
    hour = views.raw.state().filter("project_id = 'g' and time_bucket = '2026-05-30T15'")
    text = hour._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(time_bucket" in text  # by the hour's folders


def test_dedup_horizon(spark, tmp_path):
    from datetime import date

    today = [date(2026, 6, 1)]
    views = Views(spark, f"file://{tmp_path}/views", horizon_days=3, only=["counts"], today=lambda: today[0])
    n = lambda: views.by_hour.state().agg(F.sum("count")).first()[0]
    views.apply(records(spark, TEXTS[:1]), 0)
    today[0] = date(2026, 6, 4)
    views.apply(records(spark, TEXTS[:2]), 1)  # within the horizon: one of the two is new
    assert n() == 2
    today[0] = date(2026, 6, 5)
    views.apply(records(spark, TEXTS[:2]), 2)  # the first sight of one is beyond it
    assert n() == 3 and views.seen.values() == ["2026-06-04", "2026-06-05"]


def test_failed_batch_is_dead_lettered_and_replayed(spark, tmp_path):
    waits = []
    views = Views(spark, f"file://{tmp_path}/views", sleep=waits.append)
    real, views._funnel = views._funnel, lambda events, batch_id: 1 / 0
    views.apply(records(spark, TEXTS), 0)
    assert waits == [0.2, 0.4]
    letters = views.letters.read().filter("error.kind = 'persistence'")
    assert letters.count() == 5 and {r["attempts"] for r in letters.collect()} == {3}
    views._funnel = real
    again = deadletter.replayable(letters).withColumns({"topic": F.lit("replay"), "partition": F.lit(0), "offset": F.monotonically_increasing_id()})
    views.apply(again, 1)
    assert same(state(views), batch_state(spark))


def test_retry():
    calls, waits = [], []

    def work():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("down")

    with_retry("x", work, sleep=waits.append)
    assert len(calls) == 3 and waits == [0.2, 0.4]
    with pytest.raises(ZeroDivisionError):
        with_retry("x", lambda: 1 / 0, sleep=waits.append)


def stream_of(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")


def processed(q):
    """Waits until the query has read its files, then stops it: processing-time timeouts keep it busy, so it never comes to rest."""
    try:
        until = clock.time() + 120
        while not any(p["numInputRows"] for p in q.recentProgress) and q.isActive and clock.time() < until:
            clock.sleep(0.2)
    finally:
        q.stop()


def run(spark, df, tmp_path, mode):
    name = f"q{uuid.uuid4().hex}"
    processed(df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp").start())
    return spark.table(name)


def test_tumbling_counts(spark, tmp_path):
    rows = [("g", "a", f"2026-05-30 15:1{m}:10") for m in (1, 1, 2)]
    df = stream_of(spark, tmp_path, rows, "project_id string, type string, at string").withColumn("occurred_at", F.col("at").cast("timestamp"))
    got = run(spark, windows.tumbling_counts(df, "minute", "40 days"), tmp_path, "update").collect()
    assert sorted((r["time_bucket"], r["count"]) for r in got) == [("2026-05-30T15:11", 2), ("2026-05-30T15:12", 1)]


def test_stream_dedup(spark, tmp_path):
    rows = [("1", "2026-05-30 15:00:00"), ("1", "2026-05-30 15:00:01"), ("2", "2026-05-30 15:00:02")]
    df = stream_of(spark, tmp_path, rows, "event_id string, at string").withColumn("occurred_at", F.col("at").cast("timestamp"))
    assert sorted(r["event_id"] for r in run(spark, windows.dedup_within(df, "1 hour"), tmp_path / "a", "append").collect()) == ["1", "2"]
    assert sorted(r["event_id"] for r in run(spark, windows.dedup_with_ttl(df, 60_000), tmp_path / "b", "append").collect()) == ["1", "2"]


def test_stream_dedup_with_ttl_over_batches(spark, tmp_path):
    """A duplicate inside the time to live, one after it, and one in a trigger that is longer than it."""
    schema = "event_id string, no int"
    source = f"{tmp_path}/in"
    put = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)
    put(("a", 0))
    df = spark.readStream.schema(schema).parquet(source)

    def drain(ttl):
        q = windows.dedup_with_ttl(df, ttl).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()
        processed(q)
        return sorted(r["no"] for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert drain(600_000) == [0]
    put(("a", 1), ("b", 2), ("b", 2))
    assert drain(600_000) == [0, 2]  # a again within ten minutes
    clock.sleep(1.5)
    put(("a", 3), ("b", 4))
    # a trigger after the time to live (now one second): data and timeout of both keys in one batch
    assert drain(1_000) == [0, 2, 3, 4]


def test_stream_token_bucket(spark, tmp_path):
    rows = [(k, "key", f"2026-05-30 15:00:0{s}") for k, s in enumerate(("0.000", "0.000", "0.000", "0.500", "1.000"))]
    df = stream_of(spark, tmp_path, rows, "no int, api_key string, at string").withColumn("received_at", F.col("at").cast("timestamp"))
    got = run(spark, windows.token_bucket(df, 1, 2), tmp_path, "append").orderBy("no").collect()
    assert [r["allowed"] for r in got] == [True, True, False, False, True]
    assert [r["retry_after_ms"] for r in got] == [0, 0, 1000, 500, 0]


def test_keyed_log(spark, tmp_path):
    good, _ = envelope.split(records(spark, TEXTS))
    log.write_log(dedup.first_sight(good), f"{tmp_path}/log", 3)
    back = spark.read.json(f"{tmp_path}/log")
    assert {r["key"] for r in back.collect()} == {"a1", "a2"} and back.count() == 5
    assert envelope.parsed(back).filter("event is null").count() == 0


class Died(BaseException):
    """What no retry catches: the process is gone."""


def test_readers_see_a_batch_whole_or_not_at_all(spark, tmp_path):
    """A writer that dies after each table in turn leaves all views as they were; run again, they are as they should be."""
    views = Views(spark, f"file://{tmp_path}/views")
    views.apply(records(spark, TEXTS[:4]), 0)
    before = {name: rows.collect() for name, rows in views.states().items()}
    letters = views.dead_letters().collect()
    for table in (*views._kept(), views.seen):
        real = table.overwrite

        def dying(rows, *order, real=real):
            real(rows, *order)
            raise Died

        table.overwrite = dying
        with pytest.raises(Died):
            views.apply(records(spark, TEXTS[4:], 4), 1)
        table.overwrite = real
        assert len(views._kept()) == 7 and {name: rows.collect() for name, rows in views.states().items()} == before
        assert views.dead_letters().collect() == letters
    views.apply(records(spark, TEXTS[4:], 4), 1)
    assert same(state(views), batch_state(spark))


def test_marks():
    from emberlake.streaming.store import Commits
    from pyspark.sql import SparkSession

    import tempfile

    commits = Commits(SparkSession.active(), f"file://{tempfile.mkdtemp()}/t")
    assert not commits.known()(0)
    for k in (0, 1, 2, 5):
        commits.mark(k)
    assert [k for k in range(8) if commits.known()(k)] == [0, 1, 2, 5]
    commits.compact(2)
    assert [k for k in range(8) if commits.known()(k)] == [0, 1, 2, 5] and len(commits._names()) == 2


def test_folds_by_tiers(spark, tmp_path):
    """Over 64 batches each row is rewritten a few times, few parts are left, and states are those of all batches."""
    from emberlake import schema
    from emberlake.streaming.store import Batches

    total = lambda rows: rows.groupBy("project_id", "time_bucket", "event_type").agg(F.sum("count").alias("count"))
    table = Batches(spark, f"file://{tmp_path}/t", "counts", schema.COUNTS, total)
    made = spark.range(64 * 50).select(F.lit("g").alias("project_id"), F.format_string("2024-01-01T%06d", "id").alias("time_bucket"), F.lit("t").alias("event_type"), F.lit(1).cast("long").alias("count"), "id").cache()
    rewritten = 0
    for k in range(64):
        table.put(made.filter(f"id div 50 = {k}").drop("id"), k)
        gone = table.fold(k)
        rewritten += 50 * sum(b - a + 1 for a, b in gone)
    assert table.state().count() == 3200 == table.state().agg(F.sum("count")).first()[0]
    assert len(table.parts()) <= 8 and rewritten <= 3200 * 7


def test_keyed_dedup_over_batches_and_a_restart(spark, tmp_path):
    """Duplicates inside a batch, in the next one, after a restart from the checkpoint, and after the time to live."""
    views = Views(spark, f"file://{tmp_path}/views", ttl_ms=3_600_000)
    put = lambda texts, start: records(spark, texts, start).coalesce(1).write.mode("append").json(f"{tmp_path}/log")
    go = lambda v: v.run_keyed(log.stream_files(spark, f"{tmp_path}/log", files_per_batch=1), f"{tmp_path}/checkpoint").awaitTermination()
    put(TEXTS[:6], 0)
    go(views)
    put(TEXTS[4:], 10)
    again = Views(spark, f"file://{tmp_path}/views", ttl_ms=3_600_000)
    go(again)
    assert same(state(again), batch_state(spark)) and again.seen.values() == []
    short = Views(spark, f"file://{tmp_path}/short", ttl_ms=1)
    for k in range(2):
        records(spark, TEXTS[:1], k).coalesce(1).write.mode("append").json(f"{tmp_path}/again")
        short.run_keyed(log.stream_files(spark, f"{tmp_path}/again"), f"{tmp_path}/cp2").awaitTermination()
        clock.sleep(0.1)
    assert short.by_hour.state().agg(F.sum("count")).first()[0] == 2


def test_a_page_reads_no_more_hours_than_it_needs(spark, tmp_path):
    times = [f"2026-05-{d:02d}T{h:02d}:{m:02d}:00" for d in (29, 30) for h in range(24) for m in (5, 25, 45)]
    rows = [(str(uuid.UUID(int=k)), "g" if k % 4 else "other", t) for k, t in enumerate(times)]
    made = spark.createDataFrame(rows, "event_id string, project_id string, at string").select("event_id", "project_id", F.lit("t").alias("type"), F.col("at").cast("timestamp").alias("occurred_at"), F.col("at").cast("timestamp").alias("received_at"), F.lit("{}").alias("payload"), *(F.lit(None).cast("string").alias(c) for c in ("session_id", "actor_id", "source")))
    views = Views(spark, f"file://{tmp_path}/views", only=("raw",))
    for k in range(2):
        views.raw.put(rawstore.raw_rows(made.filter(f"minute(occurred_at) {'<' if k else '>'} 10")), k)
        views.commits.mark(k)
    folders, asked = views.raw.folders(), []

    def read(paths):
        asked.append({p.rsplit("=", 1)[1] for p in paths})
        return views.raw.read_folders(paths)

    window = ("g", "2026-05-29T00:00:00Z", "2026-05-30T23:59:59Z")
    page, after = rawstore.walk_page(folders, read, *window, limit=2)
    assert page.count() == 2 and after and set().union(*asked) == {"2026-05-30T23"}  # a full first hour is the only one read
    asked.clear()
    page, after = rawstore.walk_page(folders, read, *window, limit=4)
    assert page.count() == 4 and after and set().union(*asked) == {"2026-05-30T23", "2026-05-30T22", "2026-05-30T21"}
    asked.clear()
    one, _ = rawstore.walk_page(folders, read, "g", "2026-05-29T00:00:00Z", "2026-05-30T22:59:59Z", limit=1)
    assert one.count() == 1 and set().union(*asked) == {"2026-05-30T22"}
    got, after, n = [], None, 0
    while n == 0 or after:
        page, after = rawstore.walk_page(folders, views.raw.read_folders, *window, limit=7, after=after)
        got += [r["event_id"] for r in page.collect()]
        n += 1
    want = [r["event_id"] for r in rawstore.page_rows(rawstore.raw_rows(made), *window, limit=1000).collect()]
    assert got == want and len(want) == 108
    _, cursor = rawstore.walk_page(folders, read, *window, limit=2)
    plan = rawstore.page_rows(views.raw.state(), *window, after=cursor)._jdf.queryExecution().optimizedPlan().toString()
    assert "time_bucket" in plan and "<= 2026-05-30T23" in plan
    with pytest.raises(ValueError, match="another window"):
        rawstore.walk_page(folders, read, "g", "2026-05-28T00:00:00Z", "2026-05-28T02:00:00Z", after=cursor)
    assert rawstore.walk_page(folders, read, "nobody", *window[1:])[0].count() == 0
