from __future__ import annotations

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from emberlake.operators import counts, dedup, funnel, leaderboard, quota, rawstore, reconcile, retention


def at(text: str) -> datetime:
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def events(spark, data):
    """(event_id, project_id, type, occurred_at, actor_id, session_id, payload) rows, delivered in order."""
    full = [(*d, *(None,) * (7 - len(d)), k) for k, d in enumerate(data)]
    df = spark.createDataFrame([(a, b, c, at(t), e, f, g, k) for a, b, c, t, e, f, g, k in full], "event_id string, project_id string, type string, occurred_at timestamp, actor_id string, session_id string, payload string, offset long")
    return df.withColumns({"partition": F.lit(0), "received_at": F.col("occurred_at"), "source": F.lit(None).cast("string")})


def test_counts(spark):
    day = "2026-05-30T"
    data = [("1", "level_complete", "15:16:05"), ("2", "level_complete", "15:16:30"), ("3", "level_complete", "15:16:59"), ("4", "level_complete", "15:17:10"), ("5", "level_complete", "15:17:40"), ("6", "purchase", "15:16:45"), ("7", "level_complete", "16:05:00"), ("1", "level_complete", "15:16:05"), ("9", "session_start", "16:10:00")]
    fresh = dedup.first_sight(events(spark, [(i, "g", t, day + s) for i, t, s in data]))
    minute = counts.count_events(fresh, "minute")
    assert rows(minute, "time_bucket", "event_type", "count") == [(day + "15:16", "level_complete", 3), (day + "15:16", "purchase", 1), (day + "15:17", "level_complete", 2), (day + "16:05", "level_complete", 1), (day + "16:10", "session_start", 1)]
    hour = counts.count_events(fresh, "hour")
    assert rows(hour, "time_bucket", "event_type", "count") == [(day + "15", "level_complete", 5), (day + "15", "purchase", 1), (day + "16", "level_complete", 1), (day + "16", "session_start", 1)]
    assert reconcile.difference(hour, counts.roll_up(minute)).count() == 0
    read = counts.read_counts(hour, "g", "2026-05-30T15:30:00Z", "2026-05-30T16:00:00Z")
    assert [(r["time_bucket"][-2:], r["event_type"]) for r in read.collect()] == [("16", "level_complete"), ("16", "session_start"), ("15", "level_complete"), ("15", "purchase")]
    assert counts.read_counts(hour, "g", "2026-05-30T15:30:00Z", "2026-05-30T16:00:00Z", event_type="purchase").count() == 1
    assert counts.read_counts(hour, "other", "2026-05-30T15:30:00Z", "2026-05-30T16:00:00Z").count() == 0
    nested = counts.nested_counts(read).first()["buckets"]
    assert [b["time_bucket"][-2:] + b["event_type"] for b in nested] == ["16level_complete", "16session_start", "15level_complete", "15purchase"]


def score(player, value):
    return f'{{"playerId":{player},"score":{value}}}'


def test_leaderboard(spark):
    good = [('"p1"', 100), ('"p2"', 300), ('"p3"', 200), ('"p1"', 50), ('"p2"', 350), ('"zzz"', 1)]
    bad = ['{"score":1}', '{"playerId":"x"}', score("7", 5), score('""', 5), score('"x"', '"100"'), score('"x"', '"Infinity"'), score('"x"', '"NaN"'), "not json", None]
    payloads = [score(p, s) for p, s in good] + bad
    df = events(spark, [(str(k), "arena", "score", "2026-05-30T10:00:00", None, None, p) for k, p in enumerate(payloads)])
    board = leaderboard.best_scores(leaderboard.score_events(df))
    want = [("p1", 100.0), ("p2", 350.0), ("p3", 200.0), ("zzz", 1.0)]
    for period in ("alltime", "2026-05-30"):
        assert rows(board.filter(F.col("period") == period), "player_id", "score") == want
    assert [r["player_id"] for r in leaderboard.top_n(board, "arena").collect()] == ["p2", "p3", "p1", "zzz"]
    assert rows(leaderboard.player_rank(board, "arena", "p1"), "rank", "score") == [(3, 100.0)]
    assert leaderboard.player_rank(board, "arena", "nobody").count() == 0
    assert reconcile.difference(board, leaderboard.merge(board, board)).count() == 0


def test_leaderboard_ties_have_different_ranks(spark):
    board = spark.createDataFrame([("p", "alltime", "a", 10.0), ("p", "alltime", "b", 10.0)], "project_id string, period string, player_id string, score double")
    assert rows(leaderboard.ranked(board), "player_id", "rank") == [("a", 2), ("b", 1)]
    assert rows(leaderboard.player_rank(board, "p", "a"), "rank") == [(2,)]
    for limit in (0, 1001):
        with pytest.raises(ValueError):
            leaderboard.top_n(board, "p", limit=limit)


def test_ranks_over_many_ranges(spark):
    """A board of any size is ranked by several tasks, with a score that a third of all players have."""
    import random

    rng = random.Random(4)
    data = [(f"g{k % 2}", "alltime", f"p{k:05d}", 7.0 if k % 3 == 0 else float(rng.randrange(500))) for k in range(3000)]
    df = spark.createDataFrame(data, "project_id string, period string, player_id string, score double").repartition(5)
    got = leaderboard.ranked(df)
    assert got.columns == [*df.columns, "rank"]
    want = {}
    for project in ("g0", "g1"):
        board = sorted((r for r in data if r[0] == project), key=lambda r: (r[3], r[2]), reverse=True)
        want |= {r[2]: k for k, r in enumerate(board, 1)}
    assert {r["player_id"]: r["rank"] for r in got.collect()} == want
    assert leaderboard.ranked(df.limit(0)).count() == 0


STEPS = ["game_start", "level_complete", "purchase"]


def journeys(spark):
    data = [("a1", "game_start", "05-01T10:00"), ("a1", "level_complete", "05-01T10:05"), ("a1", "purchase", "05-02T09:00"), ("a2", "game_start", "05-01T11:00"), ("a2", "level_complete", "05-01T11:30"), ("a3", "game_start", "05-03T08:00"), ("a4", "game_start", "05-04T10:00"), ("a4", "purchase", "05-04T09:00"), ("a1", "game_start", "05-01T23:59"), (None, "game_start", "05-01T12:00")]
    return events(spark, [(str(k), "rpg", t, f"2026-{s}:00", a) for k, (a, t, s) in enumerate(data)])


def test_funnel(spark):
    state = funnel.first_seen(journeys(spark))
    may = ("2026-05-01T00:00:00Z", "2026-05-31T23:59:59Z")
    assert rows(funnel.funnel(state, "rpg", STEPS, *may), "step", "actors", "conversion_rate") == [(1, 4, 1.0), (2, 2, 0.5), (3, 1, 0.25)]
    assert reconcile.difference(state, funnel.merge(state, state)).count() == 0
    # first seen before the window: not in it, whatever came later
    assert rows(funnel.funnel(state, "rpg", STEPS, "2026-05-01T10:30:00Z", may[1]), "step", "actors") == [(1, 3), (2, 1), (3, 0)]
    assert rows(funnel.funnel(state, "nobody", STEPS, *may), "actors", "conversion_rate") == [(0, 0.0)] * 3
    with pytest.raises(ValueError):
        funnel.funnel(state, "rpg", STEPS, *reversed(may))


def test_equal_times_count_as_ordered(spark):
    state = funnel.first_seen(events(spark, [("1", "g", "a", "2026-05-01T10:00:00", "x"), ("2", "g", "b", "2026-05-01T10:00:00", "x")]))
    assert rows(funnel.funnel(state, "g", "a,b", "2026-05-01T00:00:00Z", "2026-05-02T00:00:00Z"), "actors") == [(1,), (1,)]


def test_retention(spark):
    days = {"a1": (1, 2, 3), "a2": (1, 3), "a3": (1,), "a4": (2, 3)}
    active = retention.active_days(events(spark, [(f"{a}{d}", "g", "play", f"2026-05-0{d}T10:00:00", a) for a, ds in days.items() for d in ds]))
    matrix = retention.retention_matrix(active, "g", "2026-05-01", "2026-05-02", 3)
    assert [tuple(r) for r in matrix.collect()] == [("2026-05-01", 0, 3), ("2026-05-01", 1, 1), ("2026-05-01", 2, 2), ("2026-05-02", 0, 1), ("2026-05-02", 1, 1)]
    assert rows(retention.nested_cohorts(matrix), "cohort", "size") == [("2026-05-01", 3), ("2026-05-02", 1)]
    # a4 was first active on the 2nd, so a range from the 3rd has no cohort at all
    assert retention.retention_matrix(active, "g", "2026-05-03", "2026-05-04").count() == 0
    for bad in (("2026-05-02", "2026-05-01"), ("2026-02-30", "2026-03-01"), ("2026-01-01", "2026-12-31")):
        with pytest.raises(ValueError):
            retention.retention_matrix(active, "g", *bad)


def raw_events(spark):
    times = ["15:30", "15:20", "15:10", "14:50", "14:40"]
    return rawstore.raw_rows(events(spark, [(str(k + 1), "game-1", "t", f"2026-05-30T{t}:00") for k, t in enumerate(times)]))


def test_raw_window_and_paging(spark):
    raw = raw_events(spark)
    window = ("game-1", "2026-05-30T14:00:00Z", "2026-05-30T15:59:59.999Z")
    assert [r["event_id"] for r in rawstore.page_rows(raw, *window).collect()] == list("12345")
    assert [r["event_id"] for r in rawstore.page_rows(raw, "game-1", "2026-05-30T15:00:00Z", window[2]).collect()] == list("123")
    got, after = [], None
    while True:
        page, after = rawstore.read_page(raw, *window, limit=2, after=after)
        got += [r["event_id"] for r in page]
        if after is None:
            break
    assert got == list("12345")
    for bad in ("garbage", "eyJiIjoxfQ"):
        with pytest.raises(ValueError):
            rawstore.page_rows(raw, *window, after=bad)
    _, other = rawstore.read_page(raw, *window, limit=2)
    with pytest.raises(ValueError, match="another window"):
        rawstore.page_rows(raw, "game-1", "2026-05-29T00:00:00Z", "2026-05-29T02:00:00Z", after=other)


def test_raw_upsert_is_idempotent(spark):
    raw = raw_events(spark)
    assert reconcile.difference(raw, rawstore.upsert_raw(raw, raw.unionByName(raw))).count() == 0


def test_token_bucket(spark):
    ms = [0, 0, 0, 500, 1000]
    df = spark.createDataFrame([(k, "key", t) for k, t in enumerate(ms)], "no int, api_key string, ms long").withColumn("received_at", F.timestamp_millis("ms"))
    got = quota.token_bucket(df, rate=1, burst=2, order=("no",)).orderBy("no").collect()
    assert [r["allowed"] for r in got] == [True, True, False, False, True]
    assert [r["retry_after_ms"] for r in got] == [0, 0, 1000, 500, 0]


def test_token_bucket_against_plain_loop(spark):
    import random

    rng = random.Random(3)
    data, t = [], 0
    for k in range(400):
        t += rng.choice([0, 10, 100, 900, 9000])
        data.append((k, rng.choice(["hot", "hot", "cold", None]), t))
    df = spark.createDataFrame(data, "no int, api_key string, ms long").withColumn("received_at", F.timestamp_millis("ms"))
    got = {r["no"]: r["allowed"] for r in quota.token_bucket(df, rate=2, burst=5, order=("no",)).collect()}
    state, want = {}, {}
    for no, key, now in data:
        tokens, before = state.get(key, (5.0, now))
        tokens = min(5.0, tokens + (now - before) * 2 / 1000)
        want[no] = tokens >= 1
        state[key] = (tokens - want[no], now)
    assert got == want


def test_reconcile(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "event_id string")
    assert reconcile.status(ids("a", "b"), ids("a")).first()["status"] == "loss"
    assert reconcile.status(ids("a"), ids("a", "a")).first()["status"] == "duplicates"
    assert reconcile.status(ids("a"), ids("a")).first()["status"] == "clean"
    assert rows(reconcile.lost(ids("a", "b"), ids("a")), "event_id") == [("b",)]
    assert rows(reconcile.repeated(ids("a", "a", "b")), "event_id", "n") == [("a", 2)]


def test_matrix_from_bitmaps(spark):
    """The same as from days: over words, before 1970 alike, and with days that come late, twice, or before the first."""
    import random

    rng = random.Random(9)
    days = [(f"a{a}", f"{y}-{m:02d}-{rng.randrange(1, 29):02d}") for a in range(60) for y, m in ((1969, 12), (2024, 1), (2024, 2), (2024, 3)) for _ in range(rng.randrange(4)) if y > 2000 or a < 3]
    made = lambda rows: spark.createDataFrame([("g", a, d) for a, d in rows], "project_id string, actor_id string, day string").select("project_id", "actor_id", F.to_date("day").alias("active_period"))
    rng.shuffle(days)
    half = len(days) // 2
    words = retention.merge_words(retention.day_words(made(days[:half])), retention.day_words(made(days[half // 2 :])))
    for start, end, most in (("2024-01-01", "2024-03-31", 90), ("2024-01-10", "2024-01-12", 0), ("1969-12-01", "1969-12-31", 7)):
        want = retention.retention_matrix(made(days).distinct(), "g", start, end, most).collect()
        assert retention.matrix_from_words(words, "g", start, end, most).collect() == want and want


def test_difference_by_digests(spark):
    """As by rows: lost, repeated and changed rows, nulls that change places, and equal states that move no rows."""
    rows = [(k % 40, None if k % 7 == 0 else str(k), k) for k in range(600)]
    state = spark.createDataFrame(rows, "key long, text string, n long")
    other = spark.createDataFrame([*rows[5:], rows[9], rows[9], (3, "new", 1), (None, "3", 3)], "key long, text string, n long")
    sort = lambda df: sorted(map(str, df.collect()))
    assert sort(reconcile.difference_by_digests(state, other, ["key"])) == sort(reconcile.difference(state, other))
    swapped = spark.createDataFrame([(1, None)], "a int, b int"), spark.createDataFrame([(None, 1)], "a int, b int")
    assert reconcile.difference_by_digests(*swapped, ["a"]).count() == 2
    assert reconcile.ranges_apart(state, state.repartition(7), ["key"], 10) == []
    same = reconcile.difference_by_digests(state, state.repartition(7), ["key"])
    assert same.count() == 0 and "LogicalRDD" not in same._jdf.queryExecution().optimizedPlan().toString()  # nothing is read
    assert 0 < len(reconcile.ranges_apart(state, other, ["key"], 10)) <= 40
