"""Registered queries against their SQL in DuckDB, and what their plans must show."""

from __future__ import annotations

import math

import duckdb
import pytest

from emberlake.plans import oracles, queries

SF = "/root/testdata/sf0.001"
#: Streams of one view each; the reader of all views and the replay are run.
SLOW = {"stream_counts_hour", "stream_funnel_conversion", "stream_raw", "stream_leaderboard", "stream_retention"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF}/events.parquet')")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", [n for n in oracles.ORACLES if n not in SLOW])
def test_against_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(oracles.ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    a = ordered(tuple(r[c] for c in columns) for r in got.collect())
    b = ordered(tuple(r[k] for k in at) for r in want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(math.isclose(p, q, rel_tol=1e-12) if isinstance(p, float) and isinstance(q, float) else p == q for p, q in zip(x, y, strict=True))


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(oracles.ORACLES)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_push_filters_and_stay_native(spark):
    for name in ("counts_hour", "leaderboard_alltime", "funnel_conversion", "retention_matrix", "ingest_verdicts"):
        text = plan(queries.QUERIES[name](spark, SF))
        assert "Python" not in text and "CartesianProduct" not in text
    board = plan(queries.leaderboard_daily(spark, SF))
    assert "WindowGroupLimit" in board  # later ranks are cut before the shuffle
    assert "TakeOrderedAndProject" in plan(queries.raw_window(spark, SF))


def test_analytics_read_views_only(spark, tmp_path):
    """Funnels, retention and counts over stored views touch no raw event."""
    from emberlake.operators import counts, funnel
    from emberlake.sources import tables

    events = tables.accepted(spark, SF)
    funnel.first_seen(events).write.partitionBy("project_id").parquet(f"{tmp_path}/steps")
    counts.count_events(events, "hour").write.partitionBy("project_id").parquet(f"{tmp_path}/hours")
    text = plan(funnel.funnel(spark.read.parquet(f"{tmp_path}/steps"), "game-1", queries.STEPS, *queries.MONTH))
    assert "events.parquet" not in text and "PartitionFilters: [isnotnull(project_id" in text and "PushedFilters: [IsNotNull(first_seen_at)" in text
    text = plan(counts.read_counts(spark.read.parquet(f"{tmp_path}/hours"), "game-1", *queries.DAY))
    assert "GreaterThanOrEqual(time_bucket" in text and "PartitionFilters: [isnotnull(project_id" in text
