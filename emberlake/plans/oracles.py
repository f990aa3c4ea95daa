"""SQL for the registered queries, as DuckDB runs it over the same tables."""

from __future__ import annotations

_ADAPTER = """
e AS (
  SELECT cast(event_id AS varchar) AS event_id, event_id AS n, 'game-' || cast(user_id % 4 AS varchar) AS project_id,
         'u' || cast(user_id AS varchar) AS player_id,
         CASE WHEN user_id % 50 = 0 OR user_id % 7 = 0 THEN NULL ELSE 'u' || cast(user_id AS varchar) END AS actor_id,
         CASE WHEN user_id % 50 = 0 THEN NULL ELSE 's' || cast(user_id AS varchar) END AS session_id,
         event_type AS type, cast(ts AS timestamp) AS occurred_at, value AS score, props AS payload
  FROM events),
d AS (SELECT *, 0 AS attempt FROM e UNION ALL SELECT *, 1 AS attempt FROM e WHERE n % 10 = 0),
a AS (SELECT * FROM d WHERE attempt = 0)"""

_COUNTS = "SELECT project_id, strftime(occurred_at, '{fmt}') AS time_bucket, type AS event_type, count(*) AS count FROM a GROUP BY ALL"
_HOUR, _MINUTE = _COUNTS.format(fmt="%Y-%m-%dT%H"), _COUNTS.format(fmt="%Y-%m-%dT%H:%M")
_BEST = "SELECT project_id, period, player_id, max(score) AS score FROM (SELECT project_id, unnest(['alltime', strftime(occurred_at, '%Y-%m-%d')]) AS period, player_id, score FROM {rows}) GROUP BY ALL"
_RANK = "row_number() OVER (PARTITION BY project_id, period ORDER BY score DESC, player_id DESC)"
_DAY = "project_id = 'game-1' AND time_bucket BETWEEN '2024-01-10T00' AND '2024-01-10T23'"
_STEPS = "SELECT project_id, coalesce(actor_id, session_id) AS actor_id, type AS event_type, min(occurred_at) AS first_seen_at FROM a WHERE coalesce(actor_id, session_id) IS NOT NULL GROUP BY ALL"
_DAYS = "SELECT DISTINCT project_id, coalesce(actor_id, session_id) AS actor_id, cast(occurred_at AS date) AS active_period FROM a WHERE coalesce(actor_id, session_id) IS NOT NULL"
_RAW = "SELECT project_id, strftime(occurred_at, '%Y-%m-%dT%H') AS time_bucket, epoch_us(occurred_at) // 1000 AS occurred_ms, event_id, type, payload, session_id, actor_id FROM a"
_RAW_WINDOW = f"SELECT * FROM ({_RAW}) WHERE project_id = 'game-1' AND occurred_ms BETWEEN epoch_ms(timestamp '2024-01-10 06:00:00') AND epoch_ms(timestamp '2024-01-12 17:59:59.999') ORDER BY occurred_ms DESC, event_id"
_FUNNEL = f"""
t AS (SELECT actor_id, min(first_seen_at) FILTER (WHERE event_type = 'view') AS t1, min(first_seen_at) FILTER (WHERE event_type = 'click') AS t2, min(first_seen_at) FILTER (WHERE event_type = 'purchase') AS t3
      FROM ({_STEPS}) WHERE project_id = 'game-1' AND first_seen_at BETWEEN timestamp '2024-01-01' AND timestamp '2024-01-31 23:59:59' GROUP BY actor_id),
f AS (SELECT count(*) FILTER (WHERE t1 IS NOT NULL) AS n1, count(*) FILTER (WHERE t1 IS NOT NULL AND t2 >= t1) AS n2, count(*) FILTER (WHERE t1 IS NOT NULL AND t2 >= t1 AND t3 >= t2) AS n3 FROM t)
SELECT step, event_type, actors, CASE WHEN n1 > 0 THEN round(actors / cast(n1 AS double), 4) ELSE 0.0 END AS conversion_rate
FROM (SELECT 1 AS step, 'view' AS event_type, n1 AS actors, n1 FROM f UNION ALL SELECT 2, 'click', n2, n1 FROM f UNION ALL SELECT 3, 'purchase', n3, n1 FROM f)"""
_MATRIX = f"""
y AS ({_DAYS}),
c AS (SELECT project_id, actor_id, active_period, min(active_period) OVER (PARTITION BY project_id, actor_id) AS cohort FROM y),
m AS (SELECT strftime(cohort, '%Y-%m-%d') AS cohort, cast(active_period - cohort AS integer) AS day_offset, count(DISTINCT actor_id) AS actors
      FROM c WHERE project_id = 'game-1' AND cohort BETWEEN date '2024-01-01' AND date '2024-01-14' AND active_period - cohort BETWEEN 0 AND 7 GROUP BY ALL)"""
_VERDICT = """
k AS (SELECT n, project_id, type, occurred_at,
        CASE WHEN n % 20 IN (3, 5) OR (project_id = 'game-3' AND occurred_at >= timestamp '2024-01-15') THEN NULL ELSE project_id END AS own,
        n % 17 = 0 AS no_type, n % 19 = 0 AS bad_time,
        CASE WHEN n % 11 = 0 THEN '{"k":"text"}' WHEN n % 13 = 0 THEN '{}' ELSE payload END AS payload FROM a),
v AS (SELECT *, own IS NOT NULL AND NOT no_type AND NOT bad_time AND type = 'error' AS unregistered,
        NOT coalesce(json_type(payload, '$.k') IN ('UBIGINT', 'BIGINT') AND cast(json_extract(payload, '$.k') AS varchar)::varchar IS NOT NULL AND try_cast(json_extract_string(payload, '$.k') AS bigint) >= 10, false) AS violates FROM k),
s AS (SELECT *, CASE WHEN own IS NULL THEN 401 WHEN no_type OR bad_time THEN 400 WHEN unregistered THEN 422 WHEN violates THEN 400 ELSE 202 END AS status FROM v)"""
_LOG = """
l AS (SELECT *, n * 2 + attempt AS "offset", n % 29 <> 0 AND n % 31 <> 0 AS valid, coalesce(session_id, actor_id) AS own_key FROM d)"""
_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)"
_KEY = "CASE WHEN n % 20 = 3 THEN '' WHEN n % 20 = 5 THEN 'cas_' || project_id || '.wrong' ELSE 'cas_' || project_id || '.s3cret' END"


def _murmur(key: str) -> str:
    """Murmur2 of a key of ASCII characters, as the log's producers hash it."""
    times = lambda x: f"((({x}) * 1540483477::UBIGINT) & 4294967295)"
    byte = lambda at: f"coalesce(ascii(nullif({key}[{at}], ''))::UBIGINT, 0)"
    word = lambda at: f"({byte(f'{at} + 1')} + ({byte(f'{at} + 2')} << 8) + ({byte(f'{at} + 3')} << 16) + ({byte(f'{at} + 4')} << 24))"
    one = lambda k: times(f"xor({k}, {k} >> 24)")
    words = f"list_transform(range(length({key}) // 4), lambda i: {times(word('4 * i'))})"
    start = f"xor(2538058380::UBIGINT, length({key})::UBIGINT)"
    whole = f"list_reduce({words}, lambda h, k: xor({times('h')}, {one('k')}), {start})"
    tail = f"(4 * (length({key}) // 4))"
    ended = f"list_reduce([{whole}], lambda h, x: CASE WHEN length({key}) % 4 > 0 THEN {times(f'xor(x, {word(tail)})')} ELSE x END, 0::UBIGINT)"
    last = f"list_reduce([{ended}], lambda h, x: {times('xor(x, x >> 13)')}, 0::UBIGINT)"
    return f"list_reduce([{last}], lambda h, x: xor(x, x >> 15), 0::UBIGINT)"


def _bucket(key: str, rate: float, burst: int) -> str:
    """A token bucket for each key, one request after the other."""
    refilled = f"least(cast({burst} AS double), b.tokens + greatest(0, q.ms - b.since) * cast('{rate!r}' AS double) / 1000)"
    return f"""
q AS (SELECT {key} AS bucket, n, epoch_us(occurred_at) // 1000 AS ms, row_number() OVER (PARTITION BY {key} ORDER BY epoch_us(occurred_at) // 1000, n) AS i FROM a),
b(bucket, i, n, since, tokens, allowed, retry_after_ms) AS (
  SELECT bucket, i, n, ms, cast({burst} - 1 AS double), true, cast(0 AS bigint) FROM q WHERE i = 1
  UNION ALL
  SELECT bucket, i, n, since, tokens - CASE WHEN tokens >= 1 THEN 1 ELSE 0 END, tokens >= 1, CASE WHEN tokens >= 1 THEN 0 ELSE cast(ceil((1 - tokens) * 1000 / cast('{rate!r}' AS double)) AS bigint) END
  FROM (SELECT q.bucket, q.i, q.n, greatest(b.since, q.ms) AS since, {refilled} AS tokens FROM b JOIN q ON q.bucket = b.bucket AND q.i = b.i + 1))"""


_STREAM_A = """
sa AS (SELECT * FROM a WHERE n % 29 <> 0 AND n % 31 <> 0)"""


def _sql(body: str) -> str:
    return f"WITH {'RECURSIVE ' if 'b(bucket' in body else ''}{_ADAPTER.strip()}{',' if body.lstrip().split(' ', 1)[1].startswith('AS (') else ''} {body.strip()}"


ORACLES: dict[str, str] = {
    name: _sql(body)
    for name, body in {
        "counts_minute": _MINUTE,
        "counts_hour": _HOUR,
        "counts_hour_rolled_up": _HOUR,
        "counts_window": f"SELECT * FROM ({_HOUR}) WHERE {_DAY}",
        "counts_hour_by_type": f"SELECT * FROM ({_HOUR}) WHERE {_DAY} AND event_type = 'purchase'",
        "counts_nested": f"SELECT project_id, string_agg(time_bucket || ':' || event_type || ':' || cast(count AS varchar), ',' ORDER BY time_bucket DESC, event_type) AS buckets FROM ({_HOUR}) WHERE {_DAY} GROUP BY project_id",
        "bucket_series": """
            r AS (SELECT player_id, min(occurred_at) AS f, max(occurred_at) AS l FROM e GROUP BY player_id)
            SELECT player_id, cast(epoch_ms(l) // 3600000 - epoch_ms(f) // 3600000 + 1 AS bigint) AS n_hours, cast(epoch_ms(l) // 60000 - epoch_ms(f) // 60000 + 1 AS bigint) AS n_minutes,
                   strftime(unnest(generate_series(date_trunc('hour', f), date_trunc('hour', l), interval 1 hour)), '%Y-%m-%dT%H') AS time_bucket FROM r""",
        "minute_series": """
            r AS (SELECT player_id, min(occurred_at) AS f FROM e GROUP BY player_id)
            SELECT player_id, strftime(unnest(generate_series(date_trunc('minute', f), date_trunc('minute', f + interval 45 minute), interval 1 minute)), '%Y-%m-%dT%H:%M') AS time_bucket FROM r""",
        "leaderboard_alltime": f"SELECT *, cast({_RANK} AS integer) AS rank FROM ({_BEST.format(rows='a')}) WHERE period = 'alltime'",
        "leaderboard_daily": f"SELECT * FROM (SELECT *, cast({_RANK} AS integer) AS rank FROM ({_BEST.format(rows='a')}) WHERE period <> 'alltime') WHERE rank <= 10",
        "leaderboard_top_n": f"SELECT * FROM (SELECT *, cast({_RANK} AS integer) AS rank FROM ({_BEST.format(rows='a')}) WHERE period = 'alltime' AND project_id = 'game-1') WHERE rank <= 10",
        "player_rank": f"SELECT project_id, period, player_id, cast(rank AS bigint) AS rank, score FROM (SELECT *, {_RANK} AS rank FROM ({_BEST.format(rows='a')})) WHERE period = 'alltime' AND project_id = 'game-1' AND player_id = 'u5'",
        "leaderboard_from_payload": f"SELECT *, 'lb:' || project_id || ':' || period AS board FROM ({_BEST.format(rows='(SELECT * FROM a WHERE n % 7 <> 0 AND n % 5 <> 0)')})",
        "leaderboard_live_days": f"""
            b AS ({_BEST.format(rows='a')}),
            w AS (SELECT project_id, strftime(occurred_at, '%Y-%m-%d') AS period, max(occurred_at) AS at FROM a GROUP BY ALL)
            SELECT b.* FROM b LEFT JOIN w ON b.project_id = w.project_id AND b.period = w.period WHERE b.period = 'alltime' OR w.at + interval 7 day > timestamp '2024-01-20'""",
        "funnel_steps": f"SELECT project_id, actor_id, event_type, epoch_us(first_seen_at) AS first_seen_at FROM ({_STEPS})",
        "funnel_conversion": _FUNNEL,
        "activity_days": _DAYS,
        "retention_cohorts": f"SELECT project_id, actor_id, min(active_period) AS cohort FROM ({_DAYS}) GROUP BY ALL",
        "retention_matrix": f"{_MATRIX} SELECT * FROM m",
        "retention_bitmaps": f"{_MATRIX} SELECT * FROM m",
        "retention_cohort_sizes": f"{_MATRIX} SELECT cohort, coalesce(max(actors) FILTER (WHERE day_offset = 0), 0) AS size, count(*) AS n_offsets, string_agg(cast(day_offset AS varchar) || ':' || cast(actors AS varchar), ',' ORDER BY day_offset) AS offsets FROM m GROUP BY cohort",
        "raw_upsert": _RAW,
        "raw_window": f"{_RAW_WINDOW} LIMIT 50",
        "raw_window_page2": f"{_RAW_WINDOW} LIMIT 50 OFFSET 50",
        "raw_window_stored": f"{_RAW_WINDOW} LIMIT 50",
        "raw_walk": f"{_RAW_WINDOW} LIMIT 50",
        "raw_walk_page2": f"{_RAW_WINDOW} LIMIT 50 OFFSET 50",
        "raw_envelopes": "SELECT event_id, project_id, 1 AS schema_version, strftime(date_trunc('millisecond', occurred_at), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS occurred_at, actor_id, cast(json_extract(payload, '$.k') AS bigint) AS k FROM a",
        "raw_unexpired": f"SELECT * FROM ({_RAW}) WHERE occurred_ms >= epoch_ms(timestamp '2024-01-16')",
        "dedup_first_sight": "SELECT event_id, project_id, attempt, epoch_us(occurred_at) AS occurred_at FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY attempt) AS place FROM d) WHERE place = 1",
        "dedup_unseen": "SELECT event_id, attempt FROM d WHERE event_id NOT IN (SELECT event_id FROM d WHERE attempt = 1)",
        "partition_keys": "SELECT event_id, coalesce(session_id, actor_id, event_id) AS key, coalesce(actor_id, session_id) AS actor FROM a",
        "ingest_verdicts": f"""{_VERDICT}
            SELECT n AS event_no, status, own AS project_id,
                   CASE WHEN status <> 400 THEN '' WHEN no_type OR bad_time THEN concat_ws(',', CASE WHEN bad_time THEN 'occurredAt' END, CASE WHEN no_type THEN 'type' END) ELSE 'k' END AS error_fields FROM s""",
        "quota_verdicts": f"""{_bucket(_KEY, 1 / 600, 3).strip()}, {_VERDICT.strip()}
            SELECT s.n AS event_no, CASE WHEN b.allowed THEN s.status ELSE 429 END AS status, CASE WHEN NOT b.allowed THEN greatest(1, cast(ceil(b.retry_after_ms / 1000) AS bigint)) END AS retry_after_s FROM s JOIN b ON s.n = b.n""",
        "token_bucket": f"{_bucket('project_id', 1 / 1800, 4)} SELECT n AS event_no, bucket AS api_key, allowed, retry_after_ms FROM b",
        "ingest_accepted": f"{_VERDICT} SELECT project_id, type, count(*) AS n, count(DISTINCT n) AS n_ids, cast(sum(CASE WHEN n % 2 = 1 OR date_trunc('millisecond', occurred_at) = occurred_at THEN 1 ELSE 0 END) AS bigint) AS n_on_receipt FROM s WHERE status = 202 GROUP BY ALL",
        "payload_violations": "SELECT event_id, 'k' AS field FROM a WHERE type <> 'error' AND cast(json_extract(payload, '$.k') AS bigint) < 10",
        "envelope_validation": f"{_LOG} SELECT \"offset\", valid, CASE WHEN valid THEN '' ELSE '(root)' END AS fields FROM l",
        "dead_letter_triage": f"{_LOG} SELECT CASE WHEN valid THEN 'persistence' ELSE 'validation' END AS kind, count(*) AS n FROM l WHERE NOT valid OR n % 37 = 0 GROUP BY 1",
        "dead_letter_replay": f"{_LOG} SELECT project_id AS key, count(*) AS n, count(*) AS n_valid, count(DISTINCT n) AS n_events FROM l WHERE valid AND n % 37 = 0 GROUP BY 1",
        "registry_latest": "SELECT project_id, type AS event_type, 'k' AS required, epoch_us(max(occurred_at) + interval 1 hour) AS updated_at FROM a WHERE type <> 'error' GROUP BY ALL",
        "registry_listing": "SELECT DISTINCT project_id, type AS event_type FROM a WHERE type <> 'error' AND project_id = 'game-1'",
        "project_reject": "SELECT DISTINCT 'k-' || project_id AS id, project_id FROM a WHERE project_id = 'game-2'",
        "reconcile_status": """
            x AS (SELECT (SELECT count(*) FROM a) AS accepted, (SELECT count(*) FROM d) AS landed, 'deliveries' AS against
                  UNION ALL SELECT (SELECT count(*) FROM a), (SELECT count(*) FROM a WHERE n % 9 <> 0), 'landed'
                  UNION ALL SELECT (SELECT count(*) FROM a), (SELECT count(*) FROM a), 'itself')
            SELECT *, CASE WHEN landed < accepted THEN 'loss' WHEN landed > accepted THEN 'duplicates' ELSE 'clean' END AS status FROM x""",
        "reconcile_lost": "SELECT event_id FROM a WHERE n % 9 = 0",
        "reconcile_repeated": "SELECT event_id, count(*) AS n FROM d GROUP BY 1 HAVING count(*) > 1",
        "replay_equals_original": "SELECT unnest(['leaderboard', 'funnel', 'retention']) AS view, cast(0 AS bigint) AS n_different",
        "replay_digests": f"""
            t AS (SELECT * FROM d WHERE n % 990 <> 7 AND (attempt = 0 OR n % 700 = 0)),
            x AS ({_MINUTE}), y AS ({_MINUTE.replace('FROM a', 'FROM t')})
            SELECT *, 'left' AS only_in, 'torn' AS against FROM (SELECT * FROM x EXCEPT ALL SELECT * FROM y) UNION ALL SELECT *, 'right', 'torn' FROM (SELECT * FROM y EXCEPT ALL SELECT * FROM x)""",
        "keyed_log": "SELECT coalesce(session_id, actor_id, substr(sha256('event|' || n), 1, 8) || '-' || substr(sha256('event|' || n), 9, 4) || '-' || substr(sha256('event|' || n), 13, 4) || '-' || substr(sha256('event|' || n), 17, 4) || '-' || substr(sha256('event|' || n), 21, 12)) AS key, count(*) AS n, cast(1 AS bigint) AS n_files, true AS in_order FROM a GROUP BY 1",
        "log_offsets": f"""
            k AS (SELECT coalesce(session_id, actor_id, event_id) AS key FROM a),
            p AS (SELECT key, {_murmur("key")} & 2147483647 AS h FROM k)
            SELECT cast(h % 6 AS integer) AS partition, count(*) AS n, cast(0 AS bigint) AS first, count(*) - 1 AS last, count(*) AS n_offsets, count(DISTINCT key) AS n_keys FROM p GROUP BY 1""",
        "stream_raw": f"""{_STREAM_A}
            SELECT project_id, strftime(occurred_at, '%Y-%m-%dT%H') AS time_bucket, epoch_us(occurred_at) // 1000 AS occurred_ms, {_UUID} AS event_id, type, cast(json_extract(payload, '$.k') AS bigint) AS k, session_id, actor_id
            FROM (SELECT *, sha256('event|' || n) AS h FROM sa)""",
        "stream_leaderboard": f"{_STREAM_A} {_BEST.format(rows='sa')}",
        "stream_log_source": f"{_STREAM_A} {_HOUR.replace('FROM a', 'FROM sa')}",
        "stream_player_rank": f"{_STREAM_A} SELECT project_id, period, player_id, cast(rank AS bigint) AS rank, score FROM (SELECT *, {_RANK} AS rank FROM ({_BEST.format(rows='sa')})) WHERE period IN ('alltime', '2024-01-10') AND player_id IN ('u5', 'u9', 'u14')",
        "stream_retention": f"{_STREAM_A} {_DAYS.replace('FROM a ', 'FROM sa ')}",
        "stream_all_views": f"""{_STREAM_A}
            SELECT unnest(['raw', 'counts_minute', 'counts_hour', 'leaderboard', 'funnel', 'retention', 'dead_letters']) AS view,
                   unnest([(SELECT count(*) FROM sa), (SELECT count(*) FROM ({_MINUTE.replace('FROM a', 'FROM sa')})), (SELECT count(*) FROM ({_HOUR.replace('FROM a', 'FROM sa')})), (SELECT count(*) FROM ({_BEST.format(rows='sa')})),
                           (SELECT count(*) FROM ({_STEPS.replace('FROM a ', 'FROM sa ')})), (SELECT count(*) FROM ({_DAYS.replace('FROM a ', 'FROM sa ')})), (SELECT count(*) FROM d WHERE n % 29 = 0 OR n % 31 = 0)]) AS n""",
        "stream_keyed_counts": f"{_STREAM_A} {_HOUR.replace('FROM a', 'FROM sa')}",
        "stream_failed_batch": f"{_STREAM_A}, hours AS ({_HOUR.replace('FROM a', 'FROM sa')}) SELECT project_id || '/' || time_bucket || '/' || event_type AS name, count AS n FROM hours UNION ALL SELECT 'attempts/3', count(*) FROM sa WHERE n % 2 = 1",
        "stream_torn_batch": f"""{_STREAM_A}
            SELECT w AS moment, v AS view, CASE WHEN w = 'torn' THEN (SELECT count(*) FROM sa WHERE n % 2 = 0) ELSE (SELECT count(*) FROM sa) END AS n
            FROM unnest(['torn', 'whole']) AS ws(w), unnest(['raw', 'minute', 'hour']) AS vs(v)""",
        "stream_tumbling": f"sd AS (SELECT * FROM d WHERE n % 29 <> 0 AND n % 31 <> 0) {_HOUR.replace('FROM a', 'FROM sd')}",
        "replay_rebuild": f"{_STREAM_A} {_MINUTE.replace('FROM a', 'FROM sa')}",
        "stream_counts_hour": f"{_STREAM_A} {_HOUR.replace('FROM a', 'FROM sa')}",
        "stream_funnel_conversion": f"{_STREAM_A}, {_FUNNEL.strip().replace('FROM a ', 'FROM sa ').replace('min(occurred_at)', chr(39).join(['min(date_trunc(', 'millisecond', ', occurred_at))']))}",
    }.items()
}
