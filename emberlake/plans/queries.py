"""The registered queries over the test tables: each applies one or a few operators to whole tables."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlake.functions import keys, time
from emberlake.operators import counts, deadletter, dedup, envelope, funnel, ingest, leaderboard, quota, rawstore, reconcile, registry, retention
from emberlake.schema import struct
from emberlake.sources import log, segments, shared, tables
from emberlake.streaming import ranks, windows
from emberlake.streaming.store import Table
from emberlake.streaming.views import Views, rebuild

PROJECT = "game-1"
STEPS = "view, click, purchase"
MONTH = ("2024-01-01T00:00:00+00:00", "2024-01-31T23:59:59+00:00")
DAY = ("2024-01-10T00:30:00+00:00", "2024-01-10T23:30:00+00:00")
RAW_WINDOW = ("2024-01-10T06:00:00+00:00", "2024-01-12T17:59:59.999+00:00")
PAGE = 50

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


def _us(column: str) -> Column:
    return F.unix_micros(column).alias(column)


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.best_scores(tables.accepted(spark, sf_dir))


# counts


@query
def counts_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_events(tables.accepted(spark, sf_dir), "minute")


@query
def counts_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_events(tables.accepted(spark, sf_dir), "hour")


@query
def counts_hour_rolled_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.roll_up(counts.count_events(tables.accepted(spark, sf_dir), "minute"))


@query
def counts_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.read_counts(counts_hour(spark, sf_dir), PROJECT, *DAY)


@query
def counts_hour_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.read_counts(counts_hour(spark, sf_dir), PROJECT, *DAY, event_type="purchase")


@query
def counts_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = counts.nested_counts(counts.read_counts(counts_hour(spark, sf_dir), PROJECT, *DAY))
    return nested.select("project_id", F.array_join(F.transform("buckets", lambda b: F.concat_ws(":", b["time_bucket"], b["event_type"], b["count"].cast("string"))), ",").alias("buckets"))


@query
def minute_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every minute from each user's first event to three quarters of an hour later."""
    first = tables.events(spark, sf_dir).groupBy("player_id").agg(F.min("occurred_at").alias("first"))
    return first.select("player_id", F.explode(time.bucket_range(F.col("first"), F.col("first") + F.make_interval(mins=F.lit(45)), "minute")).alias("time_bucket"))


@query
def bucket_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hour from each user's first to last event, with the number of hours, from the events table."""
    ends = tables.events(spark, sf_dir).groupBy("player_id").agg(F.min("occurred_at").alias("first"), F.max("occurred_at").alias("last"))
    spans = ends.select("player_id", time.span_count(F.col("first"), F.col("last"), "hour").alias("n_hours"), time.span_count(F.col("first"), F.col("last"), "minute").alias("n_minutes"), F.explode(time.bucket_range(F.col("first"), F.col("last"), "hour")).alias("time_bucket"))
    return spans


# boards


@query
def leaderboard_alltime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.ranked(_scores(spark, sf_dir).filter(F.col("period") == leaderboard.ALL_TIME))


@query
def leaderboard_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.ranked(_scores(spark, sf_dir).filter(F.col("period") != leaderboard.ALL_TIME), top=10)


@query
def leaderboard_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.top_n(_scores(spark, sf_dir), PROJECT, limit=10)


@query
def player_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.player_rank(_scores(spark, sf_dir), PROJECT, "u5")


@query
def leaderboard_from_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores read from payloads, some of which have a score as text or a player as number."""
    n = F.col("event_id").cast("long")
    player = F.when(n % 7 == 0, F.concat(F.lit('"playerId":'), n.cast("string"))).otherwise(F.concat(F.lit('"playerId":"'), "player_id", F.lit('"')))
    score = F.when(n % 5 == 0, F.concat(F.lit('"score":"'), F.col("score").cast("string"), F.lit('"'))).otherwise(F.concat(F.lit('"score":'), F.col("score").cast("string")))
    events = tables.accepted(spark, sf_dir).withColumn("payload", F.concat(F.lit("{"), player, F.lit(","), score, F.lit("}"))).drop("player_id", "score")
    return leaderboard.best_scores(leaderboard.score_events(events)).withColumn("board", keys.board_key(F.col("project_id"), F.col("period")))


@query
def leaderboard_live_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards that are alive ten days after the last event, with a week to live from each board's last write."""
    scores = tables.accepted(spark, sf_dir)
    board = leaderboard.best_scores(scores)
    periods = F.explode(F.array(F.lit(leaderboard.ALL_TIME), time.day_period(F.col("occurred_at")))).alias("period")
    writes = scores.select("project_id", periods, "occurred_at").groupBy("project_id", "period").agg(F.max("occurred_at").alias("last_write_at"))
    return leaderboard.live_daily_boards(board, writes, 7 * 86400, F.lit("2024-01-20 00:00:00").cast("timestamp"))


# funnels and retention


@query
def funnel_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.first_seen(tables.accepted(spark, sf_dir)).select("project_id", "actor_id", "event_type", _us("first_seen_at"))


@query
def funnel_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.funnel(funnel.first_seen(tables.accepted(spark, sf_dir)), PROJECT, STEPS, *MONTH)


@query
def activity_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.active_days(tables.accepted(spark, sf_dir))


@query
def retention_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.cohorts(retention.active_days(tables.accepted(spark, sf_dir)))


@query
def retention_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.retention_matrix(retention.active_days(tables.accepted(spark, sf_dir)), PROJECT, "2024-01-01", "2024-01-14")


@query
def retention_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix from bitmaps of days that were merged from two halves of the events, the later days first."""
    events = tables.accepted(spark, sf_dir)
    late = F.col("occurred_at") >= F.lit("2024-01-09 00:00:00").cast("timestamp")
    halves = [retention.day_words(retention.active_days(events.filter(part))) for part in (late, ~late)]
    return retention.matrix_from_words(retention.merge_words(*halves), PROJECT, "2024-01-01", "2024-01-14")


@query
def retention_cohort_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = retention.nested_cohorts(retention_matrix(spark, sf_dir))
    return nested.select("cohort", "size", F.size("offsets").cast("long").alias("n_offsets"), F.array_join(F.transform("offsets", lambda x: F.concat_ws(":", x["day_offset"].cast("string"), x["actors"].cast("string"))), ",").alias("offsets"))


# raw store


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = rawstore.raw_rows(tables.deliveries(spark, sf_dir))
    return rawstore.upsert_raw(new.limit(0), new)


def _raw_out(rows: DataFrame) -> DataFrame:
    return rows.select("project_id", "time_bucket", F.unix_millis("occurred_at").alias("occurred_ms"), "event_id", "type", "payload", "session_id", "actor_id")


@query
def raw_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw_out(_raw(spark, sf_dir))


@query
def raw_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw_out(rawstore.page_rows(rawstore.raw_rows(tables.deliveries(spark, sf_dir)), PROJECT, *RAW_WINDOW, limit=PAGE))


@query
def raw_window_page2(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = rawstore.raw_rows(tables.deliveries(spark, sf_dir))
    _, after = rawstore.read_page(raw, PROJECT, *RAW_WINDOW, limit=PAGE)
    rows = rawstore.page_rows(raw, PROJECT, *RAW_WINDOW, limit=PAGE, after=after)
    return _raw_out(rows if after else rows.limit(0))


@query
def raw_window_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window read from a stored raw table, by the folders of its hours."""
    views = Views(spark, shared.new_path(spark, "views"), only=("raw",))
    views.raw.put(rawstore.raw_rows(tables.deliveries(spark, sf_dir)), 0)
    views.commits.mark(0)
    return _raw_out(rawstore.page_rows(views.raw.state(), PROJECT, *RAW_WINDOW, limit=PAGE))


def _stored(spark: SparkSession, sf_dir: str) -> Views:
    """The deliveries stored raw by three batches, the second of them written twice."""
    views = Views(spark, shared.new_path(spark, "views"), only=("raw",))
    rows = rawstore.raw_rows(tables.deliveries(spark, sf_dir))
    for k in (0, 1, 2, 1):
        views.raw.put(rows.filter(F.pmod(F.xxhash64("event_id", "payload"), F.lit(3)) == k), k)
        views.commits.mark(k)
    return views


@query
def raw_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of a window by walking hours, newest first."""
    raw = _stored(spark, sf_dir).raw
    return _raw_out(rawstore.walk_page(raw.folders(), raw.read_folders, PROJECT, *RAW_WINDOW, limit=PAGE)[0])


@query
def raw_walk_page2(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _stored(spark, sf_dir).raw
    folders = raw.folders()
    _, after = rawstore.walk_page(folders, raw.read_folders, PROJECT, *RAW_WINDOW, limit=PAGE)
    rows, _ = rawstore.walk_page(folders, raw.read_folders, PROJECT, *RAW_WINDOW, limit=PAGE, after=after)
    return _raw_out(rows if after else rows.limit(0))


@query
def raw_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows as event JSON, read back field by field."""
    text = _raw(spark, sf_dir).select(rawstore.envelope().alias("e"))
    field = lambda path: F.get_json_object("e", f"$.{path}")
    return text.select(field("eventId").alias("event_id"), field("projectId").alias("project_id"), field("schemaVersion").cast("int").alias("schema_version"), field("occurredAt").alias("occurred_at"), field("actorId").alias("actor_id"), field("payload.k").cast("long").alias("k"))


@query
def raw_unexpired(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    return _raw_out(rawstore.unexpired(raw, F.col("received_at"), F.lit("2024-02-15 00:00:00").cast("timestamp")))


@query
def dedup_first_sight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_sight(tables.deliveries(spark, sf_dir), order=("attempt",)).select("event_id", "project_id", "attempt", _us("occurred_at"))


@query
def dedup_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries whose event isn't among those seen in a first run over repeated events."""
    everything = tables.deliveries(spark, sf_dir)
    return dedup.unseen(everything, everything.filter("attempt = 1")).select("event_id", "attempt")


@query
def partition_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.accepted(spark, sf_dir)
    return rows.select("event_id", keys.partition_key(F.col("session_id"), F.col("actor_id"), F.col("event_id")).alias("key"), keys.actor_key(F.col("actor_id"), F.col("session_id")).alias("actor"))


# ingest

SECRET = "s3cret"
SCHEMA = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 10}}}


def _api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key for each project of the events; that of game-3 was revoked in mid-month."""
    ids = tables.events(spark, sf_dir).select("project_id").distinct()
    revoked = F.when(F.col("project_id") == "game-3", F.lit("2024-01-15 00:00:00").cast("timestamp"))
    return ids.select(F.concat(F.lit("k-"), "project_id").alias("id"), "project_id", F.concat(F.lit("cas_"), "project_id").alias("prefix"), keys.fingerprint(F.lit(SECRET)).alias("hash"), revoked.alias("revoked_at"))


def _schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema for each project and event type, but for errors; registered twice, the later with a lower bound on k."""
    pairs = tables.events(spark, sf_dir).groupBy("project_id", "type").agg(F.max("occurred_at").alias("at")).filter("type != 'error'")
    made = lambda text, later: pairs.select(F.concat_ws("/", "project_id", "type").alias("id"), "project_id", F.col("type").alias("event_type"), F.lit(text).alias("json_schema"), F.col("at").alias("created_at"), (F.col("at") + F.make_interval(hours=F.lit(later))).alias("updated_at"))
    return registry.register(made(json.dumps({"type": "object"}), 0), made(json.dumps(SCHEMA), 1))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as clients' requests; some lack a key, have a wrong one, no type, a bad time or a payload of the wrong type."""
    n = F.col("event_id").cast("long")
    key = F.when(n % 20 == 3, None).when(n % 20 == 5, F.concat(F.lit("cas_"), "project_id", F.lit(".wrong"))).otherwise(F.concat(F.lit("cas_"), "project_id", F.lit(f".{SECRET}")))
    payload = F.when(n % 11 == 0, F.lit('{"k":"text"}')).when(n % 13 == 0, F.lit("{}")).otherwise(F.col("payload"))
    kind = F.when(n % 17 == 0, F.lit('"level":1,')).otherwise(F.concat(F.lit('"type":"'), "type", F.lit('",')))
    at = F.when(n % 19 == 0, F.lit('"occurredAt":"yesterday",')).when(n % 2 == 0, F.concat(F.lit('"occurredAt":"'), F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit('",'))).otherwise(F.lit(""))
    value = F.concat(F.lit("{"), kind, at, F.lit('"payload":'), payload, F.lit("}"))
    return tables.accepted(spark, sf_dir).select(F.lit("requests").alias("topic"), F.lit(0).alias("partition"), n.alias("offset"), key.alias("api_key"), "received_at", value.alias("value"))


@query
def ingest_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = ingest.decided(_requests(spark, sf_dir), _api_keys(spark, sf_dir), _schemas(spark, sf_dir))
    fields = F.array_join(F.array_sort(F.transform("errors", lambda e: e["field"])), ",")
    return verdicts.select(F.col("offset").alias("event_no"), "status", "project_id", fields.alias("error_fields"))


@query
def quota_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts where a key may ask once in ten minutes, three times at once; what is over its quota is told when to come back."""
    asked = quota.token_bucket(_requests(spark, sf_dir), rate=1 / 600, burst=3, order=("offset",))
    verdicts = ingest.decided(asked, _api_keys(spark, sf_dir), _schemas(spark, sf_dir), "allowed")
    return verdicts.select(F.col("offset").alias("event_no"), "status", F.when(F.col("status") == 429, keys.retry_seconds(F.col("retry_after_ms"))).alias("retry_after_s"))


@query
def ingest_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = ingest.ingest(_requests(spark, sf_dir), _api_keys(spark, sf_dir), _schemas(spark, sf_dir))
    return good.groupBy("project_id", "type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_ids"), F.sum((F.col("occurred_at") == F.col("received_at")).cast("long")).alias("n_on_receipt"))


@query
def payload_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = registry.validated(tables.accepted(spark, sf_dir), _schemas(spark, sf_dir))
    return checked.filter(F.size("violations") > 0).select("event_id", F.col("violations")[0]["field"].alias("field"))


def _log(spark: SparkSession, sf_dir: str, scored: bool = False) -> DataFrame:
    """The deliveries as log records; every 29th isn't JSON, every 31st has a key that an envelope hasn't. ``scored``: payloads are scores."""
    rows = tables.deliveries(spark, sf_dir)
    if scored:
        rows = rows.withColumn("payload", F.concat(F.lit('{"playerId":"'), "player_id", F.lit('","score":'), F.col("score").cast("string"), F.lit("}")))
    rows = rows.withColumn("offset", F.col("event_id").cast("long") * 2 + F.col("attempt"))
    n = F.col("event_id").cast("long")
    shown = rows.withColumns({"n": n, "event_id": keys.uuid_of(F.lit("event"), n), "time_bucket": F.lit(None).cast("string"), "key": keys.partition_key(F.col("session_id"), F.col("actor_id"), F.col("event_id"))})
    value = rawstore.envelope()
    value = F.when(F.col("n") % 29 == 0, F.lit("this-is-not-json")).when(F.col("n") % 31 == 0, F.concat(F.lit('{"extra":1,'), F.substring(value, F.lit(2), F.length(value)))).otherwise(value)
    return shown.select("key", value.alias("value"), F.lit("raw-events").alias("topic"), F.lit(0).alias("partition"), "offset")


@query
def envelope_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = envelope.parsed(_log(spark, sf_dir))
    return checked.select("offset", (F.size("issues") == 0).alias("valid"), F.array_join(F.transform("issues", lambda x: x["field"]), ",").alias("fields"))


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead letters of the invalid records, and of every 37th event as if the store had refused it."""
    good, bad = envelope.split(_log(spark, sf_dir))
    stamp = F.lit("2024-02-01 00:00:00").cast("timestamp")
    refused = good.filter(F.floor(F.col("offset") / 2) % 37 == 0)
    return deadletter.of_invalid(bad, stamp).unionByName(deadletter.of_failed(refused, rawstore.envelope(), "store refused", stamp))


@query
def dead_letter_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deadletter.triage(_letters(spark, sf_dir))


@query
def dead_letter_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replayed records, read again as events."""
    again = deadletter.replayable(deadletter.message_key(_letters(spark, sf_dir)))
    return envelope.parsed(again).groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("event").isNotNull()).alias("n_valid"), F.count_distinct("event.event_id").alias("n_events"))


@query
def registry_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _schemas(spark, sf_dir).select("project_id", "event_type", F.get_json_object("json_schema", "$.required[0]").alias("required"), _us("updated_at"))


@query
def registry_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.listed(_schemas(spark, sf_dir), PROJECT).select("project_id", "event_type")


@query
def project_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of projects that the table of projects (here all but game-2) doesn't know."""
    projects = tables.events(spark, sf_dir).select(F.col("project_id").alias("id")).distinct().filter("id != 'game-2'")
    return registry.known_projects(_api_keys(spark, sf_dir), projects)[1].select("id", "project_id")


@query
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request in half an hour for each project, four at once."""
    rows = tables.accepted(spark, sf_dir).select(F.col("event_id").cast("long").alias("event_no"), F.col("project_id").alias("api_key"), "received_at")
    return quota.token_bucket(rows, rate=1 / 1800, burst=4, order=("event_no",)).select("event_no", "api_key", "allowed", "retry_after_ms")


# upkeep


@query
def reconcile_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = tables.accepted(spark, sf_dir)
    every = reconcile.status(accepted, tables.deliveries(spark, sf_dir)).withColumn("against", F.lit("deliveries"))
    landed = accepted.filter(F.col("event_id").cast("long") % 9 != 0)
    return every.unionByName(reconcile.status(accepted, landed).withColumn("against", F.lit("landed"))).unionByName(reconcile.status(accepted, accepted).withColumn("against", F.lit("itself")))


@query
def reconcile_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = tables.accepted(spark, sf_dir)
    return reconcile.lost(accepted, accepted.filter(F.col("event_id").cast("long") % 9 != 0)).select("event_id")


@query
def reconcile_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.repeated(tables.deliveries(spark, sf_dir))


@query
def replay_equals_original(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows differ between each view of all events and the same view built from two halves, merged."""
    everything = tables.accepted(spark, sf_dir)
    odd = F.col("event_id").cast("long") % 2 == 1
    halves = everything.filter(~odd), everything.filter(odd)
    views = {
        "leaderboard": (leaderboard.best_scores, leaderboard.merge),
        "funnel": (funnel.first_seen, funnel.merge),
        "retention": (retention.active_days, retention.merge),
    }
    out = [reconcile.difference(build(everything), merge(build(halves[0]), build(halves[1]))).agg(F.count("*").alias("n_different")).withColumn("view", F.lit(name)) for name, (build, merge) in views.items()]
    return functools.reduce(DataFrame.unionByName, out)


@query
def replay_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts by the minute against themselves and against those of a log that lost and repeated some events, by digests."""
    everything, again = tables.accepted(spark, sf_dir), tables.deliveries(spark, sf_dir)
    n = F.col("event_id").cast("long")
    key = ["project_id", "time_bucket", "event_type"]
    whole = counts.count_events(everything, "minute")
    torn = counts.count_events(again.filter((n % 990 != 7) & ((F.col("attempt") == 0) | (n % 700 == 0))), "minute")
    found = reconcile.difference_by_digests(whole, torn, key).withColumn("against", F.lit("torn"))
    same = reconcile.difference_by_digests(whole, counts.count_events(everything, "minute"), key).withColumn("against", F.lit("itself"))
    return found.unionByName(same)


@query
def keyed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events written as a log and read again: how many each key has, in how many files, and whether in order of time."""
    path = shared.new_path(spark, "log")
    log.write_log(tables.accepted(spark, sf_dir).withColumn("event_id", keys.uuid_of(F.lit("event"), F.col("event_id"))), path, 8)
    read = spark.read.schema("key string, value string").json(path).select("key", F.get_json_object("value", "$.occurredAt").alias("at"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"))
    late = F.coalesce(F.lag("at").over(Window.partitionBy("key", "file").orderBy("place")) > F.col("at"), F.lit(False))
    return read.withColumn("late", late).groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("file").alias("n_files"), (F.count_if("late") == 0).alias("in_order"))


@query
def log_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events produced in two appends and read as a stream's reader would: each partition's offsets and keys."""
    path = shared.new_path(spark, "log")
    events = tables.accepted(spark, sf_dir)
    second = F.col("event_id").cast("long") % 3 == 0
    for part in (events.filter(~second), events.filter(second)):
        log.append_log(spark, part, path, 6)
    read = log.replay_files(spark, path)
    return read.groupBy("partition").agg(F.count("*").alias("n"), F.min("offset").alias("first"), F.max("offset").alias("last"), F.count_distinct("offset").alias("n_offsets"), F.count_distinct("key").alias("n_keys"))


# streams


def _streamed(spark: SparkSession, sf_dir: str, only: tuple[str, ...] | None, scored: bool = False) -> Views:
    root = shared.new_path(spark, "views")
    _log(spark, sf_dir, scored).write.json(f"{root}/log")
    views = Views(spark, root, only=only)
    views.run(log.stream_files(spark, f"{root}/log"), f"{root}/checkpoint").awaitTermination()
    return views


def _uuid_and_ms(rows: DataFrame) -> DataFrame:
    return rows.select("project_id", "time_bucket", F.unix_millis("occurred_at").alias("occurred_ms"), "event_id", "type", F.get_json_object("payload", "$.k").cast("long").alias("k"), "session_id", "actor_id")


@query
def stream_counts_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, ("counts",)).by_hour.state()


@query
def stream_funnel_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.funnel(_streamed(spark, sf_dir, ("funnel",)).steps.state(), PROJECT, STEPS, *MONTH)


@query
def stream_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _uuid_and_ms(_streamed(spark, sf_dir, ("raw",)).raw.state())


@query
def stream_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, ("leaderboard",), scored=True).board.state()


@query
def stream_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, ("retention",)).days.state()


@query
def stream_all_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reader of the log that keeps the raw store and all four views: how many rows each has, and how many letters are dead."""
    views = _streamed(spark, sf_dir, None, scored=True)
    states = {"raw": views.raw.state(), "counts_minute": views.by_minute.state(), "counts_hour": views.by_hour.state(), "leaderboard": views.board.state(), "funnel": views.steps.state(), "retention": views.days.state(), "dead_letters": views.letters.read()}
    return functools.reduce(DataFrame.unionByName, (rows.agg(F.count("*").alias("n")).withColumn("view", F.lit(name)) for name, rows in states.items()))


#: Files of one batch of a log, so that its writing is shared by as many tasks.
FILES = 16


def _append(rows: DataFrame, path: str) -> None:
    """Adds a batch to a log: FILES of them, or fewer if it has fewer rows."""
    rows.repartition(FILES).write.mode("append").json(path)


def _in_batches(rows: DataFrame, root: str, n: int) -> str:
    """The log in ``n`` batches of FILES, which a stream reads one by one; deliveries of an event are mostly in different ones."""
    made = shared.written(rows, "records")  # made once, not for each batch
    for k in range(n):
        _append(made.filter(F.pmod(F.xxhash64("offset"), F.lit(n)) == k), f"{root}/log")
    shared.discard(made)
    return f"{root}/log"


@query
def stream_keyed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by the hour where ids are keyed states: two batches, then a restart from the checkpoint for two more, and the
    first records once more."""
    root = shared.new_path(spark, "views")
    for again in (False, True):
        path = _in_batches(_log(spark, sf_dir), root, 2) if not again else f"{root}/log"
        if again:
            _append(_log(spark, sf_dir).filter("offset % 3 = 0"), path)
        views = Views(spark, root, only=("counts",))
        views.run_keyed(log.stream_files(spark, path, files_per_batch=FILES), f"{root}/checkpoint").awaitTermination()
    return views.by_hour.state()


class _Gone(BaseException):
    """A writer's end that nothing catches."""


@query
def stream_torn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second batch whose writer dies after one table: how many events readers see in each view then, and after it ran again."""
    views = Views(spark, shared.new_path(spark, "views"), only=("raw", "counts"))
    records = _log(spark, sf_dir)
    first = F.pmod(F.floor(F.col("offset") / 2), F.lit(2)) == 0
    views.apply(records.filter(first), 0)
    real = views.by_minute.overwrite

    def dying(*args: object) -> None:
        real(*args)
        raise _Gone

    views.by_minute.overwrite = dying
    try:
        views.apply(records.filter(~first), 1)
    except _Gone:
        views.by_minute.overwrite = real

    def seen(when: str) -> DataFrame:
        states = views.states()
        each = {"raw": states["raw"].agg(F.count("*").alias("n")), "minute": states["counts_minute"].agg(F.sum("count").alias("n")), "hour": states["counts_hour"].agg(F.sum("count").alias("n"))}
        return functools.reduce(DataFrame.unionByName, (n.select(F.lit(when).alias("moment"), F.lit(view).alias("view"), "n") for view, n in each.items()))

    torn = shared.written(seen("torn"), "torn")
    views.apply(records.filter(~first), 1)
    return torn.unionByName(seen("whole"))


@query
def stream_failed_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that a view refuses three times, dead-lettered whole and replayed: the counts by the hour, and the letters' attempts."""
    views = Views(spark, shared.new_path(spark, "views"), only=("counts", "funnel"), sleep=lambda seconds: None)
    records = _log(spark, sf_dir)
    half = F.pmod(F.floor(F.col("offset") / 2), F.lit(2)) == 0
    views.apply(records.filter(half), 0)
    real = views.steps.put

    def refused(*args: object) -> None:
        raise OSError("the store is down")

    views.steps.put = refused
    views.apply(records.filter(~half), 1)
    views.steps.put = real
    letters = views.dead_letters().filter("error.kind = 'persistence'")
    again = deadletter.replayable(letters).select("key", "value", F.lit("replay").alias("topic"), F.lit(0).alias("partition"), F.monotonically_increasing_id().alias("offset"))
    views.apply(shared.written(again, "replay"), 2)
    attempts = letters.groupBy("attempts").agg(F.count("*").alias("n")).select(F.concat(F.lit("attempts/"), F.col("attempts").cast("string")).alias("name"), "n")
    return views.by_hour.state().select(F.concat_ws("/", "project_id", "time_bucket", "event_type").alias("name"), F.col("count").alias("n")).unionByName(attempts)


@query
def stream_log_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by the hour from a log read by its offsets: one append, then a restart from the checkpoint after another."""
    root = shared.new_path(spark, "views")
    records = _log(spark, sf_dir).withColumnRenamed("offset", "no").drop("partition")
    for k in range(2):
        log.append_records(spark, records.filter(F.col("no") % 2 == k), f"{root}/log", 6, [("no", True)])
        segments.publish(spark, f"{root}/log")
        views = Views(spark, root, only=("counts",))
        views.run(segments.stream(spark, f"{root}/log"), f"{root}/checkpoint").awaitTermination()
    return views.by_hour.state()


@query
def stream_player_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of some players, all-time and of one day, from an order index that a stream keeps in three batches."""
    root = shared.new_path(spark, "ranks")
    path = _in_batches(_log(spark, sf_dir, True), root, 3)
    events = envelope.parsed(log.stream_files(spark, path, files_per_batch=FILES)).filter("size(issues) = 0").select("event.*")
    index = ranks.RankIndex(spark, root)
    index.run(leaderboard.board_scores(leaderboard.score_events(events)), f"{root}/checkpoint").awaitTermination()
    asked = [(f"game-{user % 4}", f"u{user}", period) for user in (5, 9, 14) for period in (leaderboard.ALL_TIME, "2024-01-10")]
    return functools.reduce(DataFrame.unionByName, (index.rank(*one) for one in asked))


@query
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by tumbling windows in update mode, kept as the last update of each window: late events correct theirs."""
    root = shared.new_path(spark, "tumbling")
    path = _in_batches(_log(spark, sf_dir), root, 3)
    events = envelope.parsed(log.stream_files(spark, path, files_per_batch=FILES)).filter("size(issues) = 0").select("event.*")
    counted = windows.tumbling_counts(events, "hour", "60 days")
    kept = Table(spark, root, "windows", struct("project_id string, time_bucket string, event_type string, count long, batch_id long"), ["batch_id"])
    sink = counted.writeStream.foreachBatch(lambda rows, k: kept.overwrite(rows.withColumn("batch_id", F.lit(k).cast("long")))).outputMode("update")
    sink.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return dedup.last_write(kept.read(), ["project_id", "time_bucket", "event_type"], ["batch_id"]).drop("batch_id")


@query
def replay_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole log replayed into empty views; the counts by minute that come of it."""
    root = shared.new_path(spark, "views")
    _log(spark, sf_dir).write.json(f"{root}/log")
    return rebuild(spark, root, log.replay_files(spark, f"{root}/log")).by_minute.state()
