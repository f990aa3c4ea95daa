"""View maintenance: one micro-batch of the log applied to the raw store and the four views.

A batch adds to each table a part of its own, made from its own events, so what it costs doesn't grow with what came
before; reading a view combines the parts by sum, max, min, union or last write. A batch is marked when all its tables are
written, and readers take marked batches alone, so they see all of a batch or nothing. A batch may be applied again after a
failure, as each write replaces what the same batch wrote before. Ids are written as seen after the views, so a batch that
failed half-way is not taken for duplicates; they are kept by day for the dedup horizon, then expire.
"""

from __future__ import annotations

import logging
import time as clock
from collections.abc import Callable, Collection
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from emberlake import schema
from emberlake.operators import counts, deadletter, dedup, envelope, funnel, leaderboard, rawstore, retention
from emberlake.sources import shared
from emberlake.streaming import windows
from emberlake.streaming.store import Batches, Commits, Table

log = logging.getLogger(__name__)
ATTEMPTS, FIRST_WAIT_MS = 3, 200
#: As long as raw events are kept.
HORIZON_DAYS = 30
#: The topic by which dead letters come back.
REPLAY = "replay"
#: Batches between two folds, when a stream folds its tables itself.
FOLD_EVERY = 16


def with_retry(name: str, work: Callable[[], None], attempts: int = ATTEMPTS, wait_ms: int = FIRST_WAIT_MS, sleep: Callable[[float], None] = clock.sleep) -> None:
    """Runs ``work``, again after 200 ms, 400 ms and so on; the last failure is raised."""
    for n in range(1, attempts + 1):
        try:
            return work()
        except Exception:
            if n == attempts:
                raise
            log.warning("%s failed, attempt %d of %d", name, n, attempts, exc_info=True)
            sleep(wait_ms * 2 ** (n - 1) / 1000)


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("project_id", "time_bucket", "event_type").agg(F.sum("count").alias("count"))


def _last_writes(rows: DataFrame) -> DataFrame:
    return dedup.last_write(rows, rawstore.KEY, ["batches", "received_at", "payload"])


class Views:
    """The tables under one root folder, and how a batch changes them.

    ``only`` names the tables that this reader of the log keeps, such as raw alone, or all but raw. An event that comes
    again within ``horizon_days`` of its first sight (by the clock of the batch, not of the event) is dropped.
    """

    def __init__(self, spark: SparkSession, root: str, sleep: Callable[[float], None] = clock.sleep, only: Collection[str] | None = None, horizon_days: int = HORIZON_DAYS, today: Callable[[], date] = lambda: datetime.now(timezone.utc).date(), fold_every: int = FOLD_EVERY, ttl_ms: int | None = None):
        ddl = schema.struct
        self.spark, self.sleep, self.only, self.horizon_days, self.today, self.fold_every = spark, sleep, only, horizon_days, today, fold_every
        self.commits, self.keyed, self.ttl_ms = Commits(spark, root), False, ttl_ms
        kept = {"commits": self.commits}
        self.accepted = Table(spark, root, "accepted", StructType([*schema.EVENT.fields, *ddl("batch_id long").fields]), ["batch_id"])
        self.seen = Table(spark, root, "seen_events", ddl("event_id string, day string, batch_id long"), ["day", "batch_id"])
        self.letters = Table(spark, root, "dead_letters", StructType([*schema.DEAD_LETTER.fields, *ddl("batch_id long, stage string").fields]), ["batch_id", "stage"])
        self.raw = Batches(spark, root, "raw_events", schema.RAW, _last_writes, ["time_bucket"], order=["project_id", "occurred_at"], **kept)
        self.by_minute = Batches(spark, root, "counts_minute", schema.COUNTS, _summed, **kept)
        self.by_hour = Batches(spark, root, "counts_hour", schema.COUNTS, _summed, **kept)
        self.board = Batches(spark, root, "leaderboard", schema.LEADERBOARD, leaderboard.best_of, **kept)
        self.board_writes = Batches(spark, root, "leaderboard_writes", ddl("project_id string, period string, last_write_at timestamp"), leaderboard.last_of, **kept)
        self.steps = Batches(spark, root, "funnel_actor_steps", schema.FUNNEL_STATE, funnel.first_of, **kept)
        self.days = Batches(spark, root, "retention_actor_activity", schema.RETENTION_STATE, lambda rows: rows.select(*schema.RETENTION_STATE.names).distinct(), **kept)

    def writers(self) -> dict[str, Callable[[DataFrame, int], None]]:
        every = {"raw": self._raw, "counts": self._counts, "leaderboard": self._leaderboard, "funnel": self._funnel, "retention": self._retention}
        return {name: write for name, write in every.items() if self.only is None or name in self.only}

    def _raw(self, events: DataFrame, batch_id: int) -> None:
        self.raw.put(rawstore.raw_rows(events), batch_id)

    def _counts(self, events: DataFrame, batch_id: int) -> None:
        self.by_minute.put(counts.count_events(events, "minute"), batch_id)
        self.by_hour.put(counts.count_events(events, "hour"), batch_id)

    def _leaderboard(self, events: DataFrame, batch_id: int) -> None:
        best = leaderboard.best_scores(leaderboard.score_events(events))
        self.board.put(best, batch_id)
        self.board_writes.put(best.select("project_id", "period").distinct().withColumn("last_write_at", F.current_timestamp()), batch_id)

    def _funnel(self, events: DataFrame, batch_id: int) -> None:
        self.steps.put(funnel.first_seen(events), batch_id)

    def _retention(self, events: DataFrame, batch_id: int) -> None:
        self.days.put(retention.active_days(events), batch_id)

    def _kept(self) -> tuple[Batches, ...]:
        return self.raw, self.by_minute, self.by_hour, self.board, self.board_writes, self.steps, self.days

    def _seen_before(self, batch_id: int) -> DataFrame:
        """Ids within the horizon, but those of the batch itself; days beyond the horizon are deleted."""
        first = (self.today() - timedelta(days=self.horizon_days)).isoformat()
        days = self.seen.values()
        for day in days:
            if day < first:
                self.seen.remove(day)
        return self.seen.read([d for d in days if d >= first]).filter(F.col("batch_id") != batch_id)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch of log records. Invalid ones go to the dead letters at once and stop nothing.

        What comes of parsing is written first, and all that follows reads it: a batch is read, and told from what its
        stream's states have seen, once.
        """
        parsed = envelope.parsed(batch)
        checked = shared.written(parsed.withColumn("value", F.when(F.col("event").isNull(), F.col("value"))), "batch")
        try:
            self._apply(checked, batch_id)
        finally:
            shared.discard(checked)

    def _apply(self, checked: DataFrame, batch_id: int) -> None:
        good, bad = envelope.parted(checked)
        stamp = F.current_timestamp()
        self.letters.overwrite(deadletter.of_invalid(bad, stamp).withColumns({"batch_id": F.lit(batch_id), "stage": F.lit("validation")}))
        fresh = dedup.first_sight(good)
        if not self.keyed:  # else the stream's own states have told
            fresh = dedup.unseen(fresh, self._seen_before(batch_id))
        source = fresh.select("event_id", "topic", "partition", "offset", "key")
        self.accepted.overwrite(fresh.withColumn("batch_id", F.lit(batch_id)))
        events = self.accepted.read([batch_id])
        failed = ""
        for name, write in self.writers().items():
            try:
                with_retry(name, lambda write=write: write(events, batch_id), sleep=self.sleep)
            except Exception as e:
                failed = f"{name}: {e}"[:500]
                log.exception("%s gave up on batch %d", name, batch_id)
                break
        if failed:
            # the events can be replayed: they go to the dead letters whole, and out of all that the batch wrote
            letters = deadletter.of_failed(events.join(source, "event_id"), rawstore.envelope(), failed, stamp, ATTEMPTS)
            self.letters.overwrite(letters.withColumns({"batch_id": F.lit(batch_id), "stage": F.lit("persistence")}))
            for table in self._kept():
                table.take_out(batch_id)
        elif not self.keyed:
            self.seen.overwrite(events.select("event_id", F.lit(self.today().isoformat()).alias("day"), "batch_id"))
        self.commits.mark(batch_id)
        self.accepted.remove(batch_id)  # its events are in the raw store, as long as these live
        if self.fold_every and batch_id and batch_id % self.fold_every == 0:
            self.fold(batch_id - 1)  # those before are behind the stream's checkpoint

    def fold(self, upto: int) -> None:
        """Fewer, larger parts, for batches up to ``upto`` that won't be applied again: by tiers, each table on its own."""
        for table in self._kept():
            table.fold(upto)
        self.commits.compact(upto)

    def states(self) -> dict[str, DataFrame]:
        """All views as of one moment: every one has the same batches."""
        marked = self.commits.known()
        named = {"raw": self.raw, "counts_minute": self.by_minute, "counts_hour": self.by_hour, "leaderboard": self.board, "leaderboard_writes": self.board_writes, "funnel": self.steps, "retention": self.days}
        return {name: table.state(marked) for name, table in named.items()}

    def dead_letters(self) -> DataFrame:
        """The letters of marked batches."""
        marked = self.commits.known()
        return self.letters.read([v for v in self.letters.values() if marked(int(v))])

    def run_keyed(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """As ``run``, with ids of the horizon kept as keyed states that expire (``windows.first_sights``), by the clock.

        No table of ids is written or read. Invalid records pass, as do those of the topic REPLAY: a batch that failed has its
        ids marked, and its events come back by that topic.
        """
        record = envelope.parsed(stream)
        place = F.concat_ws("/", "topic", "partition", "offset")
        key = F.when(F.size("issues") == 0, F.concat(F.lit("event/"), "event.event_id")).otherwise(F.concat(F.lit("record/"), F.coalesce(place, F.lit(""))))
        invalid = F.size("issues") > 0
        ttl_ms = self.horizon_days * 86_400_000 if self.ttl_ms is None else self.ttl_ms
        fresh = windows.first_sights(record.select(*stream.columns, key.alias("sight"), (invalid | (F.col("topic") == REPLAY)).alias("passes")), F.col("sight"), ttl_ms, always=F.col("passes"))
        self.keyed = True
        with windows.rocksdb(self.spark):
            return self.run(fresh.drop("sight", "passes"), checkpoint, **trigger)

    def run(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """The log applied batch by batch; offsets are committed after each batch's writes."""
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def rebuild(spark: SparkSession, root: str, records: DataFrame) -> Views:
    """Empty views filled from a whole log: the same functions as a stream's."""
    views = Views(spark, root)
    views.apply(records, 0)
    return views
