"""Stateful stream operators: tumbling counts, dedup within a horizon or by keyed state that expires, and quotas."""

from __future__ import annotations

import contextlib
import json
import math
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from emberlake.functions import time
from emberlake.schema import struct

# processes that start a stream's states see none of the session's Python files, so they are sent this module's code
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The state store that keeps states on disk, key by key, and lets them expire.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def tumbling_counts(events: DataFrame, grain: str, lateness: str) -> DataFrame:
    """Counts by event-time window; run in update mode, as an appended window waits for the watermark.

    Events later than ``lateness`` are dropped from the state, so the horizon is chosen wide.
    """
    windows = events.withWatermark("occurred_at", lateness).groupBy(F.window("occurred_at", f"1 {grain}"), "project_id", "type").count()
    return windows.select("project_id", time.bucket(F.col("window.start"), grain).alias("time_bucket"), F.col("type").alias("event_type"), "count")


def dedup_within(events: DataFrame, horizon: str, key: str = "event_id") -> DataFrame:
    """The first delivery of each key within a horizon of event time; duplicates don't extend it."""
    return events.withWatermark("occurred_at", horizon).dropDuplicatesWithinWatermark([key])


def dedup_with_ttl(events: DataFrame, ttl_ms: int, key: str = "event_id") -> DataFrame:
    """The first delivery of each key within ``ttl_ms`` of processing time from first sight; duplicates don't refresh it.

    The time of first sight is kept and compared, as a key's data come before its timeout where a batch has both.
    """

    def first(k: tuple, frames: Iterator, state: GroupState) -> Iterator:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.getCurrentProcessingTimeMs()
        for frame in frames:
            if len(frame) and (not state.exists or now >= state.get[0] + ttl_ms):
                state.update((now,))
                yield frame.head(1)
        if state.exists:  # a timeout is forgotten whenever data come
            state.setTimeoutDuration(max(1, state.get[0] + ttl_ms - now))

    return events.groupBy(key).applyInPandasWithState(first, events.schema, "seen_at long", "append", GroupStateTimeout.ProcessingTimeTimeout)


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their states in RocksDB, and run no batches without data: states expire in the
    next batch that has some, and a run over what is there comes to an end. Streams started elsewhere keep the session's ways.
    """
    ways = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {name: spark.conf.get(name, None) for name in ways}
    for name, value in ways.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


#: Of each key of a bucket the time of its first sight in milliseconds, as JSON.
SEEN = struct("sights string")
#: Into how many states the keys are dealt by their hash.
BUCKETS = 1 << 16


class FirstSights(StatefulProcessor):
    """Of each key in a bucket the first row; a key is kept until its time to live is over, and duplicates don't extend it."""

    def __init__(self, ttl_ms: int, order: tuple[str, ...], always: str | None):
        self.ttl_ms, self.order, self.always = ttl_ms, order, always

    def init(self, handle: StatefulProcessorHandle) -> None:
        # what was written last lives longest: a state that is as old holds no living key
        self.seen = handle.getValueState("seen", SEEN, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803  names of the interface
        now = timerValues.getCurrentProcessingTimeInMs()
        held = self.seen.get()
        sights = {k: at for k, at in json.loads(held[0]).items() if now < at + self.ttl_ms} if held else {}
        fresh: dict = {}
        for row in rows:
            # JSON has text keys alone, so a null key is apart from any text
            own = "null" if row["__key"] is None else f"/{row['__key']}"
            known = own in sights
            if self.always and row[self.always]:
                yield row
                if not known:
                    fresh.setdefault(own, None)
            elif not known:
                first = fresh.get(own)
                if first is None or tuple(row[c] for c in self.order) < tuple(first[c] for c in self.order):
                    fresh[own] = row
        if fresh:
            self.seen.update((json.dumps(sights | dict.fromkeys(fresh, now), separators=(",", ":")),))
            yield from (row for row in fresh.values() if row is not None)

    def close(self) -> None:
        pass


def first_sights(rows: DataFrame, key: Column, ttl_ms: int, order: tuple[str, ...] = ("partition", "offset"), always: Column | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The first row of each key within ``ttl_ms`` of processing time from first sight, by ``order`` inside a batch.

    Keys are dealt to ``buckets`` states in RocksDB by their hash, and each expires by itself (start the stream inside
    ``rocksdb``): a batch touches the buckets of its own keys, each once, as asking for a state costs far more than reading a
    hundred keys in it. Nothing else of what came before is read. Rows where ``always`` holds pass whatever was seen, and mark
    their key. The state moves on with the checkpoint, so a batch that is run again sees what it saw. The number of buckets
    is fixed for a checkpoint.
    """
    shown = rows.withColumns({"__key": key.cast("string"), "__always": F.lit(False) if always is None else F.coalesce(always, F.lit(False))})
    dealt = shown.withColumn("__bucket", F.pmod(F.xxhash64("__key"), F.lit(buckets)))
    kept = dealt.groupBy("__bucket").transformWithState(FirstSights(ttl_ms, order, "__always"), dealt.schema, "Append", "ProcessingTime")
    return kept.drop("__key", "__always", "__bucket")


def token_bucket(requests: DataFrame, rate: float = 50, burst: float = 100, key: str = "api_key", received_at: str = "received_at") -> DataFrame:
    """Quotas over a stream: each key's tokens and last time are kept until the bucket would be full again."""
    idle_ms = math.ceil(burst / rate * 1000)

    def take(k: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        tokens, at = state.get if state.exists else (float(burst), None)
        rows = pd.concat(list(frames)).sort_values(received_at, kind="stable")  # one key's share of one micro-batch
        allowed, retry = [], []
        for ms in rows[received_at].astype("datetime64[ms]").astype("int64"):
            at = ms if at is None else at
            tokens, at = min(burst, tokens + max(0, ms - at) * rate / 1000), max(at, ms)
            ok = tokens >= 1
            allowed.append(ok)
            retry.append(0 if ok else math.ceil((1 - tokens) * 1000 / rate))
            tokens -= ok
        state.update((float(tokens), int(at)))
        state.setTimeoutDuration(idle_ms)
        yield rows.assign(allowed=allowed, retry_after_ms=retry)

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema) + ", allowed boolean, retry_after_ms long"
    return requests.groupBy(key).applyInPandasWithState(take, out, "tokens double, at long", "append", GroupStateTimeout.ProcessingTimeTimeout)
