"""Token-bucket quotas of API keys over a table of requests.

A bucket holds ``burst`` tokens, refills ``rate`` a second, and a request takes one or is refused. After ``burst / rate``
seconds without a request the bucket is full whatever went before, so a key's requests split at such gaps into runs that
don't depend on each other. Gaps are found among the occupied slots of that width, a far smaller table than the
requests; then runs, not keys, are dealt out, and each is read in order by a streaming pass that holds two numbers.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _refill(rate: float, burst: float, frames: Iterator) -> Iterator:
    run, tokens, at = None, 0.0, 0
    for frame in frames:
        allowed, retry = [], []
        for key, start, ms in zip(frame["__quota_key"], frame["__run"], frame["__ms"], strict=True):
            if (key, start) != run:
                run, tokens, at = (key, start), burst, ms
            tokens, at = min(burst, tokens + max(0, ms - at) * rate / 1000), max(at, ms)
            ok = tokens >= 1
            allowed.append(ok)
            retry.append(0 if ok else math.ceil((1 - tokens) * 1000 / rate))
            tokens -= ok
        yield frame.drop(columns=["__quota_key", "__run", "__ms"]).assign(allowed=allowed, retry_after_ms=retry)


def token_bucket(requests: DataFrame, rate: float = 50, burst: float = 100, key: str = "api_key", received_at: str = "received_at", order: tuple[str, ...] = ()) -> DataFrame:
    """``requests`` with ``allowed`` and ``retry_after_ms``. Ties in time are in the order of ``order``; a null key is a key."""
    if rate <= 0 or burst < 1:
        raise ValueError("rate is above 0, burst 1 or more")
    width = math.ceil(burst / rate * 1000)
    rows = requests.withColumns({"__quota_key": F.coalesce(F.col(key).cast("string"), F.lit("")), "__ms": F.unix_millis(received_at)}).withColumn("__slot", F.floor(F.col("__ms") / width))
    by_key = Window.partitionBy("__quota_key").orderBy("__slot")
    slots = rows.select("__quota_key", "__slot").distinct().withColumn("__gap", F.coalesce(F.col("__slot") - F.lag("__slot").over(by_key) > 1, F.lit(True)))
    runs = slots.withColumn("__run", F.max(F.when(F.col("__gap"), F.col("__slot"))).over(by_key.rowsBetween(Window.unboundedPreceding, 0))).select("__quota_key", "__slot", "__run")
    dealt = rows.join(runs, ["__quota_key", "__slot"]).drop("__slot").repartition("__quota_key", "__run").sortWithinPartitions("__quota_key", "__run", "__ms", *order)
    kept = [f for f in dealt.schema if not f.name.startswith("__")]
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return dealt.mapInPandas(functools.partial(_refill, rate, burst), f"{out}, allowed boolean, retry_after_ms long")
