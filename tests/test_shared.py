"""Tables written in the shared folder, and what is left of them."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from emberlake.sources import shared


def shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "/shuffle_" in f}


def left(spark, before: set[str], seconds: float = 10) -> set[str]:
    """Shuffle files beside those of before; they are deleted in the background."""
    until = time.time() + seconds
    while (more := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.1)
    return more


def test_shuffles_of_a_written_table_are_deleted(spark):
    before = shuffle_files(spark)
    counts = spark.range(10_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.count("*").alias("n"))
    joined = counts.join(spark.range(1000).withColumnRenamed("id", "k").hint("merge"), "k")
    t = shared.written(joined, "joined")
    assert not left(spark, before)
    # the same frame can be computed again
    assert t.count() == joined.count() == shared.written(joined, "again").count() == 1000


def test_the_session_is_left_as_it_was(spark):
    for own in (None, "false", "true"):
        if own:
            spark.conf.set(shared.CLEANUP, own)
        asked = spark.conf.get(shared.CLEANUP)
        shared.written(spark.range(3), "kept")
        with pytest.raises(Exception, match="fails"):
            shared.written(spark.range(3).select(F.raise_error(F.lit("fails"))), "failed")
        assert spark.conf.get(shared.CLEANUP) == asked
        spark.conf.unset(shared.CLEANUP)
