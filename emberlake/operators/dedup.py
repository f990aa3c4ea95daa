"""First-sight dedup, last-write-wins upsert, and the anti-join with events already applied."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_sight(deliveries: DataFrame, key: str = "event_id", order: Sequence[str] = ("partition", "offset")) -> DataFrame:
    """One row for each key: the first by ``order``. A group holds the deliveries of one event, so it stays small.

    A limit of one row a group lets Spark drop later deliveries before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return deliveries.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def last_write(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each full key: the last by ``order``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.col(c).desc_nulls_last() for c in order)))
    return rows.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``old`` and ``new`` as one table, where a row of ``new`` replaces the old row of its key."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return last_write(both, keys, ["__new", *order]).drop("__new")


def unseen(batch: DataFrame, seen: DataFrame, key: str = "event_id") -> DataFrame:
    """The rows of a batch whose event wasn't applied before."""
    return batch.join(seen.select(key), key, "left_anti")
