"""Shard placement by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table, made from two hashes of its name. The shards
take turns to claim their next free slot, so each ends with nearly the same number of slots, and when a shard is added
or removed few other slots move. The table has a fixed size that doesn't grow with the data: it is broadcast, and the
place of a row is one hash and one look-up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.llm.common import quoted

#: A prime, over a hundred times the production number of shards, so that shares differ by under one per cent.
TABLE_SIZE = 2039
SHARDS = tuple(f"shard-{k:02d}" for k in range(16))


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """The number of the shard that owns each slot. ``size`` is a prime of at least the number of shards."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards are distinct names, one at least")
    if size < max(2, len(shards)) or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("size is a prime of at least the number of shards")
    start = [_hash(f"{s}/offset") % size for s in shards]
    skip = [_hash(f"{s}/skip") % (size - 1) + 1 for s in shards]
    owner, turn, left = [-1] * size, [0] * len(shards), size
    while True:
        for k in range(len(shards)):
            while owner[slot := (start[k] + turn[k] * skip[k]) % size] >= 0:
                turn[k] += 1
            owner[slot] = k
            if not (left := left - 1):
                return owner


def key_slot(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key: 32 bits of its MD5, as DuckDB and Spark both have it; a null key counts as the empty text."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(size)).cast("int")


def table_frame(spark: SparkSession, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """The table as rows (slot, shard), from one SQL literal of ``size`` numbers."""
    packed = ",".join(map(str, lookup_table(shards, size)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(packed), ",")).alias("slot", "shard_text")).select("slot", F.col("shard_text").cast("int").alias("shard"))


def assign(docs: DataFrame, key_col: str = "doc_id", shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """``docs`` with the columns ``slot`` and ``shard`` (an own column of one of these names is replaced).

    Equal keys have one shard; null keys are placed as the empty text; no row is lost or repeated.
    """
    spark = docs.sparkSession
    placed = docs.drop("slot", "shard").withColumn("slot", key_slot(F.col(key_col), size))
    return placed.join(F.broadcast(table_frame(spark, shards, size)), "slot").select(*map(quoted, placed.columns), "shard")


def shares(placed: DataFrame, weight: Column | None = None) -> DataFrame:
    """Rows and weight of each shard, to see how even the placement is."""
    return placed.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum(F.lit(1) if weight is None else weight).alias("weight"))
