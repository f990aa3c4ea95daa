"""Accepted against landed events, and equality of states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lost(accepted: DataFrame, landed: DataFrame, key: str = "event_id") -> DataFrame:
    """Accepted rows that never landed."""
    return accepted.join(landed.select(key), key, "left_anti")


def repeated(landed: DataFrame, key: str = "event_id") -> DataFrame:
    return landed.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def status(accepted: DataFrame, landed: DataFrame) -> DataFrame:
    """One row (accepted, landed, status): fewer landed is loss, more is duplicates, as many is clean."""
    counts = accepted.select(F.lit(1).alias("a"), F.lit(0).alias("l")).unionByName(landed.select(F.lit(0).alias("a"), F.lit(1).alias("l"))).agg(F.coalesce(F.sum("a"), F.lit(0)).alias("accepted"), F.coalesce(F.sum("l"), F.lit(0)).alias("landed"))
    return counts.withColumn("status", F.when(F.col("landed") < F.col("accepted"), "loss").when(F.col("landed") > F.col("accepted"), "duplicates").otherwise("clean"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two states has, as often as it has more of them; empty if the states are equal."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("only_in", F.lit("left")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("right")))


#: Ranges of a level, by bits of a key's hash, and levels: a range of the last is a millionth of a state.
RANGE_BITS, LEVELS = 10, 2


def _row_hash(columns: Sequence[str], salt: int) -> Column:
    """A hash of whole rows: which columns are null is hashed too, as a null alone leaves a hash as it is."""
    return F.xxhash64(F.lit(salt), *columns, *(F.isnull(c) for c in columns))


def digests(state: DataFrame, key: Sequence[str], bits: int) -> DataFrame:
    """(range, n, sums ...) of a state: for each range of key hashes the number of its rows and sums of their hashes.

    The sums don't depend on order and count repeats, so equal states have equal digests; each task sends a row for each range.
    """
    half = lambda h: (F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.shiftrightunsigned(h, 32)))
    sums = [s.alias(f"sum{k}") for k, s in enumerate([*half(_row_hash(state.columns, 1)), *half(_row_hash(state.columns, 2))])]
    return state.groupBy(_range(key, bits).alias("range")).agg(F.count("*").alias("n"), *sums)


def _range(key: Sequence[str], bits: int) -> Column:
    return F.shiftrightunsigned(_row_hash(key, 0), 64 - bits)


def ranges_apart(a: DataFrame, b: DataFrame, key: Sequence[str], bits: int) -> list[int]:
    """The ranges whose digests are not the same in both states; 1,024 at most for each range above."""
    one, other = digests(a, key, bits), digests(b, key, bits)
    sums = [c for c in one.columns if c != "range"]
    both = one.join(other.select("range", *(F.col(c).alias(f"other_{c}") for c in sums)), "range", "full")
    apart = ~F.lit(True)
    for c in sums:
        apart = apart | ~F.col(c).eqNullSafe(F.col(f"other_{c}"))
    return [r["range"] for r in both.filter(apart).select("range").limit(1 << RANGE_BITS).collect()]


def difference_by_digests(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """As ``difference``, where only rows of ranges whose digests differ are shuffled; of equal states nothing but digests.

    ``key`` are columns of both. Ranges are told apart level by level; a level at which all of them may differ is the last,
    as then most rows are to be compared anyway.
    """
    b = b.select(*a.columns)
    left, right = a, b
    for level in range(1, LEVELS + 1):
        apart = ranges_apart(left, right, key, level * RANGE_BITS)
        if len(apart) == 1 << RANGE_BITS:
            break
        inside = _range(key, level * RANGE_BITS).isin(apart) if apart else F.lit(False)
        left, right = a.filter(inside), b.filter(inside)
        if not apart:
            break
    return difference(left, right)
