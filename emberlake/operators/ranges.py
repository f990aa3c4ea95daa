"""Dense places of rows in an order, by ranges: no task ever holds more than a range, and no row is ranked alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.sources.shared import reads, written


def placed(df: DataFrame, order: Sequence[tuple[str, bool]], group: str | None = None) -> DataFrame:
    """``df`` with the column ``place``: 0, 1, 2 ... by ``order`` (name, ascending), in each value of ``group`` anew.

    Nulls come first where ascending, last where descending. Equal rows have places of their own, in any order, and may be
    of any number: a row's number parts them, so ranges can split them. The ranges are written once, so numbers and counts
    see the same rows. An empty table gives none.
    """
    inside = [group] if group else []

    def columns(own: str) -> list[Column]:
        return [*map(F.asc, inside), *(F.asc(n) if up else F.desc(n) for n, up in order), F.asc(own)]

    dealt = df.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*columns("tie")).withColumn("part", F.spark_partition_id())
    ranges = written(dealt, "ranges")
    no = F.row_number().over(Window.partitionBy("part", *inside).orderBy(*columns("tie")))
    counts = ranges.groupBy("part", *inside).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*(inside or [F.lit(0)])).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    # one row for each range (and group in it)
    starts = counts.select(F.col("part").alias("its_part"), *(F.col(g).alias("its_group") for g in inside), before.alias("before"))
    same = F.col("part") == F.col("its_part")
    if inside:
        same = same & F.col(group).eqNullSafe(F.col("its_group"))
    numbered = ranges.withColumn("no", no).join(starts, same)
    return reads(numbered.select(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns), (F.col("before") + F.col("no") - 1).alias("place")), ranges)
