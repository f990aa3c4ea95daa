"""Expressions that are computed once a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it: plans stay small and parse once."""
    return F.transform(F.array(value), body)[0]


def bound(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with ``value`` as a column that is computed once a row, however often it is used and whatever is filtered by it.

    Made as the one row of a generator, which Spark neither merges with the steps after it nor pushes their filters through,
    and compiles with the rest of the stage.
    """
    return rows.select("*", F.explode(F.array(value)).alias(name))
