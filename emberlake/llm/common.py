"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.sources.shared import discard, new_path, reads, shared_dir, written

__all__ = ["BROADCAST_ROWS", "decoded", "discard", "let", "new_path", "partitions", "quoted", "reads", "shared_dir", "small", "table", "words", "written"]


def decoded(column) -> Iterator[str]:
    """The texts of an Arrow column, null as empty; bytes that are not UTF-8 become U+FFFD."""
    import pyarrow as pa

    return ((b.as_py() or b"").decode("utf-8", "replace") for b in column.cast(pa.binary()))


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name as it is, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, even where ``body`` uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text (null: none): runs of characters other than space and U+0009 to U+000D."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


#: A table of so many rows at most, of a few numbers each, is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 300_000


def small(df: DataFrame) -> DataFrame:
    """A written table of ids, marked for broadcast if it has BROADCAST_ROWS rows at most."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
