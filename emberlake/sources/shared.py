"""The folder that the driver and all executors share, and tables written there once."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Whether the shuffle files of an execution go at its end; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="emberlake-")


def shared_dir(spark: SparkSession) -> str:
    """As ``spark.checkpoint.dir`` names it. Without one, a local session has a temporary folder of its own; a cluster has
    none that all would see, so it is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own_folder()


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is executed meanwhile go at its end."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def written(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and still there when executors are lost. What was shuffled
    for it is deleted, as nothing reads that again."""
    path = new_path(df.sparkSession, tag)
    with _cleaned(df.sparkSession):
        df.write.parquet(path, **options)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def reads(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """``df``, which still reads ``tables``: whoever discards it discards them too."""
    df.read_from = tables
    return df


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and that nothing still to be computed reads."""
    for t in tables:
        discard(*getattr(t, "read_from", ()))
        if (where := getattr(t, "written_to", None)) is not None:
            delete(t.sparkSession, where)
