"""The log of files as a data source with offsets: a stream of it reads, of each partition, what lies beyond its checkpoint.

``publish`` adds the files of an append to the log's index: one row for each file and partition in it, with the first and
last offset. A reader sees published files alone, and opens only those that hold offsets of its batch. Paths are those
that pyarrow's file systems open, on the driver and on all executors.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator, Mapping, Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from emberlake.schema import LOG

# the processes that plan a stream's batches see none of the session's Python files, so they are sent this module's code
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAME, INDEX = "emberlake_log", "_segments"
#: Records of a log that are handed to Spark at once.
ROWS = 4096


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _names(path: str) -> list[str]:
    from pyarrow import fs

    store, at = _store(path)
    return sorted(i.base_name for i in store.get_file_info(fs.FileSelector(at, allow_not_found=True)))


def _text(path: str) -> str:
    store, at = _store(path)
    with store.open_input_stream(at) as f:
        return f.read().decode()


def index(path: str) -> list[dict]:
    """(file, partition, first, last) of all published files."""
    out = []
    for append in _names(f"{path}/{INDEX}"):
        parts = _names(f"{path}/{INDEX}/{append}")
        if "_SUCCESS" in parts:  # else it isn't whole
            out += [json.loads(line) for part in parts if part.endswith(".json") for line in _text(f"{path}/{INDEX}/{append}/{part}").splitlines()]
    return out


def publish(spark: SparkSession, path: str) -> int:
    """Adds the files that the index doesn't have, and reads these alone. Returns their number; again, it is 0.

    A log has one writer at a time; it publishes after each append, and a writer that died before is made good by the next.
    """
    known = {row["file"] for row in index(path)}
    fresh = [name for name in _names(path) if name[0] not in "_." and name not in known]
    if fresh:
        rows = spark.read.schema(LOG).json([f"{path}/{name}" for name in fresh]).select(F.col("_metadata.file_name").alias("file"), "partition", "offset")
        spans = rows.groupBy("file", "partition").agg(F.min("offset").alias("first"), F.max("offset").alias("last"))
        spans.coalesce(1).write.json(f"{path}/{INDEX}/{len(_names(f'{path}/{INDEX}')):08d}")  # a row for each file and partition
    return len(fresh)


class Span(InputPartition):
    """Of one file the offsets [first, end) of each partition in ``wanted``."""

    def __init__(self, path: str, wanted: Mapping[int, tuple[int, int]]):
        self.path, self.wanted = path, wanted


def _spans(path: str, start: Mapping[str, int], end: Mapping[str, int]) -> list[InputPartition]:
    files: dict[str, dict[int, tuple[int, int]]] = {}
    for row in index(path):
        p = str(row["partition"])
        first, last = start.get(p, 0), end.get(p, 0)
        if row["first"] < last and row["last"] >= first:
            files.setdefault(row["file"], {})[row["partition"]] = (first, last)
    return [Span(f"{path}/{name}", wanted) for name, wanted in sorted(files.items())]


def _records(span: Span) -> Iterator:
    import pyarrow as pa

    store, at = _store(span.path)
    columns, types = LOG.names, pa.schema([("key", pa.string()), ("value", pa.string()), ("topic", pa.string()), ("partition", pa.int32()), ("offset", pa.int64())])
    rows: list[dict] = []
    with store.open_input_stream(at) as f:
        for line in _lines(f):
            row = json.loads(line)
            first, end = span.wanted.get(row["partition"], (0, 0))
            if first <= row["offset"] < end:
                rows.append({c: row.get(c) for c in columns})
            if len(rows) == ROWS:
                yield pa.RecordBatch.from_pylist(rows, types)
                rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, types)


def _lines(f) -> Iterator[bytes]:
    """Lines without an empty one, a block at a time: only ``\\n`` ends a line, as JSON escapes it inside a value."""
    left = b""
    while block := f.read(1 << 20):
        *whole, left = (left + block).split(b"\n")
        yield from filter(None, whole)
    if left:
        yield left


class _Whole(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> Sequence[InputPartition]:
        return _spans(self.path, {}, _ends(self.path)) or [Span("", {})]

    def read(self, partition: InputPartition) -> Iterator:
        return _records(partition) if partition.path else iter(())


def _ends(path: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for row in index(path):
        p = str(row["partition"])
        out[p] = max(out.get(p, 0), row["last"] + 1)
    return out


def advanced(start: Mapping[str, int], ends: Mapping[str, int], limit: int) -> dict[str, int]:
    """Offsets up to ``limit`` records on, shared by the partitions as their backlogs are; each with a backlog moves by one or more."""
    behind = {p: end - start.get(p, 0) for p, end in ends.items()}
    whole = sum(behind.values())
    if whole <= limit:
        return dict(ends)
    return {p: start.get(p, 0) + (max(1, n * limit // whole) if n > 0 else 0) for p, n in behind.items()}


class _Stream(DataSourceStreamReader):
    """An offset is the next one to be read of each partition.

    With ``limit``, a batch is about so many records. Spark doesn't tell a source where its last batch ended, so the offsets
    that were planned are kept in the file ``progress`` before Spark logs them: if the driver is lost between the two, the
    next batch is that much larger, and no record is skipped or read twice.
    """

    def __init__(self, options: Mapping[str, str]):
        self.path, self.progress, self.limit = options["path"], options.get("progress"), int(options.get("limit", 0))
        if self.limit and not self.progress:
            raise ValueError("a limit needs a file for progress")

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        ends = _ends(self.path)
        if not self.limit:
            return ends
        folder, _, name = self.progress.rpartition("/")
        planned = json.loads(_text(self.progress)) if name in _names(folder) else {}
        ends = advanced(planned, ends, self.limit)
        store, at = _store(self.progress)
        store.create_dir(at.rpartition("/")[0])
        with store.open_output_stream(at) as f:
            f.write(json.dumps(ends).encode())
        return ends

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return _spans(self.path, start, end)

    def read(self, partition: InputPartition) -> Iterator:
        return _records(partition)


class Log(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        return LOG

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Whole(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options)


def replay(spark: SparkSession, path: str) -> DataFrame:
    """The whole log as it is published, as a batch."""
    spark.dataSource.register(Log)
    return spark.read.format(NAME).option("path", path).load()


def stream(spark: SparkSession, path: str, limit: int = 0, progress: str | None = None) -> DataFrame:
    """The log as a stream. ``availableNow`` takes what is published in one batch; with a ``limit``, run it by processing
    time, with one file ``progress`` for each query, which goes if the checkpoint goes."""
    spark.dataSource.register(Log)
    reader = spark.readStream.format(NAME).option("path", path).option("limit", limit)
    return (reader.option("progress", progress) if progress else reader).load()
