"""The event log as a source and a sink: Kafka, or files with the same columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake import schema
from emberlake.functions import keys
from emberlake.operators import ranges, rawstore
from emberlake.sources import shared


def _columns(kafka: DataFrame) -> DataFrame:
    return kafka.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "topic", "partition", "offset")


def stream_kafka(spark: SparkSession, servers: str, topic: str, options: Mapping[str, str] | None = None) -> DataFrame:
    """The log as a stream; ``maxOffsetsPerTrigger`` bounds a batch. One query and checkpoint for each reader of the log."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return _columns(reader.options(**(options or {})).load())


def replay_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """The whole log from its start, as a batch."""
    return _columns(spark.read.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load())


def stream_files(spark: SparkSession, path: str, fmt: str = "json", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema.LOG).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def replay_files(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(schema.LOG).format(fmt).load(path)


def keyed_records(events: DataFrame) -> DataFrame:
    """(key, value) records of events, keyed by session, else actor, else event id."""
    raw = events.withColumn("time_bucket", F.lit(None).cast("string"))
    return raw.select(keys.partition_key(F.col("session_id"), F.col("actor_id"), F.col("event_id")).alias("key"), rawstore.envelope().alias("value"), "occurred_at")


def append_log(spark: SparkSession, events: DataFrame, path: str, partitions: int, topic: str = "raw-events") -> None:
    """Adds events to a log of files, in the order of event time, then of the record (``append_records``)."""
    append_records(spark, keyed_records(events).withColumn("topic", F.lit(topic)), path, partitions, [("occurred_at", True), ("value", True)])


def append_records(spark: SparkSession, records: DataFrame, path: str, partitions: int, order: Sequence[tuple[str, bool]]) -> None:
    """Adds records (key, value, topic, and what ``order`` names) to a log of files, with a partition and an offset as a broker gives them.

    A record's partition is that of its key by the log's own hash, so any producer puts it there. Offsets are dense: they go
    on after the greatest that the partition has, in ``order``. Records are placed by
    ranges, so a partition that one key fills is numbered by many tasks; only one number of each partition is read before.
    The log has one writer at a time. ``stream_files`` and ``replay_files`` read it as it stands.
    """
    made = records.withColumn("partition", keys.key_partition(F.col("key"), partitions))
    numbered = placed = ranges.placed(made, order, "partition")
    store = spark._jvm.org.apache.hadoop.fs.Path(path)
    if store.getFileSystem(spark._jsc.hadoopConfiguration()).exists(store):
        ends = replay_files(spark, path).groupBy(F.col("partition").alias("its_partition")).agg((F.max("offset") + 1).alias("begin"))
        placed = placed.join(F.broadcast(ends), F.col("partition") == F.col("its_partition"), "left").withColumn("place", F.col("place") + F.coalesce("begin", F.lit(0)))
    rows = placed.withColumn("offset", F.col("place").cast("long")).select(*schema.LOG.names)
    rows.sortWithinPartitions("partition", "offset").write.mode("append").json(path)
    shared.discard(numbered)


def write_log(events: DataFrame, path: str, partitions: int, fmt: str = "json") -> None:
    """Records of one key in one file, in the order of event time."""
    records = keyed_records(events).repartition(partitions, "key").sortWithinPartitions("key", "occurred_at")
    records.select("key", "value").write.mode("append").format(fmt).save(path)
