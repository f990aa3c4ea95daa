"""What keeps the cost of a stream's batch in proportion to it: steps that are made once, states and files that are shared."""

from __future__ import annotations

import glob

from pyspark.sql import functions as F
from test_queries import SF

from emberlake.functions import keys
from emberlake.operators import envelope
from emberlake.plans import queries
from emberlake.sources import log
from emberlake.streaming import windows
from emberlake.streaming.views import Views


def _plan(df):
    spark = df.sparkSession
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    try:
        return df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_key_hash_has_each_step_once(spark):
    """Each word of a key is read once; before, the last steps held the whole hash sixteen times."""
    text = _plan(spark.range(1).select(keys.key_partition(F.col("id").cast("string"), 6).alias("p")))
    assert text.count("aggregate(") == 1 and text.count("conv(") == 2
    names = spark.createDataFrame([("",), ("a",), ("21",), ("foobar",), ("a-little-bit-long-string",), ("é€\U0001f600x",), (None,)], "k string")

    def murmur(data: bytes) -> int:
        m, h = 0x5BD1E995, 0x9747B28C ^ len(data)
        for i in range(0, len(data) // 4 * 4, 4):
            k = int.from_bytes(data[i : i + 4], "little") * m & 0xFFFFFFFF
            h = (h * m & 0xFFFFFFFF) ^ ((k ^ k >> 24) * m & 0xFFFFFFFF)
        if left := data[len(data) // 4 * 4 :]:
            h = (h ^ int.from_bytes(left, "little")) * m & 0xFFFFFFFF
        h = (h ^ h >> 13) * m & 0xFFFFFFFF
        return h ^ h >> 15

    for row in names.select("k", keys.key_hash(F.col("k")).alias("h")).collect():
        assert row["h"] == (None if row["k"] is None else murmur(row["k"].encode()))


def test_filters_do_not_parse_again(spark):
    text = _plan(envelope.split(queries._log(spark, SF).drop("offset").select("key", "value"))[0])
    assert text.count("jsonObjectKeys(") == 1


def test_a_batch_is_read_once(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            reads.add(len(frame))
            yield frame

    records = queries._log(spark, SF).limit(200)
    views = Views(spark, f"file://{tmp_path}/views", only=("counts",))
    views.apply(records.mapInPandas(counted, records.schema), 0)
    assert reads.value == 200
    assert views.by_hour.state().agg(F.sum("count")).scalar() is not None and views.letters.read().count() > 0


def test_keys_share_states(spark, tmp_path):
    """Many keys in few states: over two batches and a restart each key comes once, the least by offset, and null is a key."""
    rows = [(None if k == 7 else f"k{k % 50}", "v", "t", 0, 1000 - k) for k in range(200)]
    got = []
    for part in (rows[:120], rows[80:]):
        spark.createDataFrame(part, "key string, value string, topic string, partition int, offset long").write.mode("append").json(f"{tmp_path}/log")
        fresh = windows.first_sights(log.stream_files(spark, f"{tmp_path}/log"), F.col("key"), 3_600_000, buckets=4)
        with windows.rocksdb(spark):
            run = fresh.writeStream.foreachBatch(lambda df, k: got.extend(df.select("key", "offset").collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        run.awaitTermination()
        assert run.lastProgress["stateOperators"][0]["numRowsTotal"] <= 8  # a value and its expiry of each state
    first = {}
    for key, *_, offset in rows[:120]:
        first[key] = min(offset, first.get(key, offset))
    assert {r["key"]: r["offset"] for r in got} == first and len(got) == len(first) == 51


def test_batches_are_written_by_many_tasks(spark, tmp_path):
    path = queries._in_batches(queries._log(spark, SF), str(tmp_path), 2)
    assert len(glob.glob(f"{path}/*.json")) == 2 * queries.FILES
