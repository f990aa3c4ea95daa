"""The log of files as a data source: offsets, restarts, limits."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from emberlake.sources import log, segments


def appended(spark, path, first, last, publish=True):
    rows = spark.range(first, last).select(F.concat(F.lit("k"), F.col("id") % 7).alias("key"), F.concat(F.lit("a   line\n"), "id").alias("value"), F.lit("t").alias("topic"), "id")
    log.append_records(spark, rows, path, 3, [("id", True)])
    return segments.publish(spark, path) if publish else 0


def run(spark, path, checkpoint, **options):
    """The batches of a run over what is published, as lists of (partition, offset)."""
    batches = []
    stream = segments.stream(spark, path, **options)
    sink = stream.writeStream.foreachBatch(lambda df, k: batches.append([(r["partition"], r["offset"]) for r in df.collect()]))
    trigger = {"processingTime": "0 seconds"} if options else {"availableNow": True}
    q = sink.option("checkpointLocation", checkpoint).trigger(**trigger).start()
    try:
        if options:
            q.processAllAvailable()
        else:
            q.awaitTermination(60)
    finally:
        q.stop()
    return [b for b in batches if b]


def test_restart_goes_on_at_the_offset(spark, tmp_path):
    path, checkpoint = str(tmp_path / "log"), str(tmp_path / "cp")
    assert appended(spark, path, 0, 40) > 0 and segments.publish(spark, path) == 0
    first = run(spark, path, checkpoint)
    appended(spark, path, 40, 70)
    second = run(spark, path, checkpoint)
    assert [len(b) for b in first + second] == [40, 30]
    seen = sorted(first[0] + second[0])
    assert len(set(seen)) == 70
    for p in {p for p, _ in seen}:
        assert [o for q, o in seen if q == p] == list(range(sum(q == p for q, _ in seen)))
    assert run(spark, path, checkpoint) == []
    got = segments.replay(spark, path).collect()
    want = log.replay_files(spark, path).collect()
    assert sorted(got) == sorted(want) and len(got) == 70


def test_files_outside_a_batch_are_not_opened(spark, tmp_path):
    path = str(tmp_path / "log")
    appended(spark, path, 0, 20)
    before = segments._ends(path)
    appended(spark, path, 20, 30)
    old, new = segments._spans(path, {}, before), segments._spans(path, before, segments._ends(path))
    assert old and new and not {s.path for s in old} & {s.path for s in new}
    assert sum(len(b) for s in new for b in segments._records(s)) == 10


def test_unpublished_and_half_published_appends_are_not_seen(spark, tmp_path):
    path = str(tmp_path / "log")
    appended(spark, path, 0, 10)
    appended(spark, path, 10, 20, publish=False)
    assert segments.replay(spark, path).count() == 10
    torn = Path(path, segments.INDEX, "00000001")
    torn.mkdir()
    (torn / "part-0.json").write_text(json.dumps({"file": "x", "partition": 0, "first": 0, "last": 10**6}) + "\n")
    assert segments.replay(spark, path).count() == 10
    segments.publish(spark, path)
    assert segments.replay(spark, path).count() == 20


def test_limit(spark, tmp_path):
    path, checkpoint, progress = str(tmp_path / "log"), str(tmp_path / "cp"), str(tmp_path / "at" / "progress")
    appended(spark, path, 0, 50)
    batches = run(spark, path, checkpoint, limit=20, progress=progress)
    assert all(len(b) <= 22 for b in batches) and len(batches) >= 3
    appended(spark, path, 50, 60)
    batches += run(spark, path, checkpoint, limit=20, progress=progress)  # restarted
    every = [r for b in batches for r in b]
    assert len(every) == len(set(every)) == 60
    with pytest.raises(ValueError, match="progress"):
        segments._Stream({"path": path, "limit": "5"})


def test_advanced():
    assert segments.advanced({}, {"0": 5, "1": 5}, 10) == {"0": 5, "1": 5}
    assert segments.advanced({"0": 2}, {"0": 2, "1": 100, "2": 1}, 10) == {"0": 2, "1": 9, "2": 1}


def test_empty_log(spark, tmp_path):
    assert segments.replay(spark, str(tmp_path / "none")).count() == 0
    assert run(spark, str(tmp_path / "none"), str(tmp_path / "cp")) == []
