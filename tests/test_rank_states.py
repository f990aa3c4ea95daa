"""Best scores as keyed states that many players share, over batches and a restart; a log whose batches are made once."""

from __future__ import annotations

import random

from emberlake.plans import queries
from emberlake.schema import LEADERBOARD
from emberlake.streaming import ranks, windows


def test_players_share_states(spark, tmp_path):
    rng = random.Random(3)
    names = [f"p{k}" for k in range(60)] + ['a","b', "/", "é\x1f"]
    pick = lambda: rng.choice([0.0, -0.0, 0.1, 1 / 3, -7.25, 1e300, rng.uniform(-9, 9)])
    best, seen = {}, []
    for _ in range(3):
        batch = [(rng.choice(("g", "h")), rng.choice(("alltime", "2024-01-01")), rng.choice(names), pick()) for _ in range(150)]
        spark.createDataFrame(batch, LEADERBOARD).write.mode("append").json(f"{tmp_path}/scores")
        changed = ranks.risen(spark.readStream.schema(LEADERBOARD).json(f"{tmp_path}/scores"), buckets=4)
        with windows.rocksdb(spark):
            run = changed.writeStream.foreachBatch(lambda df, k: seen.append([tuple(r) for r in df.collect()])).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        run.awaitTermination()
        assert run.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4
        top: dict = {}
        for *key, score in batch:
            top[tuple(key)] = max(score, top.get(tuple(key), score))
        want = {key: (best.get(key), score) for key, score in top.items() if key not in best or score > best[key]}
        assert {r[:3]: r[3:] for r in seen[-1]} == want and len(seen[-1]) == len(want)
        best |= {key: score for key, (_, score) in want.items()}
    assert len(seen) == 3


def test_batches_of_a_log_are_made_once(spark, tmp_path):
    rows = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            rows.add(len(frame))
            yield frame

    log = spark.range(90).selectExpr("'k' AS key", "'v' AS value", "id AS offset")
    path = queries._in_batches(log.mapInPandas(counted, log.schema), str(tmp_path), 3)
    assert rows.value == 90 and spark.read.json(path).count() == 90
