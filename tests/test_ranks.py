"""The order index of boards against whole ranked boards."""

from __future__ import annotations

import math
import random

import pytest

from emberlake.operators import leaderboard
from emberlake.schema import LEADERBOARD
from emberlake.streaming import ranks


def plain(best):
    order = sorted(best.items(), key=lambda e: (e[1], e[0]), reverse=True)
    return {player: (k + 1, score) for k, (player, score) in enumerate(order)}


def rows_of(batch, period="alltime"):
    return [("g", period, player, score) for player, score in batch]


@pytest.mark.parametrize(("width", "fan", "levels"), [(1.0, 1024, 4), (0.5, 2, 3)])
def test_ranks_of_all_players_after_batches_and_folds(spark, tmp_path, width, fan, levels):
    """Ties, negative and huge scores, scores that rise, fall and stay; every player's rank is that of the whole board."""
    rng = random.Random(5)
    pick = [0.0, -0.0, 7.0, 7.5, -3.25, 1e15, -1e15, 1e300, -1e300, 0.1]
    index = ranks.RankIndex(spark, str(tmp_path / "ix"), width, fan, levels, fold_every=2)
    best: dict[str, float] = {}
    for k in range(3):
        batch = [(f"p{rng.randrange(12)}", rng.choice(pick) if rng.random() < 0.7 else rng.uniform(-50, 50)) for _ in range(14)]
        df = spark.createDataFrame(rows_of(batch) + rows_of(batch[:2], "2024-01-01"), LEADERBOARD)
        index.apply(ranks.changes(index.scores.state(), df), k)
        for player, score in batch:
            best[player] = max(best.get(player, -math.inf), score)
        if k == 2:
            want = plain(best)
            got = {p: tuple(index.rank("g", p).first()[c] for c in ("rank", "score")) for p in want}
            assert got == want
    assert index.rank("g", "nobody").count() == 0 and index.rank("other", "p1").count() == 0
    assert {r["player_id"]: r["n"] for r in index.entries.state().filter("period = 'alltime'").collect()} == dict.fromkeys(best, 1)


def test_batch_twice_and_unmarked(spark, tmp_path):
    index = ranks.RankIndex(spark, str(tmp_path / "ix"))
    first = spark.createDataFrame([("g", "alltime", "a", None, 5.0), ("g", "alltime", "b", None, 9.0)], ranks.CHANGES)
    index.apply(first, 0)
    index.apply(first, 0)
    assert index.rank("g", "a").first()["rank"] == 2
    mark = index.commits.mark
    index.commits.mark = lambda batch_id: None  # the writer ends before the mark
    second = spark.createDataFrame([("g", "alltime", "a", 5.0, 20.0)], ranks.CHANGES)
    index.apply(second, 1)
    assert index.rank("g", "a").first()["rank"] == 2
    index.commits.mark = mark
    index.apply(second, 1)
    assert [index.rank("g", p).first()["rank"] for p in "ab"] == [1, 2]


def test_a_question_reads_counts_and_one_range(spark, tmp_path):
    """Both filters reach the scans, so blocks beside the player's own are skipped by their statistics."""
    index = ranks.RankIndex(spark, str(tmp_path / "ix"))
    board = spark.range(20000).selectExpr("'g' AS project_id", "'alltime' AS period", "concat('p', id) AS player_id", "cast(null AS double) AS old_score", "cast(id % 5000 AS double) AS score")
    index.apply(board, 0)
    asked = index.rank("g", "p4321")
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    text = asked._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(block,4321)" in text and "GreaterThan(block," in text and "Python" not in text
    want = leaderboard.player_rank(index.scores.state(), "g", "p4321").first()
    assert asked.first().asDict() == want.asDict()


def test_empty_index_and_wrong_questions(spark, tmp_path):
    index = ranks.RankIndex(spark, str(tmp_path / "ix"))
    assert index.rank("g", "p").count() == 0
    with pytest.raises(ValueError):
        index.rank("g", "")
    with pytest.raises(ValueError):
        index.rank("g", "p", "yesterday")
    with pytest.raises(ValueError):
        ranks.RankIndex(spark, str(tmp_path / "ix"), fan=1)
