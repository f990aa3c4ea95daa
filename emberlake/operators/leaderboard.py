"""Best-score boards, all-time and daily, with unique ranks."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.functions import time
from emberlake.functions.binding import let
from emberlake.sources import shared

ALL_TIME = "alltime"


def score_events(events: DataFrame) -> DataFrame:
    """Events that carry a score: ``payload.playerId`` a text that isn't empty, ``payload.score`` a finite number.

    Types are tested before values are read: a text that looks like a number is no score.
    """

    def read(v: Column) -> Column:
        kind = lambda field: F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))
        number = kind("score").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
        player = F.when(kind("playerId") == "STRING", F.try_variant_get(v, "$.playerId", "string"))
        return F.struct(player.alias("player_id"), F.when(number, F.try_variant_get(v, "$.score", "double")).alias("score"))

    found = events.withColumn("__read", let(F.try_parse_json("payload"), read))
    found = found.withColumns({"player_id": F.col("__read.player_id"), "score": F.col("__read.score")}).drop("__read")
    return found.filter("player_id != '' and score is not null and not isnan(score) and abs(score) < double('Infinity')")


def board_scores(scores: DataFrame) -> DataFrame:
    """(project_id, period, player_id, score): each score once for the all-time board and once for its day's."""
    periods = F.explode(F.array(F.lit(ALL_TIME), time.day_period(F.col("occurred_at")))).alias("period")
    return scores.select("project_id", periods, "player_id", "score")


def best_scores(scores: DataFrame) -> DataFrame:
    """The greatest score of each player on each board: each score feeds the all-time and its day's board in one pass."""
    return best_of(board_scores(scores))


def best_of(boards: DataFrame) -> DataFrame:
    """The greatest score of each player among the rows of several boards."""
    return boards.groupBy("project_id", "period", "player_id").agg(F.max("score").alias("score"))


def last_of(writes: DataFrame) -> DataFrame:
    return writes.groupBy("project_id", "period").agg(F.max("last_write_at").alias("last_write_at"))


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """The greater score of each player: applying a batch twice changes nothing."""
    return best_of(old.unionByName(new))


def _best_first() -> list[Column]:
    return [F.desc("score"), F.desc("player_id")]


def ranked(board: DataFrame, top: int | None = None) -> DataFrame:
    """Boards with ``rank``; with ``top``, Spark's group limit keeps only so many rows a board before the shuffle.

    Whole boards are dealt by ranges of (board, score, player), so that a board of any size is ranked by many tasks: each
    numbers its range, and the counts of the ranges before it, one row for each, are added.
    """
    if top is not None:
        return board.withColumn("rank", F.row_number().over(Window.partitionBy("project_id", "period").orderBy(*_best_first()))).filter(F.col("rank") <= top)
    dealt = board.repartitionByRange("project_id", "period", *_best_first()).withColumn("__range", F.spark_partition_id())
    placed = shared.written(dealt, "board-ranges")  # the same ranges for the numbers and the counts
    own = Window.partitionBy("project_id", "period", "__range")
    counts = placed.groupBy("project_id", "period", "__range").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("project_id", "period").orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    numbered = placed.withColumn("__no", F.row_number().over(own.orderBy(*_best_first()))).join(counts.withColumn("__before", before), ["project_id", "period", "__range"])
    return numbered.select(*board.columns, (F.col("__before") + F.col("__no")).cast("int").alias("rank"))


def check_period(period: str) -> str:
    if period != ALL_TIME:
        if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", period):
            raise ValueError("a period is alltime or yyyy-MM-dd")
        date.fromisoformat(period)
    return period


def top_n(board: DataFrame, project_id: str, period: str = ALL_TIME, limit: int = 100) -> DataFrame:
    """The best players of one board: a bounded top-k, then ranks over those rows only."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit is from 1 to 1000")
    one = board.filter((F.col("project_id") == project_id) & (F.col("period") == check_period(period)))
    best = one.orderBy(*_best_first()).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("project_id", "period").orderBy(*_best_first()))).orderBy("rank")


def player_rank(board: DataFrame, project_id: str, player_id: str, period: str = ALL_TIME) -> DataFrame:
    """Rank and score of one player, without ranking the board: those ahead are counted. No row if the player has none."""
    if not player_id:
        raise ValueError("player_id is empty")
    one = board.filter((F.col("project_id") == project_id) & (F.col("period") == check_period(period)))
    own = one.agg(F.max(F.when(F.col("player_id") == player_id, F.col("score")))).scalar()  # one value, found before
    ahead = (F.col("score") > own) | ((F.col("score") == own) & (F.col("player_id") > player_id))
    counted = one.agg((F.count_if(ahead) + 1).alias("rank"), F.max(F.when(F.col("player_id") == player_id, F.col("score"))).alias("score")).filter("score is not null")
    return counted.select(F.lit(project_id).alias("project_id"), F.lit(period).alias("period"), F.lit(player_id).alias("player_id"), "rank", "score")


def live_daily_boards(board: DataFrame, last_writes: DataFrame, ttl_seconds: int, as_of: Column) -> DataFrame:
    """Boards without the daily ones whose last write (project_id, period, last_write_at) is older than the time to live."""
    alive = F.col("last_write_at") + F.make_interval(secs=F.lit(ttl_seconds)) > as_of
    live = last_writes.filter((F.col("period") == ALL_TIME) | alive)
    return board.join(live.select("project_id", "period"), ["project_id", "period"], "left_semi")
