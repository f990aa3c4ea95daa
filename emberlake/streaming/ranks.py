"""An order index of boards: the rank of one player from counts of score ranges, without a scan of the board.

Scores lie in blocks, blocks in wider ones, over several levels. Kept are the number of entries of each block, and the
entries clustered by narrowest block. A rank is one more than the entries in the blocks above the player's own, at each
level inside the same wider block, and those ahead in the narrowest: a question reads counts and one range of entries.

Counts and entries are sums of signed changes (a better score takes an entry out and puts one in), so a batch writes the
changes of its own players, and parts can be read and folded in any order.
"""

from __future__ import annotations

import functools
import json
import operator
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from emberlake.operators import leaderboard
from emberlake.schema import LEADERBOARD, struct
from emberlake.sources import shared
from emberlake.streaming import windows
from emberlake.streaming.store import Batches, Commits

# processes that start a stream's states see none of the session's Python files, so they are sent this module's code
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEY = ["project_id", "period", "player_id"]
CHANGES = struct("project_id string, period string, player_id string, old_score double, score double")
ENTRIES = struct("project_id string, period string, block long, score double, player_id string, n long")
COUNTS = struct("project_id string, period string, level int, parent long, block long, n long")
#: Of each player of a board in a bucket the best score, as JSON: floats are read as they were written.
BEST = struct("scores string")
RANK = struct("project_id string, period string, player_id string, rank long, score double")


def blocks(score: Column, width: float, fan: int, levels: int) -> list[Column]:
    """The blocks of a score, narrowest first: each is a monotone function of the one before, so they nest for any score."""
    out = [F.floor(score / F.lit(width)).cast("long")]
    for _ in range(levels - 1):
        out.append(F.floor(out[-1] / F.lit(fan)).cast("long"))
    return out


def changes(board: DataFrame, scores: DataFrame) -> DataFrame:
    """Of players in ``scores`` whose best score is new or above that of ``board``: CHANGES. Equal scores change nothing."""
    old = board.select(*KEY, F.col("score").alias("old_score"))
    return leaderboard.best_of(scores).join(old, KEY, "left").filter("old_score is null or score > old_score").select(*CHANGES.names)


class Risen(StatefulProcessor):
    """Of each player in a bucket of boards the best score so far; a better one comes out with the one that it replaces."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", BEST)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803  names of the interface
        found: dict = {}
        for row in rows:
            own, score = row["__key"], row["score"]
            if own not in found or score > found[own]["score"]:
                found[own] = row
        held = self.best.get()
        best = json.loads(held[0]) if held else {}
        better = {own: row for own, row in found.items() if own not in best or row["score"] > best[own]}
        if better:
            old = {own: best.get(own) for own in better}
            best.update((own, row["score"]) for own, row in better.items())
            self.best.update((json.dumps(best, separators=(",", ":")),))
            for own, row in better.items():
                yield Row(**{c: row[c] for c in KEY}, old_score=old[own], score=row["score"])

    def close(self) -> None:
        pass


def risen(scores: DataFrame, buckets: int = windows.BUCKETS) -> DataFrame:
    """A stream of board scores as a stream of CHANGES; nothing of history but the states of a batch's own players is read.

    Players are dealt to ``buckets`` states by the hash of board and player: a batch asks once for each state of its own
    players, as asking costs far more than reading some hundred scores. The number is fixed for a checkpoint.
    """
    shown = scores.select(*KEY, "score", F.to_json(F.array(*KEY)).alias("__key"))
    dealt = shown.withColumn("__bucket", F.pmod(F.xxhash64("__key"), F.lit(buckets)))
    return dealt.groupBy("__bucket").transformWithState(Risen(), CHANGES, "Append", "ProcessingTime")


def _summed(rows: DataFrame) -> DataFrame:
    keys = [c for c in rows.columns if c not in ("n", "batches")]
    return rows.groupBy(*keys).agg(F.sum("n").alias("n")).filter("n != 0")


class RankIndex:
    """Counts, entries and own scores under ``root``; readers see whole batches, and a batch that runs twice counts once.

    ``width`` is that of the narrowest blocks; ``fan`` of them make one of the next level. A question reads the occupied
    blocks beside the player's own, at most ``fan`` a level below the widest, so levels are to reach over the span of scores.
    Entries of one score, however many, are read by as many tasks as their files have splits.
    """

    def __init__(self, spark: SparkSession, root: str, width: float = 1.0, fan: int = 1024, levels: int = 4, fold_every: int = 16):
        if width <= 0 or fan < 2 or levels < 1:
            raise ValueError("width is above 0, fan 2 or more, levels 1 or more")
        self.spark, self.fold_every = spark, fold_every
        self.blocks = functools.partial(blocks, width=width, fan=fan, levels=levels)
        self.commits = Commits(spark, root)
        self.entries = Batches(spark, root, "rank_entries", ENTRIES, _summed, commits=self.commits, order=["project_id", "period", "block"])
        self.counts = Batches(spark, root, "rank_counts", COUNTS, _summed, commits=self.commits, order=["project_id", "period", "level", "parent", "block"])
        self.scores = Batches(spark, root, "rank_scores", LEADERBOARD, leaderboard.best_of, commits=self.commits, order=KEY)

    def _levels(self) -> Column:
        """An array of (level, parent, block); the widest blocks have no parent, which is 0."""
        of = self.blocks(F.col("score"))
        return F.array(*(F.struct(F.lit(k).alias("level"), parent.alias("parent"), block.alias("block")) for k, (block, parent) in enumerate(zip(of, [*of[1:], F.lit(0).cast("long")], strict=True))))

    def apply(self, changed: DataFrame, batch_id: int) -> None:
        """Adds a batch of CHANGES, one row for each player of a board."""
        kept = shared.written(changed, "changes")
        came = kept.select(*KEY, "score", F.lit(1).cast("long").alias("n"))
        went = kept.filter("old_score is not null").select(*KEY, F.col("old_score").alias("score"), F.lit(-1).cast("long").alias("n"))
        signed = came.unionByName(went)
        self.entries.put(signed.withColumn("block", self.blocks(F.col("score"))[0]), batch_id)
        self.counts.put(_summed(signed.select("project_id", "period", F.explode(self._levels()).alias("at"), "n").select("project_id", "period", "at.*", "n")), batch_id)
        self.scores.put(kept, batch_id)
        self.commits.mark(batch_id)
        shared.discard(kept)
        if self.fold_every and batch_id and batch_id % self.fold_every == 0:
            self.fold(batch_id - 1)

    def fold(self, upto: int) -> None:
        for table in (self.entries, self.counts, self.scores):
            table.fold(upto)
        self.commits.compact(upto)

    def run(self, scores: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Keeps the index of a stream of board scores (project_id, period, player_id, score)."""
        with windows.rocksdb(self.spark):
            sink = risen(scores).writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
            return sink.trigger(**(trigger or {"availableNow": True})).start()

    def rank(self, project_id: str, player_id: str, period: str = leaderboard.ALL_TIME) -> DataFrame:
        """Rank and score of one player, as ``leaderboard.player_rank``; no row if the player has none."""
        if not player_id:
            raise ValueError("player_id is empty")
        leaderboard.check_period(period)
        marked = self.commits.known()  # one moment for all three tables

        def board(table: Batches) -> DataFrame:
            return table.state(marked).filter((F.col("project_id") == project_id) & (F.col("period") == period))

        own = board(self.scores).filter(F.col("player_id") == player_id).select("score", self._levels().alias("levels")).first()
        if own is None:
            return self.spark.createDataFrame([], RANK)
        above = (((F.col("level") == at["level"]) & (F.col("parent") == at["parent"]) & (F.col("block") > at["block"])) for at in own["levels"])
        ahead = (F.col("score") > own["score"]) | ((F.col("score") == own["score"]) & (F.col("player_id") > player_id))
        near = board(self.entries).filter((F.col("block") == own["levels"][0]["block"]) & ahead)
        both = board(self.counts).filter(functools.reduce(operator.or_, above)).select("n").unionByName(near.select("n"))
        rank = (F.coalesce(F.sum("n"), F.lit(0)) + 1).alias("rank")
        return both.agg(rank).select(F.lit(project_id).alias("project_id"), F.lit(period).alias("period"), F.lit(player_id).alias("player_id"), "rank", F.lit(own["score"]).alias("score"))
