"""Connected components by alternating large-star and small-star steps.

Edges are pairs of 64-bit node ids. Each step is two aggregations or joins on a node id; nothing is gathered per
component, so a component may hold any share of the nodes. The number of steps grows with the logarithm of the
longest path. Each step's edges are written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm.common import discard, written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.xxhash64("a", "b") % 1000003).alias("s")).first()
    return row["n"], row["x"], row["s"]


def _nearest(pairs: DataFrame) -> DataFrame:
    """The least neighbour (or itself) of each node. Written, so that the join back can split a node with many edges."""
    least = pairs.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("m"))
    return written(least, "least")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _nearest(both)
    moved = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = written(moved.filter("a != b").distinct(), "large")
    discard(least)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _nearest(down)
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    out = written(moved.filter("a != b").distinct(), "small")
    discard(least)
    return out


def component_labels(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of longs -> (node, label): label is the least node of the component.

    Nodes without an edge to another node have no row; self-loops and repeated edges change nothing; no edges, no rows.
    The result is a written table, which the caller discards.
    """
    now = written(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        large = _large_star(now)
        after = _small_star(large)
        discard(large, now)
        now = after
        if (new := _state(now)) == state:
            break
        state = new
    out = written(now.select(F.col("a").alias("node"), F.col("b").alias("label")), "labels")
    discard(now)
    return out
