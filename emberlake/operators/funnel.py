"""First-seen steps of actors, and ordered funnels with conversion rates."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.functions import keys, time


def first_seen(events: DataFrame) -> DataFrame:
    """(project_id, actor_id, event_type, first_seen_at); events without actor and session are left out."""
    who = events.withColumn("__actor", keys.actor_key(F.col("actor_id"), F.col("session_id"))).filter("__actor is not null")
    return who.groupBy("project_id", F.col("__actor").alias("actor_id"), F.col("type").alias("event_type")).agg(F.min("occurred_at").alias("first_seen_at"))


def first_of(states: DataFrame) -> DataFrame:
    """The earliest time of each actor and type among the rows of several states."""
    return states.groupBy("project_id", "actor_id", "event_type").agg(F.min("first_seen_at").alias("first_seen_at"))


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    return first_of(old.unionByName(new))


def parse_steps(text: str | Sequence[str]) -> list[str]:
    """Distinct event types from a comma list, blanks dropped; 2 to 10 of them."""
    steps = [s for s in map(str.strip, text.split(",") if isinstance(text, str) else text) if s]
    if not 2 <= len(steps) <= 10 or len(set(steps)) < len(steps):
        raise ValueError("a funnel has 2 to 10 different steps")
    return steps


def funnel(state: DataFrame, project_id: str, steps: str | Sequence[str], start: str | datetime, end: str | datetime) -> DataFrame:
    """(step, event_type, actors, conversion_rate) for each step: actors who did steps 1 to k in order of first sight.

    The window bounds the first time of all that an actor did a step. Equal times count as ordered. The rate is over
    the actors of step 1, and 0 if there are none.
    """
    steps = parse_steps(steps)
    low, high = time.instant(start), time.instant(end)
    if low > high:
        raise ValueError("the window is reversed")
    seen = state.filter((F.col("project_id") == project_id) & F.col("event_type").isin(steps) & F.col("first_seen_at").between(F.lit(low), F.lit(high)))
    times = [F.min(F.when(F.col("event_type") == s, F.col("first_seen_at"))).alias(f"t{k}") for k, s in enumerate(steps)]
    actors = seen.groupBy("actor_id").agg(*times)
    reached, counts = F.col("t0").isNotNull(), []
    for k in range(len(steps)):
        reached = reached if not k else reached & (F.col(f"t{k}") >= F.col(f"t{k - 1}"))
        counts.append(F.count_if(reached).alias(f"n{k}"))
    rows = F.array(*(F.struct(F.lit(k + 1).alias("step"), F.lit(s).alias("event_type"), F.col(f"n{k}").alias("actors")) for k, s in enumerate(steps)))
    rate = F.when(F.col("n0") > 0, keys.round4(F.col("x.actors") / F.col("n0"))).otherwise(F.lit(0.0))
    return actors.agg(*counts).select("n0", F.explode(rows).alias("x")).select("x.*", rate.alias("conversion_rate")).orderBy("step")
