"""Active days of actors, and retention cohorts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.functions import keys

MOST_DAYS, MOST_OFFSET = 92, 90


def active_days(events: DataFrame) -> DataFrame:
    """The set (project_id, actor_id, active_period); events without actor and session are left out."""
    who = events.withColumn("__actor", keys.actor_key(F.col("actor_id"), F.col("session_id"))).filter("__actor is not null")
    return who.select("project_id", F.col("__actor").alias("actor_id"), F.to_date("occurred_at").alias("active_period")).distinct()


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).distinct()


def cohorts(days: DataFrame) -> DataFrame:
    """(project_id, actor_id, cohort): the first active day of all."""
    return days.groupBy("project_id", "actor_id").agg(F.min("active_period").alias("cohort"))


def _checked(start: str, end: str, max_offset: int) -> tuple[date, date]:
    low, high = date.fromisoformat(start), date.fromisoformat(end)
    if low > high or (high - low).days + 1 > MOST_DAYS:
        raise ValueError(f"the range is reversed or over {MOST_DAYS} days")
    if not 0 <= max_offset <= MOST_OFFSET:
        raise ValueError(f"max_offset is from 0 to {MOST_OFFSET}")
    return low, high


def retention_matrix(days: DataFrame, project_id: str, start: str, end: str, max_offset: int = 7) -> DataFrame:
    """(cohort, day_offset, actors), ordered, of cohorts whose first day of all lies in the range.

    One shuffle on the actor: the days of an actor are a bounded set, so the cohort is found beside them and no
    self-join is needed. Days are a set, so a plain count is a distinct one.
    """
    low, high = _checked(start, end, max_offset)
    own = days.filter(F.col("project_id") == project_id).groupBy("actor_id").agg(F.min("active_period").alias("cohort"), F.collect_set("active_period").alias("days"))
    inside = own.filter(F.col("cohort").between(F.lit(low), F.lit(high)))
    gaps = inside.select("cohort", F.explode("days").alias("day")).select(F.date_format("cohort", "yyyy-MM-dd").alias("cohort"), F.datediff("day", "cohort").alias("day_offset"))
    return gaps.filter(F.col("day_offset").between(0, max_offset)).groupBy("cohort", "day_offset").agg(F.count("*").alias("actors")).orderBy("cohort", "day_offset")


def nested_cohorts(matrix: DataFrame) -> DataFrame:
    """(cohort, size, offsets): the size is that of offset 0, offsets are structs in ascending order. Bounded by days."""
    size = F.max(F.when(F.col("day_offset") == 0, F.col("actors")))
    return matrix.groupBy("cohort").agg(F.coalesce(size, F.lit(0)).alias("size"), F.array_sort(F.collect_list(F.struct("day_offset", "actors"))).alias("offsets")).orderBy("cohort")


#: Days of a word of a bitmap: its sign is left alone.
WORD_DAYS = 62


def _merged(words: DataFrame) -> DataFrame:
    return words.groupBy("project_id", "actor_id", "word").agg(F.bit_or("bits").alias("bits"))


def day_words(days: DataFrame) -> DataFrame:
    """Active days as bitmaps: (project_id, actor_id, word, bits), bit k of a word being day 62 * word + k since 1970."""
    number = F.unix_date("active_period")
    bit = F.expr(f"shiftleft(1L, cast(pmod(unix_date(active_period), {WORD_DAYS}) as int))")
    return _merged(days.select("project_id", "actor_id", F.floor(number / WORD_DAYS).cast("int").alias("word"), bit.alias("bits")))


def merge_words(old: DataFrame, new: DataFrame) -> DataFrame:
    """Bitmaps of two parts as one: days that come late, again, or before the first so far just set their bits."""
    return _merged(old.unionByName(new))


def matrix_from_words(words: DataFrame, project_id: str, start: str, end: str, max_offset: int = 7) -> DataFrame:
    """As ``retention_matrix``, from bitmaps: an actor's first day is the lowest bit of its first word, and the actors of a
    cohort on a day are counted by summing bits, a row for each cohort and word, whatever the number of days."""
    low, high = _checked(start, end, max_offset)
    own = words.filter(F.col("project_id") == project_id)
    lowest = F.bit_count(F.col("bits").bitwiseAND(-F.col("bits")) - 1)
    first = own.groupBy("actor_id").agg(F.min(F.col("word") * WORD_DAYS + lowest).alias("cohort"))
    first = first.filter(F.col("cohort").between(*(F.unix_date(F.lit(d)) for d in (low, high))))
    near = own.join(first, "actor_id").filter(F.col("word") * WORD_DAYS <= F.col("cohort") + max_offset)
    sums = F.array(*(F.sum(F.shiftright("bits", k).bitwiseAND(F.lit(1))) for k in range(WORD_DAYS)))
    counted = near.groupBy("cohort", "word").agg(sums.alias("sums")).select("cohort", "word", F.posexplode("sums").alias("bit", "actors"))
    offset = (F.col("word") * WORD_DAYS + F.col("bit") - F.col("cohort")).cast("int")
    shown = counted.select(F.date_format(F.date_from_unix_date(F.col("cohort").cast("int")), "yyyy-MM-dd").alias("cohort"), offset.alias("day_offset"), "actors")
    return shown.filter(F.col("day_offset").between(0, max_offset) & (F.col("actors") > 0)).orderBy("cohort", "day_offset")
