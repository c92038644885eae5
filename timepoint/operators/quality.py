"""Completeness of the recorded feed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshot_counts(df: DataFrame, day: str = "day", hour: str = "hour") -> DataFrame:
    """Snapshots per day and hour folder."""
    return df.groupBy(day, hour).agg(F.count(F.lit(1)).alias("n"))


def snapshot_gaps(df: DataFrame, days: DataFrame, hours: range, day: str = "day", hour: str = "hour") -> DataFrame:
    """The same against every day and hour that should be there, gaps as 0."""
    spine = days.select(day).withColumn(hour, F.explode(F.sequence(F.lit(hours[0]), F.lit(hours[-1]))))
    spine = spine.withColumn(hour, F.col(hour).cast(df.schema[hour].dataType))
    counts = spine.join(snapshot_counts(df, day, hour), [day, hour], "left")
    return counts.withColumn("n", F.coalesce("n", F.lit(0)))


def poll_sessions(polls: DataFrame, event_time: str, gap: str, keys: Sequence[str] = ()) -> DataFrame:
    """Unbroken runs of polls of each feed: no two neighbours are ``gap`` or more apart.

    The same for a table and for a stream with a watermark, where a late poll that lies between two runs merges them as long
    as the watermark has not passed the earlier one.
    """
    runs = polls.groupBy(*keys, F.session_window(event_time, gap).alias("span"))
    return runs.agg(F.min(event_time).alias("first_poll"), F.max(event_time).alias("last_poll"), F.count(F.lit(1)).alias("n_polls"))


def outage_spells(sessions: DataFrame, step_seconds: int, keys: Sequence[str] = ()) -> DataFrame:
    """Spells without polls between the runs: last poll before, first one after, seconds, and the polls missed meanwhile.

    Runs are few beside the polls, one for each spell, so their order within a feed is a plain window.
    """
    seconds = F.unix_micros("resumed").cast("long") - F.unix_micros("stopped").cast("long")
    before = F.lag("last_poll").over(Window.partitionBy(*keys).orderBy("first_poll"))
    spells = sessions.withColumn("stopped", before).withColumn("resumed", F.col("first_poll")).where("stopped IS NOT NULL")
    missed = F.greatest(F.ceil(seconds / (1_000_000 * step_seconds)) - 1, F.lit(0)).cast("bigint")
    return spells.select(*keys, "stopped", "resumed", (seconds / 1_000_000).alias("seconds"), missed.alias("missed"))
