"""Streaming forms of the ping, stop-event, adherence and monitoring steps.

The daily batch stays the source of truth: rows later than the watermark are
dropped here and counted there, and a bus that never came only shows when the
day is closed.  Event time must be TIMESTAMP; a watermark on TIMESTAMP_NTZ is
not allowed, so local times are carried beside the instant.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from timepoint.functions.stats import flag_share, ratio
from timepoint.operators.adherence import DelayWindows, add_delay, late_early_flags, on_time_flags
from timepoint.operators.ordered import previous_value, same_keys_join
from timepoint.session import new_scratch
from timepoint.sources.positions import FEED_ZONE, flatten_positions, stream_snapshots

# One poll every five seconds.
POLL_SECONDS = 5


def stream_pings(spark: SparkSession, folder: str, zone: str = FEED_ZONE, camel_case: bool = False) -> DataFrame:
    """Vehicle reports of a live landing folder."""
    return flatten_positions(stream_snapshots(spark, folder, camel_case=camel_case), zone)


def stream_dedup(df: DataFrame, keys: Sequence[str], event_time: str, delay: str) -> DataFrame:
    """The first copy of each report; polling sees an unchanged report again and again."""
    return df.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_stop_events(
    df: DataFrame, keys: Sequence[str], event_time: str, tie: Sequence[str] = (), span: str = "1 day"
) -> DataFrame:
    """Last report of each vehicle, trip and stop, out when its day is closed.

    ``df`` must carry a watermark on ``event_time``.
    """
    rest = [c for c in df.columns if c not in set(keys)]
    last = F.max_by(F.struct(*rest), F.struct(event_time, *tie)).alias("_row")
    grouped = df.groupBy(F.window(event_time, span).alias("span"), *keys).agg(last)
    return grouped.select("span", *keys, *[F.col("_row")[c].alias(c) for c in rest])


def stream_adherence(
    events: DataFrame,
    timetable: DataFrame,
    keys: Sequence[str],
    scheduled: str,
    observed: str,
    windows: DelayWindows = DelayWindows(),
) -> DataFrame:
    """Stop events against the static timetable, from the event side.

    Events without a scheduled time keep NULL flags.  Missing buses cannot show
    up here; the closing batch of the day adds them (``missing_buses`` on the
    landed events).
    """
    joined = events.join(timetable, list(keys), "left")
    return (
        joined.transform(add_delay, scheduled, observed)
        .transform(on_time_flags, "delay", windows)
        .transform(late_early_flags, "delay", windows)
    )


def stream_otp(adherence: DataFrame, event_time: str, by: Sequence[str] = (), width: str = "1 hour") -> DataFrame:
    """Counts and averages per window; medians are left to the daily batch."""
    return adherence.groupBy(F.window(event_time, width).alias("span"), *by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("delay").alias("n_scheduled"),
        flag_share(F.col("on_time")).alias("on_time_perc"),
        flag_share(F.col("on_time_5")).alias("on_time_perc_5"),
        flag_share(F.col("on_time_4")).alias("on_time_perc_4"),
        flag_share(F.col("on_time_20")).alias("on_time_perc_20"),
        F.avg("delay").alias("mean_delay"),
    )


def feed_gap_monitor(
    polls: DataFrame, event_time: str, width: str = "1 hour", expected: int = 3600 // POLL_SECONDS
) -> DataFrame:
    """Polls per window against the number there should be; ``with_dead_windows`` adds windows without any poll."""
    counts = polls.groupBy(F.window(event_time, width).alias("span")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumns(
        {
            "expected": F.lit(expected).cast("bigint"),
            "missing": F.greatest(F.lit(expected) - F.col("n"), F.lit(0)).cast("bigint"),
            "share": ratio(F.col("n"), F.lit(expected)),
        }
    )


def with_open_windows(
    closed: DataFrame, landed: DataFrame, aggregate: Callable[[DataFrame], DataFrame], event_time: str
) -> DataFrame:
    """Windows a stream has given out, and those its watermark has not passed yet, from the landed rows.

    ``aggregate`` is the stream's own aggregation.  Windows close in order, so
    the rows of open ones are those from the end of the last closed window on.
    """
    end = closed.agg(F.max("span.end")).scalar()
    still_open = landed.where(end.isNull() | (F.col(event_time) >= end))
    return closed.unionByName(aggregate(still_open))


def with_open_sessions(closed: DataFrame, landed: DataFrame, aggregate: Callable[[DataFrame], DataFrame], event_time: str, keys: Sequence[str]) -> DataFrame:
    """Sessions a stream has given out, and those of each key that its watermark has not passed yet, from the landed rows."""
    ends = closed.groupBy(*keys).agg(F.max("span.end").alias("_end"))
    rows = same_keys_join(landed, ends, keys, "left").where(F.col("_end").isNull() | (F.col(event_time) >= F.col("_end")))
    return closed.unionByName(aggregate(rows.drop("_end")))


def with_dead_windows(windows: DataFrame, width: str = "1 hour") -> DataFrame:
    """``feed_gap_monitor`` rows with those of windows in which no poll came at all, from the first window to the last."""
    step = F.expr(f"INTERVAL {width}")
    ends = windows.agg(F.min("span.start").alias("first"), F.max("span.start").alias("last"), F.max("expected").alias("expected"))
    spine = ends.where("first IS NOT NULL").select(F.explode(F.sequence("first", "last", step)).alias("start"), "expected")
    span = F.struct(F.col("start"), (F.col("start") + step).alias("end")).cast(windows.schema["span"].dataType)
    spine = spine.select(span.alias("span"), F.lit(0).cast("bigint").alias("n"), "expected")
    dead = spine.join(windows.select("span"), "span", "left_anti")
    return windows.unionByName(dead.select("span", "n", "expected", F.col("expected").alias("missing"), F.lit(0.0).alias("share")))


def stream_headway(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    out: str,
    path: str,
    checkpoint: str,
    tie: Sequence[str] = (),
    rows_per_piece: int | None = None,
    horizon: float | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Time since the previous arrival of the group, across micro-batches.

    Each micro-batch runs the batch operator, so with ``rows_per_piece`` a hot
    group is ordered in pieces and not in one task.  What a batch needs from the earlier ones is
    one row for each group, its last arrival; it is kept as a table beside the
    checkpoint.  Batch n reads slot n-1 and replaces slot n (of three) and its
    own output, so a batch that is run again changes nothing.

    A row older than the last arrival already seen gets NULL: it is late, and
    the daily batch places it.  Groups whose last arrival is more than
    ``horizon`` (in the unit of ``at``) before the newest are forgotten, which
    bounds what is kept where the keys hold the day; give it more than a day.
    """
    keys, tie = list(keys), list(tie)

    def slot(number: int) -> str:
        return f"{checkpoint}/last-arrivals/slot={number % 3}"

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        rows = previous_value(batch, keys, at, "_before", tie, rows_per_piece)
        last = batch.where(F.col(at).isNotNull()).groupBy(*keys).agg(F.max(at).alias("_last"))
        if number > 0:
            seen = spark.read.parquet(slot(number - 1))
            carried = same_keys_join(rows, seen, keys, "left")
            late = F.col("_last") > F.col(at)
            # A late row lends its time to no row after it, nor takes one.
            before = F.when(late, F.lit(None)).otherwise(F.greatest("_before", "_last"))
            rows = carried.withColumn("_before", before).drop("_last")
            last = seen.unionByName(last).groupBy(*keys).agg(F.max("_last").alias("_last"))
        if horizon is not None:
            newest = last.agg(F.max("_last")).scalar()
            last = last.where(F.col("_last") >= newest - F.lit(horizon))
        result = rows.withColumn(out, F.col(at) - F.col("_before")).drop("_before")
        result.write.mode("overwrite").parquet(f"{path}/batch={number}")
        last.write.mode("overwrite").parquet(slot(number))
        batch.unpersist()

    writer = df.writeStream.foreachBatch(step).option("checkpointLocation", f"{checkpoint}/query")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def run_to_table(df: DataFrame, label: str) -> DataFrame:
    """Run a stream over everything that is there, into a table in the shared folder."""
    spark = df.sparkSession
    root = new_scratch(spark, label)
    query = (
        df.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{root}/rows")
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/rows")
