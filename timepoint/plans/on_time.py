"""Reports on punctuality: reports of vehicles and a timetable to rates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timepoint.functions.clock import date_key, day_part, in_hours, service_seconds
from timepoint.operators.adherence import DelayWindows, assess
from timepoint.operators.joins import attach_names
from timepoint.operators.ordered import ROWS_PER_PIECE
from timepoint.operators.rollups import otp_grains, otp_period
from timepoint.operators.stop_events import STOP_KEYS, prepare_pings, stop_events
from timepoint.session import written
from timepoint.sources.sinks import combine_daily, write_daily
from timepoint.sources.tables import read_daily

MATCH_KEYS = ("route_id", "trip_id", "start_date", "stop_id")
HEADWAY_KEYS = ("stop_id", "route_id", "start_date", "direction_id")
TRIP_KEYS = ("route_id", "trip_id", "service_date", "block_id")
TIE = ("trip_id", "row", "vehicle_id", "label")


@dataclass(frozen=True)
class OnTimeReports:
    adherence: DataFrame
    daily: DataFrame
    system: DataFrame
    by_line: DataFrame
    by_stop: DataFrame


def observed_stops(pings: DataFrame) -> DataFrame:
    """Stop events with their clock as seconds of the service day they belong to."""
    # A poll may list a vehicle twice; its entities have ids of their own.
    tie = [c for c in ("source_file", "entity_id") if c in pings.columns]
    events = stop_events(prepare_pings(pings), STOP_KEYS, "ts", tie)
    day = F.to_date("start_date", "yyyyMMdd")
    return events.select(
        *MATCH_KEYS,
        "vehicle_id",
        "label",
        F.col("hour").alias("obs_hour"),
        F.col("minute").alias("obs_minute"),
        "lat",
        "lon",
        "ts",
        service_seconds(F.col("ts"), day).alias("obs_secs"),
    )


def adherence_table(
    pings: DataFrame, timetable: DataFrame, windows: DelayWindows = DelayWindows(), rows_per_piece: int = ROWS_PER_PIECE
) -> DataFrame:
    keyed = timetable.withColumn("start_date", date_key(F.col("service_date")))
    # The match reads its sightings twice, so they are made once.
    seen = written(observed_stops(pings), "stop-events")
    return assess(
        keyed, seen, MATCH_KEYS, HEADWAY_KEYS, TRIP_KEYS, tie=TIE, windows=windows, rows_per_piece=rows_per_piece
    )


def planned_arrivals(pings: DataFrame, timetable: DataFrame) -> DataFrame:
    """Stop events of planned trips: the matched part of the adherence table, without headways and coverage."""
    keyed = timetable.where(F.col("sched_secs").isNotNull()).withColumn("start_date", date_key(F.col("service_date")))
    return keyed.join(observed_stops(pings), list(MATCH_KEYS))


def on_time_reports(
    pings: DataFrame,
    timetable: DataFrame,
    work_path: str,
    windows: DelayWindows = DelayWindows(),
    routes: DataFrame | None = None,
    rows_per_piece: int = ROWS_PER_PIECE,
) -> OnTimeReports:
    """All reports.  The adherence table is written once, by day, and read by each.

    ``work_path`` is a folder every executor reaches.  The three grains come
    from one scan of it.
    """
    spark = pings.sparkSession
    built = adherence_table(pings, timetable, windows, rows_per_piece)
    write_daily(combine_daily(built), f"{work_path}/adherence")
    adherence = read_daily(spark, f"{work_path}/adherence")
    hour = F.col("sched_hour")
    study = adherence.where(in_hours(hour)).withColumn("time", day_part(hour))
    otp_grains(study, "route_name", "stop_id", fine_clock=True).write.mode("overwrite").parquet(f"{work_path}/daily")
    daily = spark.read.parquet(f"{work_path}/daily")

    def period(grain: str, *by: str) -> DataFrame:
        return otp_period(daily.where(F.col("grain") == grain), ["time", *by])

    by_line = period("line", "route_name")
    if routes is not None:
        by_line = attach_names(by_line, routes.withColumnRenamed("name", "route_name"), ["route_name"])
    return OnTimeReports(
        adherence, daily, period("system"), by_line.orderBy("on_time_perc", "route_name"), period("stop", "stop_id")
    )
