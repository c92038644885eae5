"""The published timetable: nested responses to one row for each trip and stop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timepoint.functions.clock import clock_parts
from timepoint.operators.ordered import first_per_key
from timepoint.schemas import TIMETABLE

DIRECTION_KEYS = ["route_id", "service_date", "direction_id"]
POSITION_KEYS = [*DIRECTION_KEYS, "row"]


def read_timetable(spark: SparkSession, path: str) -> DataFrame:
    """Responses with the file they stand in, which orders entries of one direction in several files."""
    read = spark.read.schema(TIMETABLE).option("multiLine", "true").json(path)
    return read.select("*", F.col("_metadata.file_path").alias("file"))


def _directions(responses: DataFrame) -> DataFrame:
    file = [F.col("file")] if "file" in responses.columns else []
    return responses.select(*file, F.posexplode("data").alias("entry", "d"))


def direction_trips(responses: DataFrame) -> DataFrame:
    """One row for each trip: its direction's fields ``d``, without the nested lists, and the trip ``t``."""
    entries = _directions(responses)
    own = F.struct(*[F.col("d")[c].alias(c) for c in ("route_id", "route_name", "service_date", "schedule_direction_id")])
    return entries.select(own.alias("d"), F.explode("d.schedule_times_for_trip").alias("t"))


def flatten_timetable(responses: DataFrame) -> DataFrame:
    """Trips and their stop times; ``row`` is the position inside the trip.

    Seconds may pass 86,400: a trip after midnight belongs to its service day.
    """
    return stop_times(direction_trips(responses))


def stop_times(trips: DataFrame, *more: Column) -> DataFrame:
    """One row for each stop time of ``direction_trips``; ``more`` columns may use ``pos``, the position from 0."""
    kept = [c for c in trips.columns if c not in ("d", "t")]
    times = trips.select("d", "t", *kept, F.posexplode("t.times").alias("pos", "s"))
    secs = F.col("s.timeSecs")
    parts = clock_parts(secs)
    return times.select(
        F.col("d.route_id").alias("route_id"),
        F.col("d.route_name").alias("route_name"),
        F.to_date("d.service_date").alias("service_date"),
        F.col("d.schedule_direction_id").alias("direction_id"),
        F.col("t.trip_id").alias("trip_id"),
        F.col("t.trip_headsign").alias("trip_headsign"),
        F.col("t.block_id").alias("block_id"),
        F.col("t.is_added_service").alias("is_added_service"),
        F.col("s.isWaitStop").alias("is_wait_stop"),
        secs.alias("sched_secs"),
        parts["hour"].alias("sched_hour"),
        parts["minute"].alias("sched_minute"),
        parts["second"].alias("sched_second"),
        (F.col("pos") + 1).cast("bigint").alias("row"),
        *more,
    )


def _first_lists(responses: DataFrame) -> DataFrame:
    """The stop list of each direction from its first entry: by file, then place in the response."""
    entries = _directions(responses).select(
        F.col("d.route_id").alias("route_id"),
        F.to_date("d.service_date").alias("service_date"),
        F.col("d.schedule_direction_id").alias("direction_id"),
        *([F.col("file")] if "file" in responses.columns else []),
        "entry",
        F.col("d.schedule_stops").alias("stops"),
    )
    order = [c for c in ("file", "entry") if c in entries.columns]
    # Where even these tie, the list itself decides, so that the result is always the same.
    return first_per_key(entries.withColumn("_text", F.to_json("stops")), DIRECTION_KEYS, [*order, "_text"]).select(
        *DIRECTION_KEYS, "stops"
    )


def direction_stops(responses: DataFrame) -> DataFrame:
    """The numbered stop list of each direction, taken from its first entry."""
    listed = _first_lists(responses).select(*DIRECTION_KEYS, F.posexplode("stops").alias("pos", "s"))
    return listed.select(
        "route_id",
        "service_date",
        "direction_id",
        (F.col("pos") + 1).cast("bigint").alias("row"),
        F.col("s.stopId").alias("stop_id"),
        F.col("s.stopName").alias("stop_name"),
    )


def timetable_stop_names(trips: DataFrame, stops: DataFrame, keys=POSITION_KEYS) -> DataFrame:
    """Stop of each timetable row, by position in the direction's stop list."""
    return trips.join(stops, list(keys), "left")


def build_timetable(responses: DataFrame) -> DataFrame:
    """Stop times with the stop at each position of the direction's list.

    The list is joined to the trips, one row each, and its element taken while
    the times are unfolded, so only trips are shuffled.
    """
    trips = direction_trips(responses)
    lists = _first_lists(responses).select(
        F.struct(*DIRECTION_KEYS).alias("key"), "stops"
    )
    key = F.struct(
        F.col("d.route_id").alias("route_id"),
        F.to_date("d.service_date").alias("service_date"),
        F.col("d.schedule_direction_id").alias("direction_id"),
    )
    with_lists = trips.withColumn("key", key).join(lists, "key", "left").drop("key")
    stop = F.get("stops", F.col("pos"))
    return stop_times(with_lists, stop["stopId"].alias("stop_id"), stop["stopName"].alias("stop_name"))
