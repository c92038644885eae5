"""Declared schemas of the inputs, as DDL text; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def struct(ddl: str) -> T.StructType:
    """The parsed schema; parsing needs a running session."""
    return T.StructType.fromDDL(ddl)


# One poll of the vehicle feed, snake_case form.
POLL = (
    """header STRUCT<timestamp: STRING>,
       entity ARRAY<STRUCT<
         id: STRING,
         vehicle: STRUCT<
           trip: STRUCT<trip_id: STRING, route_id: STRING, start_date: STRING>,
           position: STRUCT<latitude: DOUBLE, longitude: DOUBLE, speed: DOUBLE>,
           vehicle: STRUCT<id: STRING, label: STRING>,
           stop_id: STRING, current_stop_sequence: INT, timestamp: STRING>>>"""
)
# The same poll with camelCase keys; read with this, then cast by position to POLL.
POLL_CAMEL = (
    """header STRUCT<timestamp: STRING>,
       entity ARRAY<STRUCT<
         id: STRING,
         vehicle: STRUCT<
           trip: STRUCT<tripId: STRING, routeId: STRING, startDate: STRING>,
           position: STRUCT<latitude: DOUBLE, longitude: DOUBLE, speed: DOUBLE>,
           vehicle: STRUCT<id: STRING, label: STRING>,
           stopId: STRING, currentStopSequence: INT, timestamp: STRING>>>"""
)

# One timetable response: a route and date, one entry for each direction.
TIMETABLE = (
    """data ARRAY<STRUCT<
         route_id: STRING, route_name: STRING, service_date: STRING, schedule_direction_id: STRING,
         schedule_times_for_trip: ARRAY<STRUCT<
           trip_id: STRING, trip_headsign: STRING, block_id: STRING, is_added_service: BOOLEAN,
           times: ARRAY<STRUCT<timeSecs: BIGINT, isWaitStop: BOOLEAN>>>>,
         schedule_stops: ARRAY<STRUCT<stopId: STRING, stopName: STRING>>>>"""
)

ROUTES = "data STRUCT<routes: ARRAY<STRUCT<id: STRING, name: STRING, shortName: STRING, color: STRING>>>"

STOPS = (
    "X DOUBLE, Y DOUBLE, Jurisdiction STRING, TYPE_Alt STRING, Stop_Number STRING, Stop_Name STRING"
)
BELL_TIMES = "school_number STRING, am_bell STRING, pm_bell STRING, district_early_release_time STRING"
COUNTY_STOPS = (
    "route STRING, source_file STRING, stop STRING, location STRING, time STRING, students STRING"
)
CROSSWALK = "GEOID_Tract_2020 STRING, Community_Statistical_Area_2020 STRING"
ATTENDANCE = "school STRING, first_period STRING, all_other_periods STRING, difference STRING"
TRIP_LEGS = (
    """from_id STRING, to_id STRING, to_lat DOUBLE, to_lon DOUBLE, departure_time STRING,
       total_duration DOUBLE, total_distance DOUBLE, segment INT, mode STRING,
       segment_duration DOUBLE, wait DOUBLE, distance DOUBLE, route STRING"""
)
CELLS = "x DOUBLE, y DOUBLE, value DOUBLE"
ACS = "GEOID STRING, variable STRING, estimate DOUBLE, moe DOUBLE"
FEATURES = (
    """features ARRAY<STRUCT<
         properties: MAP<STRING, STRING>,
         geometry: STRUCT<type: STRING, coordinates: STRING>>>"""
)
