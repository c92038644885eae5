"""Events as vehicle reports: vehicle = user, route = type, stop = ``props.k``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timepoint.bindings import table
from timepoint.bindings.punctuality import TIE, sightings, timetable
from timepoint.functions.clock import day_part, micros_of_day, polling_hours, wall_micros
from timepoint.functions.text import base_stop_id
from timepoint.operators.adherence import add_headway, headway_flags, match_schedule
from timepoint.operators.ordered import ROWS_PER_PIECE, number_all_rows, number_rows, previous_value
from timepoint.operators.rollups import exact_median
from timepoint.operators.stop_events import prepare_pings, stop_events, stop_events_slowest
from timepoint.session import written

#: Rows of a piece in the queries that show the ordering in pieces, whatever the size of the tables.
PIECE = 5_000


def pings(spark: SparkSession, folder: str) -> DataFrame:
    k = F.from_json("props", "k BIGINT")["k"]
    return table(spark, folder, "events").select(
        "event_id",
        F.col("user_id").alias("vehicle_id"),
        F.col("event_type").alias("route_id"),
        F.concat_ws("_", k, F.col("event_type")).alias("stop_id"),
        F.col("value").alias("speed_mps"),
        F.to_date("ts").alias("service_date"),
        wall_micros(F.col("ts")).alias("at_us"),
        "ts",
    )


PINGS_SQL = """
WITH pings AS (
  SELECT event_id, user_id AS vehicle_id, event_type AS route_id, value AS speed_mps,
         concat(CAST(json_extract(props, '$.k') AS VARCHAR), '_', event_type) AS raw_stop,
         CAST(json_extract(props, '$.k') AS VARCHAR) AS stop_id,
         CAST(ts AS DATE) AS service_date, epoch_us(ts) AS at_us, ts
  FROM events
)
"""


def headway_rows(spark, folder):
    """Time since the last report of the route that day, in microseconds."""
    keys = ["route_id", "service_date"]
    df = previous_value(pings(spark, folder), keys, "at_us", "before", ["event_id"], ROWS_PER_PIECE)
    return df.select("event_id", "route_id", (F.col("at_us") - F.col("before")).alias("headway_us"))


def headway_by_stop(spark, folder):
    """Headways per stop and route, the group the analysis uses."""
    df = prepare_pings(pings(spark, folder))
    df = previous_value(df, ["stop_id", "route_id"], "at_us", "before", ["event_id"], ROWS_PER_PIECE)
    return df.select("event_id", "stop_id", (F.col("at_us") - F.col("before")).alias("headway_us"))


def headway_two_clocks(spark, folder):
    """Observed and scheduled headway on one exchange: whole groups, no pieces."""
    matched = match_schedule(timetable(spark, folder), sightings(spark, folder), ["trip_id"], "sched")
    keys = ["stop_id"]
    df = add_headway(matched, keys, "obs", "headway", TIE, 1.0)
    df = add_headway(df, keys, "sched", "scheduled_headway", TIE, 1.0).transform(headway_flags)
    return df.select(
        *TIE, "headway", "scheduled_headway", "over_spaced", "bunched", "headway_adherence"
    )


def stop_events_last(spark, folder):
    df = stop_events(pings(spark, folder), ["vehicle_id", "service_date"], "at_us", ["event_id"], trip="route_id")
    return df.select("vehicle_id", F.col("service_date").cast("string"), "event_id", "route_id", "at_us")


def stop_events_by_stop(spark, folder):
    """The full key: vehicle, route, stop and day, stop ids without their suffix."""
    df = prepare_pings(pings(spark, folder))
    keys = ["vehicle_id", "route_id", "stop_id", "service_date"]
    last = stop_events(df, keys, "at_us", ["event_id"], trip="route_id")
    return last.select(
        "vehicle_id", "route_id", "stop_id", F.col("service_date").cast("string"), "event_id", "at_us",
        "no_route_id",
    )


def stop_events_slow(spark, folder):
    df = stop_events_slowest(pings(spark, folder), ["vehicle_id", "service_date"])
    return df.select("vehicle_id", F.col("service_date").cast("string"), "event_id", "speed_mps")


def normalized_stops(spark, folder):
    df = pings(spark, folder)
    return df.groupBy(base_stop_id(F.col("stop_id")).alias("stop_id")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("stop_id").alias("n_raw")
    )


def service_window(spark, folder):
    df = pings(spark, folder).where(polling_hours(F.col("ts")))
    return df.groupBy(F.hour("ts").cast("bigint").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def day_parts(spark, folder):
    hour = F.hour("ts")
    df = pings(spark, folder).select(
        F.col("service_date").cast("string"),
        day_part(hour).alias("time"),
        micros_of_day(F.col("ts")).alias("day_us"),
    )
    return df.groupBy("service_date", "time").agg(
        F.count(F.lit(1)).alias("n"), F.min("day_us").alias("first_us"), F.max("day_us").alias("last_us")
    )


def numbered_reports(spark, folder):
    """Position of each report in its route; five routes hold all rows, so they are ordered in pieces."""
    df = number_rows(pings(spark, folder), ["route_id"], ["at_us", "event_id"], "row", PIECE)
    return df.select("event_id", "route_id", "row")


def numbered_table(spark, folder):
    """Position in the whole table, with no one-task window."""
    return number_all_rows(pings(spark, folder).select("event_id", "at_us"), ["at_us", "event_id"])


def median_headways(spark, folder):
    """Exact median of microsecond headways, values without a bound on their number."""
    df = headway_rows(spark, folder).withColumn("headway_us", F.col("headway_us").cast("double"))
    return exact_median(written(df, "headways"), ["route_id"], "headway_us", rows_per_piece=PIECE)


QUERIES = {
    "headway": headway_rows,
    "exact_median": median_headways,
    "headway_by_stop": headway_by_stop,
    "headway_two_clocks": headway_two_clocks,
    "stop_events_last": stop_events_last,
    "stop_events_by_stop": stop_events_by_stop,
    "stop_events_slowest": stop_events_slow,
    "normalize_stop_id": normalized_stops,
    "service_window": service_window,
    "day_parts": day_parts,
    "number_rows": numbered_reports,
    "number_all_rows": numbered_table,
}

ORACLES = {
    "exact_median": f"""{PINGS_SQL}, h AS (SELECT route_id, CAST(at_us - lag(at_us) OVER (
        PARTITION BY route_id, service_date ORDER BY at_us, event_id) AS DOUBLE) AS h FROM pings)
        SELECT route_id, median(h) AS median FROM h GROUP BY route_id""",
    "headway": f"""{PINGS_SQL} SELECT event_id, route_id,
        at_us - lag(at_us) OVER (PARTITION BY route_id, service_date ORDER BY at_us, event_id) AS headway_us FROM pings""",
    "headway_by_stop": f"""{PINGS_SQL} SELECT event_id, stop_id,
        at_us - lag(at_us) OVER (PARTITION BY stop_id, route_id ORDER BY at_us, event_id) AS headway_us FROM pings""",
    "headway_two_clocks": """
        WITH m AS (
          SELECT o_orderkey AS trip_id, o_custkey AS stop_id, CAST(l_linenumber AS BIGINT) AS line,
                 l_partkey AS part_id, l_suppkey AS supplier_id,
                 CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS sched,
                 CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS obs
          FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey
        ), h AS (
          SELECT *, CAST(CASE WHEN obs IS NOT NULL THEN obs - lag(obs) OVER (PARTITION BY stop_id
                    ORDER BY obs NULLS LAST, trip_id, line, part_id, supplier_id) END AS DOUBLE) AS headway,
                 CAST(sched - lag(sched) OVER (PARTITION BY stop_id
                    ORDER BY sched, trip_id, line, part_id, supplier_id) AS DOUBLE) AS scheduled_headway
          FROM m
        )
        SELECT trip_id, line AS row, part_id, supplier_id, headway, scheduled_headway,
               headway > scheduled_headway + 3 AS over_spaced,
               headway < scheduled_headway * 0.75::DOUBLE AS bunched,
               NOT (headway > scheduled_headway + 3 OR headway < scheduled_headway * 0.75::DOUBLE)
                 AS headway_adherence
        FROM h""",
    "stop_events_last": f"""{PINGS_SQL}, r AS (SELECT *, row_number() OVER (
          PARTITION BY vehicle_id, service_date ORDER BY at_us DESC, event_id DESC) AS rn FROM pings)
        SELECT vehicle_id, CAST(service_date AS VARCHAR) AS service_date, event_id, route_id, at_us
        FROM r WHERE rn = 1""",
    "stop_events_by_stop": f"""{PINGS_SQL}, r AS (SELECT *, row_number() OVER (
          PARTITION BY vehicle_id, route_id, stop_id, service_date ORDER BY at_us DESC, event_id DESC) AS rn FROM pings)
        SELECT vehicle_id, route_id, stop_id, CAST(service_date AS VARCHAR) AS service_date, event_id, at_us,
               route_id IS NULL AS no_route_id FROM r WHERE rn = 1""",
    "stop_events_slowest": f"""{PINGS_SQL}, r AS (SELECT *, min(speed_mps) OVER (
          PARTITION BY vehicle_id, service_date) AS low FROM pings)
        SELECT vehicle_id, CAST(service_date AS VARCHAR) AS service_date, event_id, speed_mps
        FROM r WHERE speed_mps = low""",
    "normalize_stop_id": f"""{PINGS_SQL} SELECT regexp_replace(raw_stop, '_.*', '') AS stop_id, count(*) AS n,
        count(DISTINCT raw_stop) AS n_raw FROM pings GROUP BY 1""",
    "service_window": f"""{PINGS_SQL} SELECT CAST(hour(ts) AS BIGINT) AS hour, count(*) AS n FROM pings
        WHERE hour(ts) >= 4 GROUP BY 1""",
    "day_parts": f"""{PINGS_SQL} SELECT CAST(service_date AS VARCHAR) AS service_date,
        CASE WHEN hour(ts) IN (14, 15, 16) THEN 'afternoon' WHEN hour(ts) IN (5, 6, 7, 8) THEN 'morning'
             ELSE 'other' END AS time, count(*) AS n,
        min(at_us - epoch_us(date_trunc('day', ts))) AS first_us,
        max(at_us - epoch_us(date_trunc('day', ts))) AS last_us
        FROM pings GROUP BY 1, 2""",
    "number_rows": f"""{PINGS_SQL} SELECT event_id, route_id,
        CAST(row_number() OVER (PARTITION BY route_id ORDER BY at_us, event_id) AS BIGINT) AS row FROM pings""",
    "number_all_rows": f"""{PINGS_SQL} SELECT event_id, at_us,
        CAST(row_number() OVER (ORDER BY at_us, event_id) AS BIGINT) AS row FROM pings""",
}
