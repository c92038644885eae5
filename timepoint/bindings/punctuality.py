"""On-time performance: orders are the timetable, line items the sightings.

trip = order, route = priority, direction = status, stop = customer, service
day = month of the order, clock = days since 1970 (so the limits read as days),
hour = day of the month, headways in days.  An order without line items is a bus that never came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timepoint.bindings import rounded, table, texts
from timepoint.functions.clock import day_part, in_hours
from timepoint.operators.adherence import (
    add_delay,
    assess,
    late_early_flags,
    match_schedule,
    minutes_late,
    missing_buses,
    on_time_bounds,
    on_time_flags,
)
from timepoint.operators.joins import attach_names, look_up_text
from timepoint.operators.ordered import ROWS_PER_PIECE
from timepoint.operators.rollups import MEANS, MEDIANS, SHARE_FLAGS, otp_daily, otp_grains, otp_period

TIE = ("trip_id", "row", "part_id", "supplier_id")


def day_number(c):
    return F.unix_date(F.to_date(c)).cast("bigint")


def timetable(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("trip_id"),
        F.col("o_orderpriority").alias("route_id"),
        F.col("o_orderstatus").alias("direction_id"),
        F.col("o_custkey").alias("stop_id"),
        F.to_date(F.date_trunc("month", "o_orderdate")).alias("service_date"),
        day_number("o_orderdate").alias("sched"),
        F.dayofmonth("o_orderdate").cast("bigint").alias("sched_hour"),
    )


def sightings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("trip_id"),
        F.col("l_linenumber").cast("bigint").alias("row"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("supplier_id"),
        day_number("l_shipdate").alias("obs"),
    )


def adherence(spark: SparkSession, folder: str, rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    return assess(
        timetable(spark, folder),
        sightings(spark, folder),
        match_keys=["trip_id"],
        headway_keys=["route_id", "service_date", "direction_id"],
        trip_keys=["route_id", "trip_id", "service_date"],
        scheduled="sched",
        seen_at="obs",
        row="row",
        tie=TIE,
        per_minute=1.0,
        rows_per_piece=rows_per_piece,
    )


def study_rows(spark: SparkSession, folder: str) -> DataFrame:
    hour = F.col("sched_hour")
    return adherence(spark, folder).where(in_hours(hour)).withColumn("time", day_part(hour))


ADHERENCE_SQL = """
WITH matched AS (
  SELECT o_orderkey AS trip_id, o_orderpriority AS route_id, o_orderstatus AS direction_id,
         o_custkey AS stop_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS service_date,
         CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS sched,
         CAST(day(o_orderdate) AS BIGINT) AS sched_hour,
         CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS obs,
         CAST(l_linenumber AS BIGINT) AS line, l_partkey AS part_id, l_suppkey AS supplier_id
  FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey
), flagged AS (
  SELECT *, obs - sched AS delay,
         obs - sched BETWEEN -120 AND 420 AS on_time,
         obs - sched BETWEEN -60 AND 300 AS on_time_5,
         obs - sched BETWEEN -60 AND 240 AS on_time_4,
         obs - sched <= 1200 AS on_time_20,
         obs - sched > 420 AS late, obs - sched > 300 AS late_5,
         obs - sched > 240 AS late_4, obs - sched > 1200 AS late_20,
         obs - sched < -120 AS early, obs - sched < -60 AS early_1,
         (obs - sched) / 60.0::DOUBLE AS minutes_late
  FROM matched
), spaced AS (
  SELECT *,
         CASE WHEN obs IS NULL THEN TRUE ELSE on_time END AS optimistic_on_time,
         CASE WHEN obs IS NULL THEN FALSE ELSE on_time END AS pessimistic_on_time,
         CASE WHEN obs IS NOT NULL THEN obs - lag(obs) OVER (
           PARTITION BY route_id, service_date, direction_id
           ORDER BY obs NULLS LAST, trip_id, line, part_id, supplier_id) END / 1.0::DOUBLE AS headway,
         (sched - lag(sched) OVER (
           PARTITION BY route_id, service_date, direction_id
           ORDER BY sched, trip_id, line, part_id, supplier_id)) / 1.0::DOUBLE AS scheduled_headway
  FROM flagged
), adherence AS (
  SELECT *,
         headway > scheduled_headway + 3 AS over_spaced,
         headway < scheduled_headway * 0.75::DOUBLE AS bunched,
         NOT (headway > scheduled_headway + 3 OR headway < scheduled_headway * 0.75::DOUBLE) AS headway_ok,
         max(line) OVER (PARTITION BY route_id, trip_id, service_date) AS planned_stops,
         count(obs) OVER (PARTITION BY route_id, trip_id, service_date) AS observed_stops
  FROM spaced
), study AS (
  SELECT *, observed_stops / planned_stops AS observed_pct,
         CASE WHEN sched_hour IN (14, 15, 16) THEN 'afternoon'
              WHEN sched_hour IN (5, 6, 7, 8) THEN 'morning' ELSE 'other' END AS time
  FROM adherence WHERE sched_hour BETWEEN 5 AND 16
)
"""

DAILY_SQL = """
         count(*) AS n, count(obs) AS n_observed, count(*) FILTER (WHERE on_time) AS n_on_time,
         min(service_date) AS min_date, max(service_date) AS max_date,
         count(obs) / count(*) AS observed, median(observed_pct) AS median_observed,
         avg(CAST(on_time AS INT)) AS on_time_perc, avg(CAST(on_time_5 AS INT)) AS on_time_perc_5,
         avg(CAST(on_time_4 AS INT)) AS on_time_perc_4, avg(CAST(on_time_20 AS INT)) AS on_time_perc_20,
         avg(CAST(optimistic_on_time AS INT)) AS optimistic_on_time_perc,
         avg(CAST(pessimistic_on_time AS INT)) AS pessimistic_on_time_perc,
         avg(CAST(headway_ok AS INT)) AS headway_adherence,
         avg(headway) AS mean_headway, median(headway) AS median_headway
"""


def daily_sql(by: str) -> str:
    return f"daily AS (SELECT service_date, time{by}, {DAILY_SQL} FROM study GROUP BY service_date, time{by})"


def period_sql(by: str) -> str:
    means = ",\n".join(f"round(avg({m}), 9) AS {m}" for m in MEANS)
    medians = ", ".join(f"round(median({m}), 9) AS {m}" for m in MEDIANS)
    return f"""
SELECT time{by}, count(*) AS n_days, count(on_time_perc) AS n_days_used,
       CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n) AS DOUBLE) / count(*) AS n_per_day,
       CAST(min(min_date) AS VARCHAR) AS min_date, CAST(max(max_date) AS VARCHAR) AS max_date,
       {means}, {medians},
       CAST(sum(n_observed) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS pooled_observed,
       CASE WHEN sum(n_observed) > 0 THEN CAST(sum(n_on_time) AS DOUBLE) / CAST(sum(n_observed) AS DOUBLE) END
         AS pooled_on_time_perc
FROM daily GROUP BY time{by}"""


def finish_period(df: DataFrame) -> DataFrame:
    return texts(rounded(df, 9, [*MEANS, *MEDIANS]), ["min_date", "max_date"])


def otp_system(spark, folder):
    return finish_period(otp_period(otp_daily(study_rows(spark, folder), observed="obs")))


def otp_by_line(spark, folder):
    daily = otp_daily(study_rows(spark, folder), by=["route_id"], observed="obs")
    period = finish_period(otp_period(daily, by=["time", "route_id"]))
    # The line list: one name for each priority, here from the orders themselves.
    names = table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("route_id"),
        F.regexp_replace("o_orderpriority", "^[0-9]-", "").alias("line_name"),
    ).distinct()
    return attach_names(period, names, ["route_id"]).orderBy("on_time_perc", "route_id", "time")


def otp_by_stop(spark, folder):
    daily = otp_daily(study_rows(spark, folder), by=["stop_id"], observed="obs")
    return finish_period(otp_period(daily, by=["time", "stop_id"]))


def otp_daily_system(spark, folder):
    daily = otp_daily(study_rows(spark, folder), observed="obs")
    rates = [*SHARE_FLAGS, "observed", "median_observed", "mean_headway", "median_headway"]
    return texts(rounded(daily, 9, rates), ["service_date", "min_date", "max_date"])


def otp_grouping_sets(spark, folder):
    grains = otp_grains(study_rows(spark, folder), line="route_id", stop="stop_id", observed="obs")
    rates = [*SHARE_FLAGS, "observed", "median_observed", "mean_headway", "median_headway"]
    return texts(rounded(grains, 9, rates), ["service_date", "min_date", "max_date"])


def look_up_line(spark, folder):
    daily = otp_daily(study_rows(spark, folder), by=["route_id"], observed="obs")
    period = finish_period(otp_period(daily, by=["time", "route_id"]))
    return look_up_text(period, "route_id", "HIGH")


def _flagged(spark, folder):
    matched = match_schedule(timetable(spark, folder), sightings(spark, folder), ["trip_id"], "sched")
    return add_delay(matched, "sched", "obs")


def on_time_flag_rows(spark, folder):
    df = on_time_flags(_flagged(spark, folder)).transform(on_time_bounds, "obs")
    return df.select(
        "trip_id", "row", "part_id", "supplier_id", "delay", "on_time", "on_time_5", "on_time_4",
        "on_time_20", "optimistic_on_time", "pessimistic_on_time",
    )


def late_early_rows(spark, folder):
    df = late_early_flags(_flagged(spark, folder)).transform(minutes_late)
    return df.select(
        "trip_id", "row", "part_id", "supplier_id", "planned", "late", "late_5", "late_4", "late_20",
        "early", "early_1", "minutes_late",
    )


def trip_coverage_rows(spark, folder):
    df = adherence(spark, folder)
    return df.select("trip_id", "row", "part_id", "supplier_id", "planned_stops", "observed_stops", "observed_pct")


def headway_flag_rows(spark, folder):
    df = adherence(spark, folder)
    return df.select(
        "trip_id", "row", "part_id", "supplier_id", "headway", "scheduled_headway", "over_spaced",
        "bunched", "headway_adherence",
    )


def never_came(spark, folder):
    """Trips nobody saw, by line."""
    gone = missing_buses(timetable(spark, folder), sightings(spark, folder), ["trip_id"])
    return gone.groupBy("route_id").agg(F.count(F.lit(1)).alias("n"), F.min("trip_id").alias("first_trip"))


def fan_out_check(spark, folder):
    """How far rows observed exceed stops planned, by line (several vehicles on one trip)."""
    df = adherence(spark, folder)
    return df.groupBy("route_id").agg(
        F.max("observed_pct").alias("max_ratio"),
        F.count(F.when(F.col("observed_pct") > 1, 1)).alias("n_over"),
    )


QUERIES = {
    "otp_system": otp_system,
    "otp_by_line": otp_by_line,
    "otp_by_stop": otp_by_stop,
    "otp_daily_system": otp_daily_system,
    "otp_grouping_sets": otp_grouping_sets,
    "look_up_line": look_up_line,
    "on_time_flags": on_time_flag_rows,
    "late_early_flags": late_early_rows,
    "trip_coverage": trip_coverage_rows,
    "headway_flags": headway_flag_rows,
    "match_fan_out": fan_out_check,
    "missing_buses": never_came,
}

DAILY_OUT = """
       n, n_observed, n_on_time, CAST(min_date AS VARCHAR) AS min_date, CAST(max_date AS VARCHAR) AS max_date,
       round(observed, 9) AS observed, round(median_observed, 9) AS median_observed,
       round(on_time_perc, 9) AS on_time_perc, round(on_time_perc_5, 9) AS on_time_perc_5,
       round(on_time_perc_4, 9) AS on_time_perc_4, round(on_time_perc_20, 9) AS on_time_perc_20,
       round(optimistic_on_time_perc, 9) AS optimistic_on_time_perc,
       round(pessimistic_on_time_perc, 9) AS pessimistic_on_time_perc,
       round(headway_adherence, 9) AS headway_adherence,
       round(mean_headway, 9) AS mean_headway, round(median_headway, 9) AS median_headway
"""

ORACLES = {
    "missing_buses": """SELECT o_orderpriority AS route_id, count(*) AS n, min(o_orderkey) AS first_trip FROM orders
        WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) GROUP BY 1""",
    "otp_system": f"{ADHERENCE_SQL}, {daily_sql('')} {period_sql('')}",
    "otp_by_line": f"""{ADHERENCE_SQL}, {daily_sql(', route_id')}, period AS ({period_sql(', route_id')})
        SELECT period.*, regexp_replace(route_id, '^[0-9]-', '') AS line_name FROM period""",
    "otp_by_stop": f"{ADHERENCE_SQL}, {daily_sql(', stop_id')} {period_sql(', stop_id')}",
    "otp_daily_system": f"""{ADHERENCE_SQL}, {daily_sql('')}
        SELECT CAST(service_date AS VARCHAR) AS service_date, time, {DAILY_OUT} FROM daily""",
    "otp_grouping_sets": f"""{ADHERENCE_SQL}, daily AS (
        SELECT service_date AS day, time, route_id, stop_id,
               CASE WHEN grouping(route_id) = 1 AND grouping(stop_id) = 1 THEN 'system'
                    WHEN grouping(stop_id) = 1 THEN 'line' ELSE 'stop' END AS grain, {DAILY_SQL}
        FROM study GROUP BY GROUPING SETS
          ((service_date, time), (service_date, time, route_id), (service_date, time, stop_id)))
        SELECT CAST(day AS VARCHAR) AS service_date, time, route_id, stop_id, grain, {DAILY_OUT} FROM daily""",
    "look_up_line": f"""{ADHERENCE_SQL}, {daily_sql(', route_id')}, period AS ({period_sql(', route_id')})
        SELECT * FROM period WHERE contains(route_id, 'HIGH')""",
    "on_time_flags": f"""{ADHERENCE_SQL} SELECT trip_id, line AS row, part_id, supplier_id, delay, on_time,
        on_time_5, on_time_4, on_time_20, optimistic_on_time, pessimistic_on_time FROM spaced""",
    "late_early_flags": f"""{ADHERENCE_SQL} SELECT trip_id, line AS row, part_id, supplier_id,
        sched IS NOT NULL AS planned, late, late_5, late_4, late_20, early, early_1, minutes_late FROM flagged""",
    "trip_coverage": f"""{ADHERENCE_SQL} SELECT trip_id, line AS row, part_id, supplier_id, planned_stops,
        observed_stops, observed_stops / planned_stops AS observed_pct FROM adherence""",
    "headway_flags": f"""{ADHERENCE_SQL} SELECT trip_id, line AS row, part_id, supplier_id, headway,
        scheduled_headway, over_spaced, bunched, headway_ok AS headway_adherence FROM adherence""",
    "match_fan_out": f"""{ADHERENCE_SQL} SELECT route_id, max(observed_stops / planned_stops) AS max_ratio,
        count(*) FILTER (WHERE observed_stops / planned_stops > 1) AS n_over FROM adherence GROUP BY route_id""",
}
