"""Arrivals at schools: events by type.

school = event type, bus = (user, ``props.k``), time = the event's own; the
bells of a school come from the length of its name, so that they differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timepoint.bindings import rounded, table, texts
from timepoint.functions.clock import SCHOOL_MORNING_HOURS, day_part, in_hours, micros_of_day, school_hours
from timepoint.operators.arrivals import (
    PARTS,
    SEATS,
    arrival_period,
    arrival_stats,
    arrival_stats_wide,
    bus_capacity,
    collapse_mean,
    hourly_buses,
    near_bell,
    near_school_share,
    part_buses,
)
from timepoint.operators.joins import attach_bells, attach_stop_schools, matched_only

BUS = ["vehicle_id", "trip_id"]


def reports(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "event_id",
        F.col("event_type").alias("school"),
        F.col("user_id").alias("vehicle_id"),
        F.from_json("props", "k BIGINT")["k"].alias("trip_id"),
        F.to_date("ts").alias("service_date"),
        F.hour("ts").cast("bigint").alias("hour"),
        F.minute("ts").cast("bigint").alias("minute"),
        micros_of_day(F.col("ts")).alias("day_us"),
    )


def bells(spark, folder):
    """Opening 07:45 and closing 14:40, each a minute later per letter; one school has none."""
    names = table(spark, folder, "events").select(F.col("event_type").alias("school")).distinct()
    late = F.length("school") * 60
    known = F.col("school") != "error"
    return names.select(
        "school",
        F.when(known, 27_900 + late).alias("opening"),
        F.when(known, 52_800 + late).alias("closing"),
    )


def in_school_hours(spark, folder):
    df = reports(spark, folder).where(school_hours(F.col("hour"), F.col("minute")))
    return df.groupBy("school", "hour").agg(F.count(F.lit(1)).alias("n"), F.min("minute").alias("first_minute"))


def study_hours(spark, folder):
    df = reports(spark, folder).where(in_hours(F.col("hour")))
    return df.groupBy("hour").agg(F.count(F.lit(1)).alias("n"))


def _near(spark, folder, minutes):
    belled = attach_bells(reports(spark, folder), bells(spark, folder), ["school"], "opening", "closing")
    timed = belled.withColumn("day_secs", F.col("day_us") / 1_000_000)
    return near_bell(timed, "hour", "minute", "day_secs", "opening", "closing", minutes)


def bell_window(spark, folder):
    return _near(spark, folder, 30).select("event_id", "school", "time", "day_us")


def bell_window_hour(spark, folder):
    return _near(spark, folder, 60).select("event_id", "school", "time", "day_us")


def stop_school_join(spark, folder):
    """Stops (users) to the schools near them, many to many, then buses per school."""
    pairs = reports(spark, folder).select("vehicle_id", "school").distinct()
    events = reports(spark, folder).select("event_id", "vehicle_id", "trip_id", "service_date")
    near = attach_stop_schools(events, pairs, "vehicle_id", "school")
    return near.groupBy("school").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("trip_id").alias("trips"))


def distinct_buses(spark, folder):
    df = hourly_buses(reports(spark, folder), ["school", "service_date"], "hour", BUS)
    return texts(df, ["service_date"])


def _part():
    return day_part(F.col("hour"), morning=SCHOOL_MORNING_HOURS, otherwise=None)


def _daily(spark, folder):
    df = reports(spark, folder).where(_part().isNotNull())
    return part_buses(df, ["school", "service_date"], "hour", BUS, _part())


def part_bus_counts(spark, folder):
    return texts(_daily(spark, folder), ["service_date"])


def arrival_stats_long(spark, folder):
    df = arrival_stats(_daily(spark, folder), ["school", "time"])
    return texts(rounded(df, 9, ["avg_n", "sd_n", "sd_as_pct"]), ["min_day", "max_day"])


def arrival_stats_pivot(spark, folder):
    df = arrival_stats_wide(_daily(spark, folder), ["school"])
    noisy = [f"{s}_{p}" for p in PARTS for s in ("avg_n", "sd_n", "sd_as_pct")]
    return texts(rounded(df, 9, noisy), [f"{s}_{p}" for p in PARTS for s in ("min_day", "max_day")])


def _wide_days(spark, folder):
    daily = arrival_stats_wide(_daily(spark, folder), ["school", "service_date"])
    return daily.withColumns({"min_date": F.col("service_date"), "max_date": F.col("service_date")})


def arrivals_over_days(spark, folder):
    df = arrival_period(_wide_days(spark, folder), "school")
    return texts(rounded(df, 9, ["avg_morning", "avg_afternoon"]), ["min_date", "max_date"])


def arrival_means(spark, folder):
    cols = [f"{s}_{p}" for p in PARTS for s in ("avg_n", "max_n", "median_n")]
    df = collapse_mean(_wide_days(spark, folder).select("school", *cols), "school")
    return rounded(df, 9, cols)


def capacity(spark, folder):
    """Seats against need: schools are nations, buses are orders by day of the month.

    Riders are customers, the wealthy ones live near; customers with no nation
    in the list do not count.
    """
    c = table(spark, folder, "customer").withColumn("near", F.col("c_acctbal") > 5000)
    n = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("name"))
    homes = matched_only(c, n, ["c_nationkey"]).withColumn("students", F.lit(1).cast("bigint"))
    share = near_school_share(homes, "name", "students", "near")
    # One nation has no known homes, so the default share applies.
    share = share.withColumn("within_pct", F.when(F.col("name") != "NATION_3", F.col("within_pct")))
    o = table(spark, folder, "orders").withColumnRenamed("o_custkey", "c_custkey")
    day = F.dayofmonth("o_orderdate").cast("bigint")
    buses = o.join(homes.select("c_custkey", "name"), "c_custkey").select(
        "name",
        F.to_date(F.date_trunc("month", "o_orderdate")).alias("service_date"),
        day.alias("hour"),
        "o_orderkey",
    )
    part = day_part(F.col("hour"), otherwise=None)
    daily = part_buses(buses.where(part.isNotNull()), ["name", "service_date"], "hour", ["o_orderkey"], part)
    wide = arrival_stats_wide(daily, ["name"]).select("name", "median_n_morning", "median_n_afternoon")
    schools = share.join(wide, "name", "left")
    medians = {p: f"median_n_{p}" for p in PARTS}
    out = bus_capacity(schools, "n_students", medians)
    return rounded(out, 6, ["within_pct", *[f"capacity_{s}_{p}" for p in PARTS for s in SEATS]])


QUERIES = {
    "school_hours": in_school_hours,
    "study_hours": study_hours,
    "bell_window": bell_window,
    "bell_window_hour": bell_window_hour,
    "attach_stop_schools": stop_school_join,
    "distinct_buses": distinct_buses,
    "part_bus_counts": part_bus_counts,
    "arrival_stats": arrival_stats_long,
    "arrival_stats_wide": arrival_stats_pivot,
    "arrival_period": arrivals_over_days,
    "collapse_mean": arrival_means,
    "capacity": capacity,
}

_REPORTS = """
WITH r AS (
  SELECT event_id, event_type AS school, user_id AS vehicle_id,
         CAST(json_extract(props, '$.k') AS BIGINT) AS trip_id, CAST(ts AS DATE) AS service_date,
         CAST(hour(ts) AS BIGINT) AS hour, CAST(minute(ts) AS BIGINT) AS minute,
         epoch_us(ts) - epoch_us(date_trunc('day', ts)) AS day_us,
         CASE WHEN hour(ts) IN (14, 15, 16) THEN 'afternoon' WHEN hour(ts) IN (6, 7, 8) THEN 'morning' END AS time
  FROM events
)
"""
_SCHOOL_HOURS = "(hour IN (6, 7, 8, 15, 16) OR (hour = 14 AND minute > 20))"


def _bell_sql(minutes: int) -> str:
    w = minutes * 60_000_000
    opening, closing = "(27900 + length(school) * 60) * 1000000", "(52800 + length(school) * 60) * 1000000"
    return f"""{_REPORTS} SELECT event_id, school, time, day_us FROM r
        WHERE {_SCHOOL_HOURS} AND school <> 'error' AND (
          (time = 'morning' AND day_us > {opening} - {w} AND day_us < {opening})
          OR (time = 'afternoon' AND day_us > {closing} AND day_us < {closing} + {w}))"""


_DAILY = f"""{_REPORTS}, h AS (
  SELECT DISTINCT school, service_date, time, hour, vehicle_id, trip_id FROM r WHERE time IS NOT NULL),
daily AS (
  SELECT school, service_date, time, count(*) AS n, count(DISTINCT (vehicle_id, trip_id)) AS n_unique
  FROM h GROUP BY school, service_date, time)
"""
_STATS = {
    "avg_n": "round(avg(n) {f}, 9)",
    "max_n": "max(n) {f}",
    "min_n": "min(n) {f}",
    "median_n": "median(n) {f}",
    "sd_n": "round(stddev_samp(n) {f}, 9)",
    "min_day": "CAST(min(service_date) {f} AS VARCHAR)",
    "max_day": "CAST(max(service_date) {f} AS VARCHAR)",
    "sd_as_pct": "round(stddev_samp(n) {f} * 100 / (avg(n) {f}), 9)",
}


def _stats_sql(parts: bool) -> str:
    if not parts:
        return ", ".join(f"{e.format(f='')} AS {n}" for n, e in _STATS.items())
    return ", ".join(
        e.format(f=f"FILTER (WHERE time = '{p}')") + f" AS {n}_{p}" for p in PARTS for n, e in _STATS.items()
    )


_WIDE = ", ".join(f"max(n) FILTER (WHERE time = '{p}') AS {p}" for p in PARTS)
_CAPACITY = ", ".join(
    f"round(median_n_{p} * {s} / (n_students * (1 - coalesce(within_pct, 12.14193::DOUBLE) / 100)) * 100, 6)"
    f" AS capacity_{s}_{p}"
    for p in PARTS
    for s in SEATS
)

ORACLES = {
    "school_hours": f"""{_REPORTS} SELECT school, hour, count(*) AS n, min(minute) AS first_minute FROM r
        WHERE {_SCHOOL_HOURS} GROUP BY school, hour""",
    "study_hours": f"{_REPORTS} SELECT hour, count(*) AS n FROM r WHERE hour BETWEEN 5 AND 16 GROUP BY hour",
    "bell_window": _bell_sql(30),
    "bell_window_hour": _bell_sql(60),
    "attach_stop_schools": f"""{_REPORTS}, p AS (SELECT DISTINCT vehicle_id, school FROM r)
        SELECT p.school AS school, count(*) AS n, count(DISTINCT trip_id) AS trips
        FROM r JOIN p ON r.vehicle_id = p.vehicle_id GROUP BY p.school""",
    "distinct_buses": f"""{_REPORTS} SELECT school, CAST(service_date AS VARCHAR) AS service_date, hour,
        count(DISTINCT (vehicle_id, trip_id)) AS n FROM r GROUP BY school, service_date, hour""",
    "part_bus_counts": f"""{_DAILY} SELECT school, CAST(service_date AS VARCHAR) AS service_date, time, n, n_unique
        FROM daily""",
    "arrival_stats": f"{_DAILY} SELECT school, time, {_stats_sql(False)} FROM daily GROUP BY school, time",
    "arrival_stats_wide": f"{_DAILY} SELECT school, {_stats_sql(True)} FROM daily GROUP BY school",
    "arrival_period": f"""{_DAILY}, w AS (SELECT school, service_date, {_WIDE} FROM daily GROUP BY school, service_date)
        SELECT school, count(*) AS n_days, CAST(min(service_date) AS VARCHAR) AS min_date,
               CAST(max(service_date) AS VARCHAR) AS max_date,
               {', '.join(f'''round(avg({p}), 9) AS avg_{p}, median({p}) AS median_{p}, max({p}) AS max_{p},
                          min({p}) AS min_{p}''' for p in PARTS)} FROM w GROUP BY school""",
    "collapse_mean": f"""{_DAILY}, w AS (SELECT school, service_date, {_WIDE} FROM daily GROUP BY school, service_date)
        SELECT school, {', '.join(f'round(avg({p}), 9) AS {s}_{p}' for p in PARTS for s in ('avg_n', 'max_n', 'median_n'))}
        FROM w GROUP BY school""",
    "capacity": f"""WITH homes AS (SELECT c_custkey, n_name AS name, c_acctbal > 5000 AS near
          FROM customer JOIN nation ON c_nationkey = n_nationkey),
        share AS (SELECT name, count(*) AS n_students, count(*) FILTER (WHERE near) AS n_students_within,
          CASE WHEN name <> 'NATION_3' THEN count(*) FILTER (WHERE near) * 100 / count(*) END AS within_pct
          FROM homes GROUP BY name),
        b AS (SELECT name, date_trunc('month', o_orderdate) AS m, o_orderkey,
          CASE WHEN day(o_orderdate) IN (14, 15, 16) THEN 'afternoon'
               WHEN day(o_orderdate) IN (5, 6, 7, 8) THEN 'morning' END AS time
          FROM orders JOIN homes ON o_custkey = c_custkey),
        d AS (SELECT name, m, time, count(*) AS n FROM b WHERE time IS NOT NULL GROUP BY name, m, time),
        w AS (SELECT name, median(n) FILTER (WHERE time = 'morning') AS median_n_morning,
                     median(n) FILTER (WHERE time = 'afternoon') AS median_n_afternoon FROM d GROUP BY name)
        SELECT share.name AS name, n_students, n_students_within, round(within_pct, 6) AS within_pct,
               median_n_morning, median_n_afternoon, {_CAPACITY}
        FROM share LEFT JOIN w ON share.name = w.name""",
}
