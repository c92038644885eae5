"""The whole way on the events table: reports and a timetable to the reports.

vehicle = user, trip = type and stop, stop = ``props.k`` and the user's number
modulo five, 500 in all; place v of the embeddings belongs to stop v modulo 500.
The timetable has one row for each trip ever seen and each day, at a time set by
``k``; most of its rows are never observed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timepoint.bindings import rounded, table, texts
from timepoint.bindings.punctuality import MEANS, MEDIANS, daily_sql, period_sql
from timepoint.bindings.space import places
from timepoint.plans.on_time import on_time_reports, planned_arrivals
from timepoint.plans.school_capacity import (
    arrivals_over_period,
    capacity_report,
    daily_arrivals,
    stops_near_parcels,
    stops_near_schools,
)
from timepoint.operators.arrivals import PARTS, SEATS
from timepoint.session import new_scratch

DEGREES = 10.0
STOPS = 500


def stop_number() -> Column:
    return F.from_json("props", "k BIGINT")["k"] + 100 * F.pmod("user_id", F.lit(5))


def pings(spark: SparkSession, folder: str) -> DataFrame:
    stop = stop_number().cast("string")
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("vehicle_id"),
        F.lit("bus").alias("label"),
        F.concat_ws("-", "event_type", stop).alias("trip_id"),
        F.col("event_type").alias("route_id"),
        F.concat(stop, F.lit("_x")).alias("stop_id"),
        F.date_format("ts", "yyyyMMdd").alias("start_date"),
        "ts",
        F.hour("ts").cast("bigint").alias("hour"),
        F.minute("ts").cast("bigint").alias("minute"),
        F.lit(None).cast("double").alias("lat"),
        F.lit(None).cast("double").alias("lon"),
        F.col("event_id").alias("source_file"),
        F.lit("0").alias("entity_id"),
    )


def planned(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    trips = e.select(F.col("event_type").alias("route_id"), stop_number().alias("stop")).distinct()
    days = e.select(F.to_date("ts").alias("service_date"), F.col("event_type").alias("route_id")).distinct()
    secs = 18_000 + F.col("stop") % 100 * 480
    return trips.join(days, "route_id").select(
        "route_id",
        F.upper("route_id").alias("route_name"),
        "service_date",
        F.lit("0").alias("direction_id"),
        F.concat_ws("-", "route_id", F.col("stop").cast("string")).alias("trip_id"),
        F.lit("B").alias("block_id"),
        secs.alias("sched_secs"),
        F.floor(secs / 3600).alias("sched_hour"),
        F.lit(1).cast("bigint").alias("row"),
        F.col("stop").cast("string").alias("stop_id"),
    )


def on_time_plan(spark, folder):
    reports = on_time_reports(pings(spark, folder), planned(spark, folder), new_scratch(spark, "on-time"))
    return texts(rounded(reports.system, 9, [*MEANS, *MEDIANS]), ["min_date", "max_date"])


def on_time_plan_by_line(spark, folder):
    reports = on_time_reports(pings(spark, folder), planned(spark, folder), new_scratch(spark, "on-time"))
    return texts(rounded(reports.by_line, 9, [*MEANS, *MEDIANS]), ["min_date", "max_date"])


def _stops(spark, folder):
    """Stops and schools on the globe, around a point."""
    return places(spark, folder).select(
        (F.col("vec_id") % STOPS).cast("string").alias("stop_id"),
        (F.col("x") / DEGREES - 76).alias("lon"),
        (F.col("y") / DEGREES + 39).alias("lat"),
    )


def _schools(spark, folder):
    p = places(spark, folder).where("label = 0")
    return p.select(
        F.concat(F.lit("school "), F.col("vec_id").cast("string")).alias("school"),
        (F.col("x") / DEGREES - 76).alias("school_lon"),
        (F.col("y") / DEGREES + 39).alias("school_lat"),
    )


def stops_near(spark, folder):
    """Half a mile as the crow flies, on the globe."""
    return stops_near_schools(_stops(spark, folder), _schools(spark, folder))


def _parcels(spark, folder):
    x, y, r = F.col("school_lon"), F.col("school_lat"), 0.002
    corner = [(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r)]
    ring = F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in corner])
    return _schools(spark, folder).select("school", ring.alias("ring"))


def stops_near_outline(spark, folder):
    """Half a mile from the outline of the school's parcel."""
    return stops_near_parcels(_stops(spark, folder), _parcels(spark, folder))


def _arrivals(spark, folder):
    arrivals = planned_arrivals(pings(spark, folder), planned(spark, folder))
    schools = _schools(spark, folder)
    bells = schools.select(
        "school", F.lit(27_900).alias("opening_secs"), (F.lit(52_000) + F.length("school") * 60).alias("closing_secs")
    )
    return daily_arrivals(arrivals, stops_near(spark, folder), bells, 60)


def arrivals_plan(spark, folder):
    """Buses per school, day and day part, from raw reports to counts."""
    return texts(_arrivals(spark, folder), ["service_date"])


def capacity_plan(spark, folder):
    """Seats against need, from raw reports to percentages; riders are the customers
    whose number is that of the school's place, both modulo 500."""
    period = arrivals_over_period(_arrivals(spark, folder))
    schools = _schools(spark, folder)
    riders = table(spark, folder, "customer").select(
        (F.col("c_custkey") % STOPS).alias("number"),
        F.lit(1).cast("bigint").alias("students"),
        (F.col("c_acctbal") / 200_000 - 76).alias("lon"),
        F.lit(39.0).alias("lat"),
    )
    number = F.regexp_extract("school", "[0-9]+$", 0).cast("bigint") % STOPS
    homes = riders.join(schools.withColumn("number", number), "number").drop("number")
    enrollment = homes.groupBy("school").agg(F.count(F.lit(1)).alias("enrollment"))
    out = capacity_report(homes, period, enrollment)
    return texts(
        rounded(out, 6, ["within_pct", "avg_morning", "avg_afternoon", *[f"capacity_{s}_{p}" for p in PARTS for s in SEATS]]),
        ["min_date", "max_date"],
    )


QUERIES = {
    "on_time_plan": on_time_plan,
    "on_time_plan_by_line": on_time_plan_by_line,
    "stops_near_schools": stops_near,
    "stops_near_parcels": stops_near_outline,
    "arrivals_plan": arrivals_plan,
    "capacity_plan": capacity_plan,
}

_ADHERENCE = """
WITH e AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS vehicle_id, event_type AS route_id,
         CAST(json_extract(props, '$.k') AS BIGINT) + 100 * (user_id % 5) AS k, CAST(ts AS DATE) AS d,
         (epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 1000000::DOUBLE AS secs, ts
  FROM events
), stop_event AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id, route_id, k, d ORDER BY ts DESC, event_id DESC)
                 AS rn FROM e) WHERE rn = 1
), tt AS (
  SELECT t.route_id AS route_id, k, d, 18000 + k % 100 * 480 AS sched
  FROM (SELECT DISTINCT route_id, k FROM e) t
  JOIN (SELECT DISTINCT route_id, d FROM e) s ON t.route_id = s.route_id
), m AS (
  SELECT tt.*, s.vehicle_id AS vehicle_id, s.secs AS obs, hour(s.ts) AS obs_hour, minute(s.ts) AS obs_minute,
         s.secs - sched AS delay
  FROM tt LEFT JOIN stop_event s ON tt.route_id = s.route_id AND tt.k = s.k AND tt.d = s.d
), h AS (
  SELECT *, CASE WHEN obs IS NOT NULL THEN obs - lag(obs) OVER (PARTITION BY k, route_id, d
              ORDER BY obs NULLS LAST, vehicle_id) END / 60 AS headway,
         (sched - lag(sched) OVER (PARTITION BY k, route_id, d ORDER BY sched, vehicle_id)) / 60 AS sh,
         CAST(count(obs) OVER (PARTITION BY route_id, k, d) AS DOUBLE) AS observed_pct
  FROM m
), study AS (
  SELECT d AS service_date, upper(route_id) AS route_name, obs, observed_pct, headway,
         delay BETWEEN -120 AND 420 AS on_time, delay BETWEEN -60 AND 300 AS on_time_5,
         delay BETWEEN -60 AND 240 AS on_time_4, delay <= 1200 AS on_time_20,
         CASE WHEN obs IS NULL THEN TRUE ELSE delay BETWEEN -120 AND 420 END AS optimistic_on_time,
         CASE WHEN obs IS NULL THEN FALSE ELSE delay BETWEEN -120 AND 420 END AS pessimistic_on_time,
         NOT (headway > sh + 3 OR headway < sh * 0.75::DOUBLE) AS headway_ok,
         CASE WHEN sched // 3600 IN (14, 15, 16) THEN 'afternoon'
              WHEN sched // 3600 IN (5, 6, 7, 8) THEN 'morning' ELSE 'other' END AS time
  FROM h WHERE sched // 3600 BETWEEN 5 AND 16
)
"""
_GLOBE = """
z AS (SELECT sqrt(count(*) / 500::DOUBLE) AS scale FROM embeddings),
p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * scale / 10 - 76 AS lon,
             CAST(embedding[2] AS DOUBLE) * scale / 10 + 39 AS lat, label FROM embeddings, z),
st AS (SELECT CAST(vec_id % 500 AS VARCHAR) AS stop_id, vec_id % 500 AS stop_k, lon, lat FROM p),
sc AS (SELECT 'school ' || CAST(vec_id AS VARCHAR) AS school, vec_id % 500 AS place, lon AS slon, lat AS slat FROM p WHERE label = 0),
near AS (SELECT DISTINCT stop_id, stop_k, school FROM st JOIN sc ON
  2 * 6371008.8::DOUBLE * asin(least(sqrt(pow(sin(radians(slat - lat) / 2), 2)
    + cos(radians(lat)) * cos(radians(slat)) * pow(sin(radians(slon - lon) / 2), 2)), 1)) <= 804.672::DOUBLE)
"""
_ARRIVALS = f"""{_ADHERENCE}, {_GLOBE}, a AS (
  SELECT school, d AS service_date, obs_hour, vehicle_id, route_id, m.k AS k, obs,
         CASE WHEN obs_hour IN (14, 15, 16) THEN 'afternoon' WHEN obs_hour IN (6, 7, 8) THEN 'morning' END AS time
  FROM m JOIN near ON m.k = near.stop_k
  WHERE obs IS NOT NULL AND (obs_hour IN (6, 7, 8, 15, 16) OR (obs_hour = 14 AND obs_minute > 20))
), kept AS (
  SELECT * FROM a WHERE (time = 'morning' AND obs > 27900 - 3600 AND obs < 27900)
     OR (time = 'afternoon' AND obs > 52000 + length(school) * 60 AND obs < 52000 + length(school) * 60 + 3600)
), daily AS (
  SELECT school, service_date, time, count(DISTINCT (obs_hour, vehicle_id, route_id, k)) AS n,
         count(DISTINCT (vehicle_id, route_id, k)) AS n_unique FROM kept GROUP BY school, service_date, time
)"""
_FRAME = "111195.0802335329::DOUBLE"
_DX = f"greatest(slon - 0.002::DOUBLE - lon, 0, lon - slon - 0.002::DOUBLE) * {_FRAME} * cos(radians(lat))"
_DY = f"greatest(slat - 0.002::DOUBLE - lat, 0, lat - slat - 0.002::DOUBLE) * {_FRAME}"
_CAPACITY = ", ".join(
    f"round(median_{p} * {s} / nullif(n_students * (1 - within_pct / 100), 0) * 100, 6) AS capacity_{s}_{p}"
    for p in PARTS
    for s in SEATS
)

ORACLES = {
    "on_time_plan": f"{_ADHERENCE}, {daily_sql('')} {period_sql('')}",
    "on_time_plan_by_line": f"{_ADHERENCE}, {daily_sql(', route_name')} {period_sql(', route_name')}",
    "stops_near_schools": f"WITH {_GLOBE} SELECT stop_id, school FROM near",
    "stops_near_parcels": f"""WITH {_GLOBE} SELECT DISTINCT stop_id, school FROM st JOIN sc
        ON pow({_DX}, 2) + pow({_DY}, 2) <= pow(804.672::DOUBLE, 2)""",
    "arrivals_plan": f"""{_ARRIVALS} SELECT school, CAST(service_date AS VARCHAR) AS service_date, time, n, n_unique
        FROM daily""",
    "capacity_plan": f"""{_ARRIVALS}, w AS (
          SELECT school, service_date, max(n) FILTER (WHERE time = 'morning') AS morning,
                 max(n) FILTER (WHERE time = 'afternoon') AS afternoon FROM daily GROUP BY school, service_date),
        period AS (SELECT school, count(*) AS n_days, CAST(min(service_date) AS VARCHAR) AS min_date,
          CAST(max(service_date) AS VARCHAR) AS max_date,
          {', '.join(f'''round(avg({p}), 6) AS avg_{p}, median({p}) AS median_{p}, max({p}) AS max_{p},
                     min({p}) AS min_{p}''' for p in PARTS)} FROM w GROUP BY school),
        homes AS (SELECT school, c_acctbal / 200000 - 76 AS lon, 39::DOUBLE AS lat, slon, slat
          FROM customer JOIN sc ON c_custkey % 500 = place),
        share AS (SELECT school, count(*) AS n_students, count(*) AS enrollment, count(*) FILTER (WHERE
            2 * 6371008.8::DOUBLE * asin(least(sqrt(pow(sin(radians(slat - lat) / 2), 2)
              + cos(radians(lat)) * cos(radians(slat)) * pow(sin(radians(slon - lon) / 2), 2)), 1)) <= 2414.01::DOUBLE)
            AS n_students_within FROM homes GROUP BY school),
        s2 AS (SELECT *, n_students_within * 100 / n_students AS within_pct FROM share)
        SELECT s2.school AS school, n_students, n_students_within, round(within_pct, 6) AS within_pct, enrollment,
               period.* EXCLUDE (school), {_CAPACITY}
        FROM s2 LEFT JOIN period ON s2.school = period.school""",
}
