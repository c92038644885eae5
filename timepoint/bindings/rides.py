"""County buses: a route is a customer and an order status, a sheet a priority.

Stops are line numbers, boarding students the quantity less ten (so that some
stops have none and some let students off), times a clock by stop and part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timepoint.bindings import rounded, table
from timepoint.operators.rides import (
    AFTERNOON_TAG,
    CROSSING,
    MORNING_TAG,
    ZONE_MARK,
    one_file_per_route,
    ride_time_by_route,
    ride_time_total,
    route_span,
    untagged_route_count,
    valid_county_stops,
    zone_route_span,
)
from timepoint.sources.tables import county_numbers

CLOCKS = ["avg_time", "unweighted_avg_time", "avg_boarding_time", "avg_alighting_time"]


def county_stops(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    l = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus"
    )
    status = F.col("o_orderstatus")
    tag = F.when(status == "F", MORNING_TAG).when(status == "O", AFTERNOON_TAG).otherwise("")
    zone = F.when(F.col("o_orderpriority") == "1-URGENT", f" {ZONE_MARK}").otherwise("")
    crossing = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    text = o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.concat(F.lit("R"), F.col("o_custkey").cast("string"), zone, tag).alias("route"),
        F.col("o_orderpriority").alias("source_file"),
        F.col("l_linenumber").cast("string").alias("stop"),
        F.when(crossing, CROSSING).otherwise("Corner").alias("location"),
        (F.col("l_linenumber") * 300 + F.col("l_partkey") % 100 + 21_600).cast("string").alias("time"),
        (F.col("l_quantity") - 10).cast("string").alias("students"),
    )
    return county_numbers(text)


def spans(spark, folder):
    return route_span(county_stops(spark, folder))


def _by_route(spark, folder, tag, zone=False, scope="route"):
    return ride_time_by_route(valid_county_stops(county_stops(spark, folder), tag, zone, scope))


def ride_time(spark, folder):
    return _by_route(spark, folder, MORNING_TAG)


def ride_time_table_scope(spark, folder):
    """Last stop by the highest number of the whole table, as the published code has it."""
    return _by_route(spark, folder, MORNING_TAG, scope="table")


def ride_time_one_file(spark, folder):
    return one_file_per_route(_by_route(spark, folder, AFTERNOON_TAG))


def _total(spark, folder, tag, zone, weighted):
    routes = one_file_per_route(_by_route(spark, folder, tag, zone))
    return rounded(ride_time_total(routes, weighted), 6, [*CLOCKS, "students_per_route"])


def ride_total_morning(spark, folder):
    return _total(spark, folder, MORNING_TAG, False, True)


def ride_total_zone(spark, folder):
    return _total(spark, folder, AFTERNOON_TAG, True, False)


def untagged(spark, folder):
    return untagged_route_count(county_stops(spark, folder))


def zones(spark, folder):
    return rounded(zone_route_span(county_stops(spark, folder), MORNING_TAG), 9, ["net_time"])


QUERIES = {
    "route_span": spans,
    "ride_time": ride_time,
    "ride_time_table_scope": ride_time_table_scope,
    "ride_time_one_file": ride_time_one_file,
    "ride_time_total": ride_total_morning,
    "ride_time_total_zone": ride_total_zone,
    "untagged_routes": untagged,
    "zone_route_span": zones,
}

_STOPS = """
WITH st AS (
  SELECT 'R' || CAST(o_custkey AS VARCHAR)
         || CASE WHEN o_orderpriority = '1-URGENT' THEN ' NON-TRANSPORTED ZONE' ELSE '' END
         || CASE o_orderstatus WHEN 'F' THEN ' AM' WHEN 'O' THEN ' PM' ELSE '' END AS route,
         o_orderpriority AS source_file, CAST(l_linenumber AS BIGINT) AS stop,
         CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F'
              THEN '**RAILROAD CROSSING - PROCEED WITH CAUTION**' ELSE 'Corner' END AS location,
         CAST(l_linenumber * 300 + l_partkey % 100 + 21600 AS DOUBLE) AS secs, l_quantity - 10 AS students
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey
), spanned AS (
  SELECT *, max(stop) OVER (PARTITION BY route, source_file) AS max_stop,
         max(secs) OVER (PARTITION BY route, source_file) AS max_secs,
         max(stop) OVER () AS table_stop
  FROM st
)
"""


def _routes_sql(tag: str, zone: bool, last: str = "max_stop") -> str:
    tagged = f"contains(route, '{tag}')" if tag else "NOT regexp_matches(route, ' AM| PM')"
    return f"""valid AS (
  SELECT *, max_secs - secs AS ride FROM spanned
  WHERE {tagged} AND {'' if zone else 'NOT '}contains(route, 'NON-TRANSPORTED ZONE')
    AND NOT (stop = 1 AND students = 0) AND NOT (stop = {last} AND students = 0)
    AND location <> '**RAILROAD CROSSING - PROCEED WITH CAUTION**'
), routes AS (
  SELECT route, source_file, sum(ride * students) / sum(students) / 60 AS avg_time,
         avg(ride) / 60 AS unweighted_avg_time, sum(secs * students) / sum(students) AS avg_boarding_time,
         sum(max_secs * students) / sum(students) AS avg_alighting_time, sum(students) AS students
  FROM valid WHERE students > 0 GROUP BY route, source_file
  HAVING sum(ride * students) / sum(students) / 60 > 1
), one AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY route ORDER BY source_file) AS rn FROM routes)
  WHERE rn = 1
)"""


_CLOCKS = ", ".join(CLOCKS)


def _total_sql(tag: str, zone: bool, weighted: bool) -> str:
    clock = "sum({c} * students) / sum(students)" if weighted else "avg({c})"
    clocks = ", ".join(
        f"round({clock.format(c=c)}, 6) AS {c}" for c in ("avg_boarding_time", "avg_alighting_time")
    )
    return f"""{_STOPS}, {_routes_sql(tag, zone)}
        SELECT count(*) AS n, round(sum(avg_time * students) / sum(students), 6) AS avg_time,
               round(avg(unweighted_avg_time), 6) AS unweighted_avg_time, {clocks}, sum(students) AS students,
               round(sum(students) / count(*), 6) AS students_per_route FROM one"""


ORACLES = {
    "route_span": f"""{_STOPS} SELECT route, source_file, count(*) AS n, max(stop) AS max_stop,
        sum(students) AS net_students, min(secs) AS min_time, max(secs) AS max_time FROM st GROUP BY 1, 2""",
    "ride_time": f"{_STOPS}, {_routes_sql(' AM', False)} SELECT route, source_file, students, {_CLOCKS} FROM routes",
    "ride_time_table_scope": f"""{_STOPS}, {_routes_sql(' AM', False, 'table_stop')}
        SELECT route, source_file, students, {_CLOCKS} FROM routes""",
    "ride_time_one_file": f"""{_STOPS}, {_routes_sql(' PM', False)}
        SELECT route, source_file, students, {_CLOCKS} FROM one""",
    "ride_time_total": _total_sql(" AM", False, True),
    "ride_time_total_zone": _total_sql(" PM", True, False),
    "untagged_routes": f"""{_STOPS}, {_routes_sql('', False)} SELECT route, source_file, count(*) AS n,
        coalesce(sum(students) FILTER (WHERE students > 0), 0) AS students FROM valid GROUP BY 1, 2""",
    "zone_route_span": f"""{_STOPS}, {_routes_sql(' AM', True)}, z AS (
          SELECT route, source_file, count(*) AS n, max(students) AS students, min(secs) AS min_time,
                 max(secs) AS last_time FROM valid GROUP BY 1, 2)
        SELECT route, source_file, n, students, min_time, last_time,
               round((last_time - min_time) / 60, 9) AS net_time
        FROM (SELECT *, row_number() OVER (PARTITION BY route ORDER BY source_file) AS rn FROM z) WHERE rn = 1""",
}
