"""Trips to school: orders are the trips, their line items the legs.

mode comes from the two flags, minutes are the quantity, metres the price, the
route is the supplier (none on foot), students and school come from the order.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timepoint.bindings import rounded, table
from timepoint.operators.joins import attach_enrollment, attach_names, od_with_points
from timepoint.operators.ordered import number_rows
from timepoint.operators.selection import weighted_median
from timepoint.operators.trips import (
    MODES,
    PROBE_MINUTES,
    TRIP_CUTS,
    departure_profile,
    latest_feasible_departure,
    longest_trip,
    on_time_probe,
    route_popularity,
    route_share,
    travel_time_stats,
    trip_profile,
    trip_profile_unweighted,
    trip_summary,
    with_fallback_departure,
    with_transfers,
)

TRIP = ["trip_id"]


def legs(spark: SparkSession, folder: str) -> DataFrame:
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    mode = (
        F.when(flag == "A", "BUS").when(flag == "N", "WALK").when(status == "O", "TRAM").otherwise("SUBWAY")
    )
    df = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("trip_id"),
        mode.alias("mode"),
        F.when(mode != "WALK", F.col("l_suppkey")).alias("route"),
        F.col("l_quantity").alias("segment_duration"),
        F.round("l_extendedprice").alias("distance"),
        F.col("l_linenumber").cast("double").alias("wait"),
        (F.col("l_quantity") * 2 + F.col("l_linenumber")).alias("total_duration"),
        F.round(F.col("l_extendedprice") * 2).alias("total_distance"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
    )
    # A handful of legs for each trip; the exchange serves the summary by trip too.
    return number_rows(df, TRIP, ["l_linenumber", "l_partkey", "l_suppkey"], "segment")


def lines(spark, folder):
    """Half of the suppliers have a line name."""
    s = table(spark, folder, "supplier")
    named = F.when(F.col("s_acctbal") > 4000, F.col("s_name"))
    return s.select(F.col("s_suppkey").alias("route"), named.alias("name"))


def trips(spark, folder):
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("trip_id"),
        F.col("o_orderpriority").alias("school"),
        F.col("o_custkey").alias("tract"),
        F.dayofmonth("o_orderdate").cast("bigint").alias("students"),
        (F.dayofmonth("o_orderdate") * 60 + 27_000).cast("bigint").alias("bell"),
        (F.month("o_orderdate") * 300 + 18_000).cast("bigint").alias("departure"),
    )


def summaries(spark, folder, lists=False):
    named = attach_names(legs(spark, folder), lines(spark, folder), ["route"]) if lists else legs(spark, folder)
    return trip_summary(named, TRIP, lists=lists, names="name")


def detailed(spark, folder):
    return attach_enrollment(trips(spark, folder), summaries(spark, folder), TRIP)


DISTANCES = [f"{d}_distance" for d in ("total", *MODES)]


def trip_rows(spark, folder):
    df = summaries(spark, folder, lists=True)
    def text(c):
        return F.concat_ws(",", F.transform(c, lambda v: F.coalesce(v.cast("string"), F.lit("-"))))

    out = df.withColumns({c: text(F.col(c)) for c in ("routes", "short_names", "modes")})
    return rounded(out.withColumn("segments", F.col("trip_legs")).drop("trip_legs"), 9, DISTANCES)


def trip_transfers(spark, folder):
    return with_transfers(detailed(spark, folder)).select("trip_id", "transfers", "legs", "n_modes")


def profile(spark, folder):
    df = trip_profile(detailed(spark, folder))
    return rounded(df, 6, [c for c in df.columns if c != "enrollment_approx"])


def _rates(df):
    return rounded(df, 6, [c for c in df.columns if c.startswith(("avg_", "pct_"))])


def profile_city(spark, folder):
    return _rates(trip_profile_unweighted(detailed(spark, folder)))


def profile_by_school(spark, folder):
    df = _rates(trip_profile_unweighted(detailed(spark, folder), ["school"]))
    return df.orderBy(F.desc("n"), F.desc("pct_over_30_bus_time"), "school")


def profile_by_tract(spark, folder):
    return _rates(trip_profile_unweighted(detailed(spark, folder), ["tract"]))


def longest(spark, folder):
    return rounded(longest_trip(detailed(spark, folder), ["school"]), 9, ["max_total_distance"])


def departures_by_bell(spark, folder):
    return rounded(departure_profile(trips(spark, folder), "departure", ["bell"]), 9, ["mean_departure"])


def departures_all(spark, folder):
    return rounded(departure_profile(trips(spark, folder), "departure"), 9, ["mean_departure"])


def travel_times(spark, folder):
    df = travel_time_stats(detailed(spark, folder), "total_duration", "students")
    return rounded(df, 9, ["mean_travel_time", "sd_travel_time"])


#: Few enough rows that the groups of the supplied tables are narrowed before they are ordered.
GATHER = 200


def weighted_times(spark, folder):
    """Legs as trips: their duration, at which half of the students (the quantity) arrive, by line."""
    legs_ = table(spark, folder, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("line"), F.col("l_extendedprice").cast("double").alias("seconds"), F.col("l_quantity").cast("bigint").alias("students")
    )
    return weighted_median(legs_, ["line"], "seconds", "students", "median_travel_time", gather=GATHER)


def popular_routes(spark, folder):
    return route_popularity(legs(spark, folder), trips(spark, folder), TRIP, lines(spark, folder))


def shared_routes(spark, folder):
    return rounded(route_share(legs(spark, folder), TRIP, lines(spark, folder)), 9, ["pct_of_trips"])


#: Probes in one task; they are grouped and ordered there.
PROBES_PER_PIECE = 500_000


def probes(spark, folder):
    """Fifteen candidate departures for each order with line items.

    The travel time is arithmetic on the order's quantity; some probes find no
    way and give no row value.
    """
    line = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("trip_id")).agg(
        F.sum("l_quantity").cast("bigint").alias("q")
    )
    asked = trips(spark, folder)
    pieces = max(1, math.ceil(asked.count() * len(PROBE_MINUTES) / PROBES_PER_PIECE))
    # Partitions are sized by their bytes before a row becomes fifteen, so their number comes from the rows there will be.
    df = asked.join(line, "trip_id").repartition(pieces, "trip_id")
    df = df.withColumn("before", F.explode(F.lit(list(PROBE_MINUTES)).cast("array<bigint>")))
    base = F.col("q") % 50 + 5
    travel = base + (F.col("q") * 7 + F.col("before") * 3) % 23
    found = (F.col("q") + F.col("before") / 10) % 11 != 0
    df = df.withColumn("at", F.col("bell") - F.col("before") * 60).withColumn("p50", F.when(found, travel))
    return df.withColumn("on_time", on_time_probe(F.col("p50"), F.col("at"), F.col("bell")))


def latest_departure(spark, folder):
    found = latest_feasible_departure(probes(spark, folder), TRIP, "at", "on_time", "p50")
    out = with_fallback_departure(trips(spark, folder).select("trip_id", "bell"), found, TRIP, "bell")
    return out.select("trip_id", "latest_departure", "travel_time", "n_probes")


def od_points(spark, folder):
    """Origin-destination pairs with both points: customers, nations, regions."""
    c = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("home"), "c_mktsegment")
    homes = table(spark, folder, "nation").where("n_regionkey <> 4").select(
        F.col("n_nationkey").alias("home"), F.col("n_name").alias("home_point")
    )
    seg = table(spark, folder, "customer").groupBy("c_mktsegment").agg(F.min("c_acctbal").alias("school_point"))
    return od_with_points(c, seg, homes, "c_mktsegment", "home")


QUERIES = {
    "trip_summary": trip_rows,
    "trip_transfers": trip_transfers,
    "trip_profile": profile,
    "trip_profile_unweighted": profile_city,
    "trip_by_group": profile_by_school,
    "trip_by_tract": profile_by_tract,
    "longest_trip": longest,
    "departure_profile": departures_by_bell,
    "departure_profile_all": departures_all,
    "travel_time_stats": travel_times,
    "weighted_median": weighted_times,
    "route_popularity": popular_routes,
    "route_share": shared_routes,
    "latest_departure": latest_departure,
    "od_points": od_points,
}

_LEGS = """
WITH l AS (
  SELECT l_orderkey AS trip_id,
         CASE WHEN l_returnflag = 'A' THEN 'BUS' WHEN l_returnflag = 'N' THEN 'WALK'
              WHEN l_linestatus = 'O' THEN 'TRAM' ELSE 'SUBWAY' END AS mode,
         CASE WHEN l_returnflag <> 'N' THEN l_suppkey END AS route,
         l_quantity AS seg, round(l_extendedprice) AS dist, CAST(l_linenumber AS DOUBLE) AS wait,
         l_quantity * 2 + l_linenumber AS td, round(l_extendedprice * 2) AS tdist,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS BIGINT)
           AS segment
  FROM lineitem
), lines AS (
  SELECT s_suppkey AS route, CASE WHEN s_acctbal > 4000 THEN s_name END AS name FROM supplier
), trips AS (
  SELECT o_orderkey AS trip_id, o_orderpriority AS school, o_custkey AS tract,
         CAST(day(o_orderdate) AS BIGINT) AS students,
         CAST(day(o_orderdate) * 60 + 27000 AS BIGINT) AS bell,
         CAST(month(o_orderdate) * 300 + 18000 AS BIGINT) AS departure
  FROM orders
), s AS (
  SELECT trip_id, min_by(td, segment) AS total_duration,
         min_by(tdist, segment) * 0.000621371::DOUBLE AS total_distance,
         max(segment) AS segments, count(*) AS legs, count(*) FILTER (WHERE mode = 'WALK') AS walk_legs,
         count(DISTINCT mode) AS n_modes, sum(wait) AS wait,
""" + ",\n".join(
    f"""coalesce(sum(seg) FILTER (WHERE mode = '{code}'), 0) AS {m}_time,
        coalesce(sum(dist) FILTER (WHERE mode = '{code}'), 0) * 0.000621371::DOUBLE AS {m}_distance,
        count(*) FILTER (WHERE mode = '{code}') > 0 AS uses_{m}"""
    for m, code in MODES.items()
) + """
  FROM l GROUP BY trip_id
), d AS (
  SELECT trips.*, s.* EXCLUDE (trip_id, legs, n_modes, walk_legs),
         greatest(coalesce(walk_legs, 0) - 2, 0) AS transfers, coalesce(legs, 0) AS legs,
         coalesce(n_modes, 0) AS n_modes
  FROM trips LEFT JOIN s ON trips.trip_id = s.trip_id
)
"""


def _w(col: str) -> str:
    return f"round(sum({col} * students) / sum(students) FILTER (WHERE {col} IS NOT NULL), 6)"


_PROFILE = ", ".join(
    [f"{_w('total_duration')} AS total_duration"]
    + [
        f"round(coalesce(sum(students) FILTER (WHERE uses_{m}), 0) * 100 / sum(students), 6) AS {m}_use_pct"
        for m in ("bus", "light_rail", "subway")
    ]
    + [
        f"round(coalesce(sum(students) FILTER (WHERE transfers > {n}), 0) * 100 / sum(students), 6)"
        f" AS pct_students_greater_than_{n}_transfer"
        for n in (0, 1)
    ]
    + [f"{_w('transfers')} AS transfers", f"{_w('legs')} AS legs", f"{_w('n_modes')} AS avg_modes",
       f"{_w('total_distance')} AS total_distance"]
    + [
        f"round(median({m}_time), 6) AS median_{m}_time, {_w(m + '_time')} AS mean_{m}_time,"
        f" {_w(m + '_distance')} AS {m}_distance"
        for m in MODES
    ]
)
_UNWEIGHTED = ", ".join(
    ["count(*) AS n", "CAST(sum(students) AS BIGINT) AS enrollment_approx",
     f"{_w('total_duration')} AS avg_total_duration", f"{_w('total_distance')} AS avg_total_distance"]
    + [
        f"round(count(*) FILTER (WHERE {col} > {c}) * 100 / count(*), 6) AS pct_over_{c}_{col}"
        for col, cuts in TRIP_CUTS.items()
        for c in cuts
    ]
)
_DEPART = """CAST(sum(students) AS BIGINT) AS students, round(avg(departure), 9) AS mean_departure,
    median(departure) AS median_departure, min(departure) AS earliest_departure,
    max(departure) AS latest_departure"""
_USED = "used AS (SELECT DISTINCT trip_id, route FROM l WHERE route IS NOT NULL)"

ORACLES = {
    "weighted_median": """
WITH c AS (
  SELECT l_returnflag || l_linestatus AS line, CAST(l_extendedprice AS DOUBLE) AS v, CAST(l_quantity AS BIGINT) AS w FROM lineitem
), r AS (
  SELECT line, v, 2 * sum(w) OVER (PARTITION BY line ORDER BY v ROWS UNBOUNDED PRECEDING) AS reached, sum(w) OVER (PARTITION BY line) AS whole
  FROM c WHERE w > 0
)
SELECT line, (min(v) FILTER (reached >= whole) + min(v) FILTER (reached > whole)) / 2 AS median_travel_time FROM r GROUP BY line
""",
    "trip_summary": f"""{_LEGS}, t AS (
          SELECT trip_id, string_agg(coalesce(CAST(l.route AS VARCHAR), '-'), ',' ORDER BY segment) AS routes,
                 string_agg(coalesce(name, '-'), ',' ORDER BY segment) AS short_names,
                 string_agg(mode, ',' ORDER BY segment) AS modes
          FROM l LEFT JOIN lines ON l.route = lines.route GROUP BY trip_id)
        SELECT s.* EXCLUDE ({', '.join(DISTANCES)}), routes, short_names, modes,
               {', '.join(f'round({c}, 9) AS {c}' for c in DISTANCES)}
        FROM s JOIN t ON s.trip_id = t.trip_id""",
    "trip_transfers": f"{_LEGS} SELECT trip_id, transfers, legs, n_modes FROM d",
    "trip_profile": f"{_LEGS} SELECT CAST(sum(students) AS BIGINT) AS enrollment_approx, {_PROFILE} FROM d",
    "trip_profile_unweighted": f"{_LEGS} SELECT {_UNWEIGHTED} FROM d",
    "trip_by_group": f"{_LEGS} SELECT school, {_UNWEIGHTED} FROM d GROUP BY school",
    "trip_by_tract": f"{_LEGS} SELECT tract, {_UNWEIGHTED} FROM d GROUP BY tract",
    "longest_trip": f"""{_LEGS} SELECT school, count(*) AS routes, CAST(sum(students) AS BIGINT) AS enrollment_approx,
        max(total_duration) AS max_total_duration, round(max(total_distance), 9) AS max_total_distance
        FROM d GROUP BY school""",
    "departure_profile": f"{_LEGS} SELECT bell, {_DEPART} FROM trips GROUP BY bell",
    "departure_profile_all": f"{_LEGS} SELECT {_DEPART} FROM trips",
    "travel_time_stats": f"""{_LEGS} SELECT
        round(sum(total_duration * students) / sum(students) FILTER (WHERE total_duration IS NOT NULL), 9)
          AS mean_travel_time,
        median(total_duration) AS median_travel_time, round(stddev_samp(total_duration), 9) AS sd_travel_time,
        min(total_duration) AS min_travel_time, max(total_duration) AS max_travel_time FROM d""",
    "route_popularity": f"""{_LEGS}, {_USED}
        SELECT used.route AS route, name, count(*) AS total_routes, CAST(sum(students) AS BIGINT) AS total_students
        FROM used JOIN trips ON used.trip_id = trips.trip_id JOIN lines ON used.route = lines.route
        WHERE name IS NOT NULL GROUP BY used.route, name""",
    "route_share": f"""{_LEGS}, {_USED}, c AS (SELECT route, count(*) AS n FROM used GROUP BY route)
        SELECT c.route AS route, n, round(n * 100 / sum(n) OVER (), 9) AS pct_of_trips, 100.0::DOUBLE AS sum, name
        FROM c LEFT JOIN lines ON c.route = lines.route""",
    "latest_departure": f"""{_LEGS}, q AS (
          SELECT l_orderkey AS trip_id, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1),
        g AS (SELECT trips.trip_id AS trip_id, bell, q, before FROM trips JOIN q ON trips.trip_id = q.trip_id,
              (SELECT unnest(range(10, 160, 10)) AS before)),
        p AS (SELECT trip_id, bell, bell - before * 60 AS at_secs, before,
              CASE WHEN (q + before // 10) % 11 <> 0 THEN q % 50 + 5 + (q * 7 + before * 3) % 23 END AS p50 FROM g),
        r AS (SELECT *, p50 <= before - 5 AS ok,
              bool_and(p50 <= before - 5) OVER (PARTITION BY trip_id ORDER BY at_secs) AS run FROM p),
        f AS (SELECT trip_id, max(at_secs) FILTER (WHERE run AND ok) AS latest,
              max_by(p50, at_secs) FILTER (WHERE run AND ok) AS travel_time, count(ok) AS n_probes
              FROM r GROUP BY trip_id)
        SELECT trips.trip_id AS trip_id, travel_time, coalesce(n_probes, 0) AS n_probes,
               CASE WHEN coalesce(n_probes, 0) = 0 THEN bell - 3600 ELSE latest END AS latest_departure
        FROM trips LEFT JOIN f ON trips.trip_id = f.trip_id""",
    "od_points": """SELECT c_custkey, c_nationkey AS home, c.c_mktsegment AS c_mktsegment, school_point,
        n_name AS home_point FROM customer c
        LEFT JOIN (SELECT c_mktsegment, min(c_acctbal) AS school_point FROM customer GROUP BY 1) g
          ON c.c_mktsegment = g.c_mktsegment
        LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 4) ON c_nationkey = n_nationkey""",
}
