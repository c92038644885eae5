"""Yellow-bus ride times from the stop lists of county routes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timepoint.functions.stats import ratio, weighted_mean
from timepoint.operators.ordered import first_per_key, group_stats

# Marks in the route and location texts.
MORNING_TAG, AFTERNOON_TAG = " AM", " PM"
ZONE_MARK = "NON-TRANSPORTED ZONE"
CROSSING = "**RAILROAD CROSSING - PROCEED WITH CAUTION**"
ROUTE_KEYS = ("route", "source_file")


def with_span(stops: DataFrame, keys: Sequence[str] = ROUTE_KEYS) -> DataFrame:
    """Last stop and last time of the route on each stop row."""
    return group_stats(stops, keys, max_stop=F.max("stop"), max_time=F.max("time"))


def route_span(stops: DataFrame, keys: Sequence[str] = ROUTE_KEYS) -> DataFrame:
    """Rows, stops, net students (0 when the sheet was read whole), first and last time."""
    return stops.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.max("stop").alias("max_stop"),
        F.sum("students").alias("net_students"),
        F.min("time").alias("min_time"),
        F.max("time").alias("max_time"),
    )


def valid_county_stops(
    stops: DataFrame, tag: str | None = MORNING_TAG, zone: bool = False, scope: str = "route"
) -> DataFrame:
    """Stops that count: right tag, no empty first or last stop, no crossing.

    ``tag`` None takes the routes with neither tag.  The last stop is that of
    the route, or with ``scope='table'`` the highest number of the whole table.
    The rows come with ``max_stop`` and ``max_time`` of their route.
    """
    spanned = with_span(stops)
    route, students = F.col("route"), F.col("students")
    if tag is None:
        tagged = ~(route.contains(MORNING_TAG) | route.contains(AFTERNOON_TAG))
    else:
        tagged = route.contains(tag)
    in_zone = route.contains(ZONE_MARK)
    last = F.col("max_stop") if scope == "route" else stops.agg(F.max("stop")).scalar()
    return spanned.where(
        tagged
        & (in_zone if zone else ~in_zone)
        & ~((F.col("stop") == 1) & (students == 0))
        & ~((F.col("stop") == last) & (students == 0))
        & (F.col("location") != CROSSING)
    )


def ride_time_by_route(valid: DataFrame, keys: Sequence[str] = ROUTE_KEYS, min_minutes: float | None = 1) -> DataFrame:
    """Minutes to the last stop, weighted by the students who board."""
    boards = F.col("students") > 0
    weight = F.when(boards, F.col("students"))
    # Whole seconds are summed exactly; minutes come at the end.
    ride = F.col("max_time") - F.col("time")
    routes = valid.groupBy(*keys).agg(
        (weighted_mean(ride, weight) / 60).alias("avg_time"),
        (F.avg(F.when(boards, ride)) / 60).alias("unweighted_avg_time"),
        weighted_mean(F.col("time"), weight).alias("avg_boarding_time"),
        weighted_mean(F.col("max_time"), weight).alias("avg_alighting_time"),
        F.coalesce(F.sum(weight), F.lit(0)).alias("students"),
    )
    return routes if min_minutes is None else drop_short_routes(routes, min_minutes)


def drop_short_routes(routes: DataFrame, minutes: float = 1) -> DataFrame:
    return routes.where(F.col("avg_time") > minutes)


def one_file_per_route(routes: DataFrame) -> DataFrame:
    """A route that several source files list counts once: the first file by name."""
    return first_per_key(routes, ["route"], ["source_file"])


def ride_time_total(routes: DataFrame, weighted_clock: bool = True) -> DataFrame:
    """All routes together; clock times by student, or plain means."""
    w = F.col("students")

    def clock(col: str):
        return weighted_mean(F.col(col), w) if weighted_clock else F.avg(col)

    return routes.agg(
        F.count(F.lit(1)).alias("n"),
        weighted_mean(F.col("avg_time"), w).alias("avg_time"),
        F.avg("unweighted_avg_time").alias("unweighted_avg_time"),
        clock("avg_boarding_time").alias("avg_boarding_time"),
        clock("avg_alighting_time").alias("avg_alighting_time"),
        F.sum(w).alias("students"),
        ratio(F.sum(w), F.count(F.lit(1))).alias("students_per_route"),
    )


def untagged_route_count(stops: DataFrame, scope: str = "route") -> DataFrame:
    """Routes that are neither morning nor afternoon: stops and students."""
    valid = valid_county_stops(stops, None, False, scope)
    return valid.groupBy(*ROUTE_KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("students") > 0, F.col("students"))), F.lit(0)).alias("students"),
    )


def zone_route_span(stops: DataFrame, tag: str, scope: str = "route") -> DataFrame:
    """Zone routes: rows, most students at a stop, minutes between first and last stop."""
    valid = valid_county_stops(stops, tag, True, scope)
    spans = valid.groupBy(*ROUTE_KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        F.max("students").alias("students"),
        F.min("time").alias("min_time"),
        F.max("time").alias("last_time"),
    )
    timed = spans.withColumn("net_time", (F.col("last_time") - F.col("min_time")) / 60)
    return one_file_per_route(timed)
