"""How students get to school: enrolment and modelled trips to reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timepoint.functions.text import slug
from timepoint.operators.joins import attach_bells, attach_enrollment, attach_names, od_with_points
from timepoint.operators.reshape import endpoints_to_rows, impute_masked, unpivot_wide
from timepoint.operators.trips import (
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
)

OD = ("from_id", "to_id")


def enrollment_pairs(wide: DataFrame, ids: Sequence[str] = ("prog_no", "program", "enrollment")) -> DataFrame:
    """School-tract pairs with their students, masked counts imputed."""
    pairs = unpivot_wide(wide, ids, "census_tract", "students", "x")
    return impute_masked(pairs, "students", known="program").withColumn("program_join", slug(F.col("program")))


def trips_to_model(pairs: DataFrame, schools: DataFrame, homes: DataFrame, bells: DataFrame) -> DataFrame:
    """Pairs with both end points and the bell times of the school.

    ``schools`` is keyed by prog_no, ``homes`` by census_tract, ``bells`` by prog_no.
    """
    placed = od_with_points(pairs, schools, homes, "prog_no", "census_tract")
    return attach_bells(placed, bells, ["prog_no"], "opening_secs", "closing_secs")


def router_points(trips: DataFrame, keep: Sequence[str] = ("prog_no", "census_tract")) -> DataFrame:
    """Both end points of each trip as rows, the form the router reads."""
    ends = {
        "home_tract_lat_lon": (F.col("tract_lat"), F.col("tract_lon")),
        "school_lat_lon": (F.col("school_lat"), F.col("school_lon")),
    }
    return endpoints_to_rows(trips, ends, keep)


def departures(probes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The latest departure that is still in time, for each pair.

    ``probes``: from_id, to_id, departure_time (seconds of the day),
    travel_time_p50 (minutes).  ``pairs``: from_id, to_id, opening_secs, ...
    """
    belled = probes.join(pairs.select(*OD, "opening_secs"), list(OD))
    judged = belled.withColumn(
        "on_time", on_time_probe(F.col("travel_time_p50"), F.col("departure_time"), F.col("opening_secs"))
    )
    found = latest_feasible_departure(judged, OD, "departure_time", "on_time", "travel_time_p50")
    return with_fallback_departure(pairs, found, OD, "opening_secs").withColumn(
        "arrival_time", F.col("latest_departure") + F.col("travel_time") * 60
    )


@dataclass(frozen=True)
class TripReports:
    trips: DataFrame
    profile: DataFrame
    city: DataFrame
    by_school: DataFrame
    by_tract: DataFrame
    longest: DataFrame
    departures_by_bell: DataFrame
    departures_all: DataFrame
    travel_times: DataFrame
    popular_routes: DataFrame
    used_routes: DataFrame


def trip_reports(legs: DataFrame, pairs: DataFrame, routes: DataFrame) -> TripReports:
    """``pairs`` come from ``departures``, with name, prog_no and students.

    ``routes``: route, name, short_name.
    """
    named = attach_names(legs, routes.select("route", "short_name"), ["route"])
    trips = attach_enrollment(pairs, trip_summary(named, OD, lists=True), OD)
    school = ["name", "prog_no"]
    names = routes.select("route", "name")
    return TripReports(
        trips=trips,
        profile=trip_profile(trips),
        city=trip_profile_unweighted(trips),
        by_school=trip_profile_unweighted(trips, school).orderBy(F.desc("n"), F.desc("pct_over_30_bus_time")),
        by_tract=trip_profile_unweighted(trips, ["from_id"]).orderBy(F.desc("pct_over_30_bus_time")),
        longest=longest_trip(trips, school),
        departures_by_bell=departure_profile(trips, "latest_departure", ["opening_secs"]),
        departures_all=departure_profile(trips, "latest_departure"),
        travel_times=travel_time_stats(trips, "travel_time", "students"),
        popular_routes=route_popularity(legs, trips, OD, names),
        used_routes=route_share(legs, OD, names),
    )
