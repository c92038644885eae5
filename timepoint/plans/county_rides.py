"""Yellow-bus rides of the county: all summaries from the stop lists."""

from __future__ import annotations

from pyspark.sql import DataFrame

from timepoint.operators.rides import (
    AFTERNOON_TAG,
    MORNING_TAG,
    one_file_per_route,
    ride_time_by_route,
    ride_time_total,
    route_span,
    untagged_route_count,
    valid_county_stops,
    zone_route_span,
)


def routes_of(stops: DataFrame, tag: str | None, zone: bool = False, scope: str = "route") -> DataFrame:
    return one_file_per_route(ride_time_by_route(valid_county_stops(stops, tag, zone, scope)))


def county_reports(stops: DataFrame, scope: str = "route") -> dict[str, DataFrame]:
    out = {"spans": route_span(stops), "untagged": untagged_route_count(stops, scope)}
    for name, tag in (("morning", MORNING_TAG), ("afternoon", AFTERNOON_TAG)):
        routes = routes_of(stops, tag, False, scope)
        out[f"{name}_routes"] = routes
        out[f"{name}_total"] = ride_time_total(routes)
        out[f"{name}_zone_spans"] = zone_route_span(stops, tag, scope)
        out[f"{name}_zone_total"] = ride_time_total(routes_of(stops, tag, True, scope), weighted_clock=False)
    untagged = ride_time_by_route(valid_county_stops(stops, None, False, scope))
    out["untagged_total"] = ride_time_total(untagged, weighted_clock=False)
    return out
