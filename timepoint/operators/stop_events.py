"""From vehicle reports to one event for each vehicle, trip and stop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timepoint.functions.text import base_stop_id
from timepoint.operators.ordered import last_per_key, rows_at_minimum

STOP_KEYS = ("vehicle_id", "label", "trip_id", "route_id", "stop_id", "start_date")


def prepare_pings(pings: DataFrame, stop: str = "stop_id", route: str = "route_id") -> DataFrame:
    """Plain stop ids and a mark on reports without a route."""
    return pings.withColumn("no_route_id", F.col(route).isNull()).withColumn(stop, base_stop_id(F.col(stop)))


def stop_events(
    pings: DataFrame,
    keys: Sequence[str] = STOP_KEYS,
    at: str = "ts",
    tie: Sequence[str] = (),
    trip: str | None = "trip_id",
) -> DataFrame:
    """The last report while a stop was the next one; reports without trip or time do not count.

    A map-side combined ``max_by``: what is shuffled is one row for each group
    and task, so a vehicle parked at a stop for hours costs no more than others.
    """
    known = F.col(at).isNotNull()
    if trip is not None:
        known = known & F.col(trip).isNotNull()
    return last_per_key(pings.where(known), keys, [at, *tie])


def stop_events_slowest(pings: DataFrame, keys: Sequence[str] = STOP_KEYS, speed: str = "speed_mps") -> DataFrame:
    """The other rule: every report with the lowest speed of its group."""
    return rows_at_minimum(pings, keys, speed)
