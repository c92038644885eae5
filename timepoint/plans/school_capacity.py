"""Are there enough buses: arrivals near each school against the riders in need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timepoint.functions.clock import SCHOOL_MORNING_HOURS, day_part
from timepoint.functions.geo import HALF_MILE, NEAR_SCHOOL
from timepoint.functions.text import percent_number, recode, word_count
from timepoint.operators.arrivals import (
    PARTS,
    arrival_period,
    arrival_stats_wide,
    attach_classes,
    bell_classes,
    bus_capacity,
    near_bell,
    near_school_share,
    part_buses,
)
from timepoint.operators.joins import attach_bells, zip_rows
from timepoint.operators.reshape import split_to_rows
from timepoint.operators.spatial import point_in_polygon_join, within_distance_flag, within_distance_join
from timepoint.sources.tables import ATTENDANCE_NAMES, PARCEL_NAMES


def school_parcels(parcels: DataFrame) -> DataFrame:
    """One row for each school of a parcel, names as in the school list."""
    renamed = parcels.withColumn("schools_at_parcel", recode(F.col("schools_at_parcel"), PARCEL_NAMES))
    return split_to_rows(renamed.distinct(), "schools_at_parcel", "school_name")


def stops_near_schools(stops: DataFrame, schools: DataFrame, metres: float = HALF_MILE) -> DataFrame:
    """(stop_id, school) pairs within true metres of the school's point.

    ``stops``: stop_id, lon, lat.  ``schools``: school, school_lon, school_lat.
    """
    pairs = within_distance_join(
        stops, schools, metres, ("lon", "lat"), ("school_lon", "school_lat"), metres=True
    )
    return pairs.select("stop_id", "school").distinct()


def stops_near_parcels(stops: DataFrame, parcels: DataFrame, metres: float = HALF_MILE) -> DataFrame:
    """The same by the parcel's outline.  ``parcels``: school, ring (lon, lat)."""
    hits = point_in_polygon_join(stops, parcels, ("lon", "lat"), 0.02, how="inner", pad=metres, metres=True)
    return hits.select("stop_id", "school").distinct()


def daily_arrivals(arrivals: DataFrame, stop_school: DataFrame, bells: DataFrame, minutes: int = 30) -> DataFrame:
    """Buses per school, day and day part within ``minutes`` of the bell.

    ``arrivals``: ``planned_arrivals``, or an adherence table.
    ``bells``: school, opening_secs, closing_secs.  The arrival itself is
    tested for the hour and joined at stop grain, so no ping geometry is needed.
    Rows of schools without any bell time go.
    """
    part = day_part(F.col("obs_hour"), morning=SCHOOL_MORNING_HOURS, otherwise=None)
    # Schools with the same bells are one at a stop, so arrivals are not multiplied by the schools around it.
    belled = attach_bells(stop_school.select("stop_id", "school").distinct(), bells, ["school"], "opening_secs", "closing_secs")
    classes = bell_classes(belled, "stop_id", "school", "opening_secs", "closing_secs")
    seen = arrivals.where(F.col("obs_secs").isNotNull()).select(
        "stop_id", "service_date", "vehicle_id", "trip_id", "obs_hour", "obs_minute", "obs_secs"
    )
    near = attach_classes(seen, classes, "stop_id", part, "opening_secs", "closing_secs")
    kept = near_bell(near, "obs_hour", "obs_minute", "obs_secs", "opening_secs", "closing_secs", minutes)
    return part_buses(kept, ["school", "service_date"], "obs_hour", ["vehicle_id", "trip_id"], part, classes)


def arrivals_over_period(daily: DataFrame) -> DataFrame:
    wide = arrival_stats_wide(daily, ["school", "service_date"])
    days = wide.withColumns({"min_date": F.col("service_date"), "max_date": F.col("service_date")})
    return arrival_period(days, "school")


def attendance_table(extract: DataFrame) -> DataFrame:
    """The broken extract mended: names and numbers stand on different lines.

    Names of more than one word and complete number rows are paired by
    position; percentages become numbers and short names their full form.
    """
    numbers = ("first_period", "all_other_periods", "difference")
    names = extract.where(word_count(F.col("school")) > 1).select("school", "line")
    complete = extract.where(" AND ".join(f"{c} IS NOT NULL" for c in numbers)).select(
        *numbers, F.col("line").alias("_line")
    )
    paired = zip_rows(names, complete, ["line"], ["_line"]).drop("line", "_line", "row_number")
    return paired.withColumns({c: percent_number(F.col(c)) for c in numbers}).withColumn(
        "school", recode(F.col("school"), ATTENDANCE_NAMES)
    )


def capacity_report(
    homes: DataFrame,
    period: DataFrame,
    enrollment: DataFrame,
    attendance: DataFrame | None = None,
    near_metres: float = NEAR_SCHOOL,
) -> DataFrame:
    """Seats as a percentage of need, for each bus size and day part.

    ``homes``: school, students, lon, lat, school_lon, school_lat.
    ``enrollment``: school, enrollment.
    """
    flagged = within_distance_flag(homes, ("lon", "lat"), ("school_lon", "school_lat"), near_metres)
    share = near_school_share(flagged, "school", "students", "is_within")
    joined = share.join(enrollment, "school", "left").join(period, "school", "left")
    out = bus_capacity(joined, "enrollment", {p: f"median_{p}" for p in PARTS})
    return out if attendance is None else out.join(attendance, "school", "left")
