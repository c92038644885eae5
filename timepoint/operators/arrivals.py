"""Buses that reach a school around its bells, and the seats they offer."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timepoint.functions.clock import bell_window, day_part, school_hours
from timepoint.functions.clock import SCHOOL_MORNING_HOURS
from timepoint.functions.stats import ratio
from timepoint.operators.joins import attach_stop_schools

PARTS = ("morning", "afternoon")
# Seats on a bus, and the share living near when none is known (%).
SEATS = (25, 35, 45, 60)
DEFAULT_NEAR_PERCENT = 12.14193


def near_bell(
    arrivals: DataFrame, hour: str, minute: str, at: str, opening: str, closing: str, minutes: int = 30
) -> DataFrame:
    """Arrivals in school hours, strictly within ``minutes`` of the matching bell."""
    part = day_part(F.col(hour), morning=SCHOOL_MORNING_HOURS, otherwise=None)
    kept = arrivals.where(school_hours(F.col(hour), F.col(minute))).withColumn("time", part)
    return kept.where(bell_window(F.col("time"), F.col(at), F.col(opening), F.col(closing), minutes))


def hourly_buses(arrivals: DataFrame, place: Sequence[str], hour: str, bus: Sequence[str]) -> DataFrame:
    """Distinct buses per place and hour, in two combining steps."""
    return arrivals.select(*place, hour, *bus).distinct().groupBy(*place, hour).agg(F.count(F.lit(1)).alias("n"))


def part_buses(
    arrivals: DataFrame, place: Sequence[str], hour: str, bus: Sequence[str], part: Column,
    near: DataFrame | None = None, stop: str = "stop_id",
) -> DataFrame:
    """Per day part: ``n`` counts a bus again in each clock hour, ``n_unique`` once.

    With ``near`` the arrivals are at stops, and ``near`` says which places a stop counts for: ``bell_classes``, with the
    columns of ``place`` that the arrivals lack. The result is that of the arrivals joined to ``near``, which are not made.
    """
    by_part = arrivals.withColumn("time", part)
    if near is not None:
        return _part_buses_near(by_part, place, hour, bus, near, stop)
    hours = by_part.select(*place, "time", hour, *bus).distinct()
    # One row for each bus, carrying the number of hours it was seen in.
    buses = hours.groupBy(*place, "time", *bus).agg(F.count(F.lit(1)).alias("_hours"))
    return buses.groupBy(*place, "time").agg(
        F.sum("_hours").alias("n"), F.count(F.lit(1)).alias("n_unique")
    )


def bell_classes(belled: DataFrame, stop: str, school: str, opening: str, closing: str) -> DataFrame:
    """The schools at each stop with their bells of each part: stop, school, ``time``, ``bells`` (sorted, distinct)."""
    of_part = F.array(
        F.struct(F.lit("morning").alias("time"), F.col(opening).alias("bell")),
        F.struct(F.lit("afternoon").alias("time"), F.col(closing).alias("bell")),
    )
    rows = belled.select(stop, school, F.inline(of_part)).where(F.col("bell").isNotNull())
    return rows.groupBy(stop, school, "time").agg(F.array_sort(F.collect_set("bell")).alias("bells"))


def attach_classes(arrivals: DataFrame, classes: DataFrame, stop: str, part: Column, opening: str, closing: str) -> DataFrame:
    """A row for each bell of each class of schools at the stop, whatever the number of schools in it."""
    rows = classes.select(stop, "time", "bells").distinct().withColumn("bell", F.explode("bells"))
    met = arrivals.withColumn("time", part).join(rows, [stop, "time"])
    return met.withColumns(
        {opening: F.when(F.col("time") == "morning", F.col("bell")), closing: F.when(F.col("time") == "afternoon", F.col("bell"))}
    ).drop("bell")


def _part_buses_near(arrivals, place, hour, bus, near, stop) -> DataFrame:
    """Buses are counted by the set of stops they came to, and the sets, not the buses, meet the places.

    A bus counts once for a place however many of the place's stops it came to. The stops of one bus in one day part are
    few; so are the sets, next to the buses: those of one stop are summed as they are, the others once for each place.
    """
    own = [c for c in place if c not in near.columns]
    visits = arrivals.groupBy(*own, "time", "bells", *bus).agg(F.collect_set(F.struct(F.col(hour).alias("h"), F.col(stop).alias("s"))).alias("_v"))

    def stops(v: Column, n: int) -> Column:
        found = F.array_sort(F.array_distinct(F.transform(v, lambda x: x["s"])))
        return F.struct(found.alias("_stops"), F.lit(n).cast("bigint").alias("n"), F.lit(1 - n).cast("bigint").alias("n_unique"))

    hours = F.array_distinct(F.transform("_v", lambda x: x["h"]))
    hourly = F.transform(hours, lambda h: stops(F.filter("_v", lambda x: x["h"].eqNullSafe(h)), 1))
    sets = visits.select(*own, "time", "bells", F.inline(F.concat(hourly, F.array(stops(F.col("_v"), 0)))))
    counts = sets.groupBy(*own, "time", "bells", "_stops").agg(F.sum("n").alias("n"), F.sum("n_unique").alias("n_unique"))
    several = F.when(F.size("_stops") > 1, F.col("_stops")).alias("_several")
    at_stops = counts.select(*own, "time", "bells", several, F.explode("_stops").alias(stop), "n", "n_unique")
    met = attach_stop_schools(at_stops, near, stop, [c for c in place if c in near.columns], ["time", "bells"])
    once = met.groupBy(*place, "time", "_several").agg(
        *[F.when(F.col("_several").isNull(), F.sum(c)).otherwise(F.max(c)).alias(c) for c in ("n", "n_unique")]
    )
    return once.groupBy(*place, "time").agg(F.sum("n").alias("n"), F.sum("n_unique").alias("n_unique"))


STATS = ("avg_n", "max_n", "min_n", "median_n", "sd_n", "min_day", "max_day", "sd_as_pct")


def _stats(value: Column, date: Column) -> dict[str, Column]:
    return {
        "avg_n": F.avg(value),
        "max_n": F.max(value),
        "min_n": F.min(value),
        "median_n": F.median(value),
        "sd_n": F.stddev_samp(value),
        "min_day": F.min(date),
        "max_day": F.max(date),
        "sd_as_pct": F.try_divide(F.stddev_samp(value) * 100, F.avg(value)),
    }


def arrival_stats(daily: DataFrame, keys: Sequence[str], value: str = "n", date: str = "service_date") -> DataFrame:
    aggs = _stats(F.col(value), F.col(date))
    return daily.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])


def arrival_stats_wide(
    daily: DataFrame, keys: Sequence[str], value: str = "n", date: str = "service_date", part: str = "time"
) -> DataFrame:
    """The statistics of both day parts side by side: ``avg_n_morning`` and so on."""
    aggs = [c.alias(n) for n, c in _stats(F.col(value), F.col(date)).items()]
    wide = daily.groupBy(*keys).pivot(part, list(PARTS)).agg(*aggs)
    names = {f"{p}_{s}": f"{s}_{p}" for p in PARTS for s in STATS}
    return wide.withColumnsRenamed(names)


def collapse_mean(df: DataFrame, key: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Mean of every other column for each key, missing values left out."""
    cols = [c for c in df.columns if c != key] if cols is None else list(cols)
    return df.groupBy(key).agg(*[F.avg(c).alias(c) for c in cols])


def arrival_period(daily_wide: DataFrame, key: str) -> DataFrame:
    """Over all days: means of the daily means, medians of medians, extremes."""
    aggs = [
        F.count(F.lit(1)).alias("n_days"),
        F.min("min_date").alias("min_date"),
        F.max("max_date").alias("max_date"),
    ]
    for p in PARTS:
        aggs += [
            F.avg(f"avg_n_{p}").alias(f"avg_{p}"),
            F.median(f"median_n_{p}").alias(f"median_{p}"),
            F.max(f"max_n_{p}").alias(f"max_{p}"),
            F.min(f"min_n_{p}").alias(f"min_{p}"),
        ]
    return daily_wide.groupBy(key).agg(*aggs)


def near_school_share(homes: DataFrame, key: str, students: str, near: str) -> DataFrame:
    """Riders, riders living near their school, and the percentage."""
    totals = homes.groupBy(key).agg(
        F.sum(students).alias("n_students"),
        F.coalesce(F.sum(F.when(F.col(near), F.col(students))), F.lit(0)).alias("n_students_within"),
    )
    return totals.withColumn("within_pct", ratio(F.col("n_students_within") * 100, F.col("n_students")))


def bus_capacity(
    schools: DataFrame,
    enrollment: str,
    median_buses: Mapping[str, str],
    seats: Sequence[int] = SEATS,
    default_near: float = DEFAULT_NEAR_PERCENT,
) -> DataFrame:
    """Seats offered as a percentage of the riders who need one, per day part."""
    near = F.coalesce(F.col("within_pct"), F.lit(default_near))
    need = F.col(enrollment).cast("double") * (1 - near / 100)
    return schools.withColumns(
        {
            f"capacity_{size}_{part}": F.try_divide(F.col(median) * size, need) * 100
            for part, median in median_buses.items()
            for size in seats
        }
    )


def schools_per_stop(stop_school: DataFrame, stop: str, school: str) -> DataFrame:
    """The sorted list of schools near each stop; a stop reaches few schools."""
    pairs = stop_school.select(stop, school).distinct()
    return pairs.groupBy(stop).agg(F.array_sort(F.collect_list(school)).alias("schools"))
