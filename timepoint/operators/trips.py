"""Modelled trips to school: legs to trips, trips to reports, latest departures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timepoint.functions.stats import count_where, metres_to_miles, percent_where, ratio, transfers, weighted_mean
from timepoint.operators.ordered import share_of_total

# Mode codes of the router and the names used for them.
WALK = "WALK"
MODES = {"bus": "BUS", "walk": "WALK", "subway": "SUBWAY", "light_rail": "TRAM"}
DISTANCES = ("total", *MODES)


def trip_summary(
    legs: DataFrame,
    keys: Sequence[str],
    lists: bool = False,
    miles: bool = True,
    names: str = "short_name",
) -> DataFrame:
    """One row for each trip: totals, time and distance by mode, mode counts.

    Everything the reports need is a plain aggregate, combined map-side.  With
    ``lists`` the routes, line names and modes come out too, in leg order; an
    itinerary has a handful of legs, so these arrays are short.
    """
    mode = F.col("mode")
    aggs = [
        F.min_by("total_duration", "segment").alias("total_duration"),
        F.min_by("total_distance", "segment").alias("total_distance"),
        F.max("segment").alias("trip_legs"),
        F.count(F.lit(1)).alias("legs"),
        count_where(mode == WALK).alias("walk_legs"),
        F.size(F.collect_set(mode)).cast("bigint").alias("n_modes"),
        F.coalesce(F.sum("wait"), F.lit(0)).alias("wait"),
    ]
    for name, code in MODES.items():
        used = mode == code
        aggs += [
            F.coalesce(F.sum(F.when(used, F.col("segment_duration"))), F.lit(0)).alias(f"{name}_time"),
            F.coalesce(F.sum(F.when(used, F.col("distance"))), F.lit(0)).alias(f"{name}_distance"),
            F.coalesce(F.bool_or(used), F.lit(False)).alias(f"uses_{name}"),
        ]
    columns = {"routes": "route", "short_names": names, "modes": "mode"}
    if lists:
        leg = F.struct("segment", *[F.col(c).alias(out) for out, c in columns.items()])
        aggs.append(F.array_sort(F.collect_list(leg)).alias("_legs"))
    trips = legs.groupBy(*keys).agg(*aggs)
    if lists:
        trips = trips.withColumns({out: F.col("_legs")[out] for out in columns}).drop("_legs")
    if miles:
        trips = trips.withColumns({f"{d}_distance": metres_to_miles(F.col(f"{d}_distance")) for d in DISTANCES})
    return trips


def with_transfers(trips: DataFrame) -> DataFrame:
    """Transfers and legs; a trip without an itinerary has none of either."""
    return trips.withColumns(
        {
            "transfers": transfers(F.col("walk_legs")),
            "legs": F.coalesce("legs", F.lit(0)),
            "n_modes": F.coalesce("n_modes", F.lit(0)),
        }
    )


def trip_profile(trips: DataFrame, students: str = "students") -> DataFrame:
    """City-wide averages by student; the medians are of trips, not weighted.

    A median keeps a counter for each distinct value; times are whole minutes or
    seconds of one trip, so there are few.
    """
    w = F.col(students)

    def mean(col: str) -> Column:
        return weighted_mean(F.col(col), w)

    aggs = [F.sum(w).alias("enrollment_approx"), mean("total_duration").alias("total_duration")]
    aggs += [percent_where(F.col(f"uses_{m}"), w).alias(f"{m}_use_pct") for m in ("bus", "light_rail", "subway")]
    aggs += [
        percent_where(F.col("transfers") > n, w).alias(f"pct_students_greater_than_{n}_transfer") for n in (0, 1)
    ]
    aggs += [
        mean("transfers").alias("transfers"),
        mean("legs").alias("legs"),
        mean("n_modes").alias("avg_modes"),
        mean("total_distance").alias("total_distance"),
    ]
    for m in MODES:
        aggs += [
            F.median(f"{m}_time").alias(f"median_{m}_time"),
            mean(f"{m}_time").alias(f"mean_{m}_time"),
            mean(f"{m}_distance").alias(f"{m}_distance"),
        ]
    return with_transfers(trips).agg(*aggs)


# Limits of the report, in minutes and in transfers.
TRIP_CUTS = {"total_duration": (30, 45, 60), "bus_time": (30, 45), "walk_time": (30, 45), "transfers": (0, 1, 2)}


def threshold_flags(df: DataFrame, cuts: Mapping[str, Sequence[float]] = TRIP_CUTS) -> DataFrame:
    """``over_30_bus_time`` and the like; NULL where the value is missing."""
    return df.withColumns({f"over_{c}_{col}": F.col(col) > c for col, limits in cuts.items() for c in limits})


def trip_profile_unweighted(
    trips: DataFrame,
    by: Sequence[str] = (),
    students: str = "students",
    cuts: Mapping[str, Sequence[float]] = TRIP_CUTS,
) -> DataFrame:
    """Shares of trips over each limit, for the city or by school or tract."""
    flagged = threshold_flags(with_transfers(trips), cuts)
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.sum(students).alias("enrollment_approx"),
        weighted_mean(F.col("total_duration"), F.col(students)).alias("avg_total_duration"),
        weighted_mean(F.col("total_distance"), F.col(students)).alias("avg_total_distance"),
    ]
    aggs += [
        percent_where(F.col(f"over_{c}_{col}")).alias(f"pct_over_{c}_{col}")
        for col, limits in cuts.items()
        for c in limits
    ]
    return flagged.groupBy(*by).agg(*aggs)


def longest_trip(trips: DataFrame, by: Sequence[str], students: str = "students") -> DataFrame:
    return trips.groupBy(*by).agg(
        F.count(F.lit(1)).alias("routes"),
        F.sum(students).alias("enrollment_approx"),
        F.max("total_duration").alias("max_total_duration"),
        F.max("total_distance").alias("max_total_distance"),
    )


def departure_profile(trips: DataFrame, departure: str, by: Sequence[str] = (), students: str = "students"):
    """Departure clock times, as seconds, per bell time or overall."""
    return trips.groupBy(*by).agg(
        F.sum(students).alias("students"),
        F.avg(departure).alias("mean_departure"),
        F.median(departure).alias("median_departure"),
        F.min(departure).alias("earliest_departure"),
        F.max(departure).alias("latest_departure"),
    )


def travel_time_stats(df: DataFrame, value: str, weight: str) -> DataFrame:
    """The mean is weighted, the median and the spread are not.

    The median keeps a counter for each distinct time, whole seconds or minutes.
    """
    return df.agg(
        weighted_mean(F.col(value), F.col(weight)).alias("mean_travel_time"),
        F.median(value).alias("median_travel_time"),
        F.stddev_samp(value).alias("sd_travel_time"),
        F.min(value).alias("min_travel_time"),
        F.max(value).alias("max_travel_time"),
    )


def trip_routes(legs: DataFrame, keys: Sequence[str], route: str = "route") -> DataFrame:
    """Each trip with each route it uses, once; straight from the legs, no list column."""
    return legs.where(F.col(route).isNotNull()).select(*keys, route).distinct()


def route_popularity(
    legs: DataFrame, trips: DataFrame, keys: Sequence[str], names: DataFrame, students: str = "students",
    route: str = "route", name: str = "name",
) -> DataFrame:
    """Trips and students on each named route, most students first."""
    used = trip_routes(legs, keys, route).join(trips.select(*keys, students), list(keys))
    counts = used.groupBy(route).agg(
        F.count(F.lit(1)).alias("total_routes"), F.sum(students).alias("total_students")
    )
    named = counts.join(names, route, "left").where(F.col(name).isNotNull())
    return named.orderBy(F.desc("total_students"), route)


def route_share(legs: DataFrame, keys: Sequence[str], names: DataFrame, route: str = "route") -> DataFrame:
    """Trips on each route as a share of all trip-route pairs; ``sum`` checks for 100."""
    counts = trip_routes(legs, keys, route).groupBy(route).agg(F.count(F.lit(1)).alias("n"))
    shares = share_of_total(counts, "n", "pct_of_trips", total="_all")
    checked = shares.withColumn("sum", ratio(F.col("_all") * 100, F.col("_all"))).drop("_all")
    return checked.join(names, route, "left").orderBy(F.desc("n"), route)


# Minutes before the bell that are probed, arrival margin, fallback.
PROBE_MINUTES = tuple(range(150, 9, -10))
ARRIVE_BEFORE = 5
FALLBACK_BEFORE = 60


def on_time_probe(travel_minutes: Column, departure: Column, bell: Column) -> Column:
    """Does a departure (seconds) reach the school five minutes before the bell?"""
    return travel_minutes <= (bell - ARRIVE_BEFORE * 60 - departure) / 60


def latest_feasible_departure(
    probes: DataFrame, keys: Sequence[str], departure: str, on_time: str, travel: str
) -> DataFrame:
    """The last departure before the first late one, earliest probe first.

    Probes are reduced to one row for each candidate departure before they are
    ordered, so a group is never longer than the probe grid.  A probe without
    a result does not end the run.
    """
    step = probes.groupBy(*keys, departure).agg(
        F.bool_and(on_time).alias("_ok"), F.min(travel).alias("_travel")
    )
    so_far = Window.partitionBy(*keys).orderBy(departure).rowsBetween(Window.unboundedPreceding, 0)
    run = step.withColumn("_run", F.bool_and("_ok").over(so_far))
    kept = F.when(F.col("_run") & F.col("_ok").isNotNull(), F.col(departure))
    return run.groupBy(*keys).agg(
        F.max(kept).alias("latest_departure"),
        F.max_by(F.when(kept.isNotNull(), F.col("_travel")), kept).alias("travel_time"),
        F.count("_ok").alias("n_probes"),
    )


def with_fallback_departure(pairs: DataFrame, found: DataFrame, keys: Sequence[str], bell: str) -> DataFrame:
    """Pairs without any travel time leave an hour before the bell."""
    joined = pairs.join(found, list(keys), "left")
    none = F.coalesce("n_probes", F.lit(0)) == 0
    return joined.withColumn(
        "latest_departure",
        F.when(none, F.col(bell) - FALLBACK_BEFORE * 60).otherwise(F.col("latest_departure")),
    ).withColumn("n_probes", F.coalesce("n_probes", F.lit(0)))
