"""Aggregate expressions shared by the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column) -> Column:
    """Division that gives NULL for an empty or zero denominator."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def flag_share(flag: Column) -> Column:
    """Share of TRUE among the rows where the flag is known."""
    return F.avg(flag.cast("int"))


def count_where(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Sum(value*weight)/Sum(weight) over rows where both are present."""
    return ratio(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))


def percent_where(cond: Column, weight: Column | None = None) -> Column:
    """Percentage of rows (or of weight) meeting a condition; every row is in the base."""
    if weight is None:
        return ratio(count_where(cond) * 100, F.count(F.lit(1)))
    met = F.sum(F.when(cond, weight).otherwise(F.lit(0)))
    return ratio(met * 100, F.sum(weight))


def transfers(walk_legs: Column) -> Column:
    """Walk legs beyond the first and the last one."""
    return F.greatest(F.coalesce(walk_legs, F.lit(0)) - 2, F.lit(0))


# Unit factors.
MPH_PER_MPS = 2.23694
MILES_PER_METRE = 0.000621371


def mps_to_mph(speed: Column) -> Column:
    return speed * MPH_PER_MPS


def metres_to_miles(distance: Column) -> Column:
    return distance * MILES_PER_METRE
