"""On-time reports: daily rates at one or several grains, then rates over days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timepoint.functions.stats import count_where, flag_share, ratio
from timepoint.operators.ordered import ROWS_PER_PIECE, same_keys_join
from timepoint.operators.selection import medians

SHARE_FLAGS = {
    "on_time_perc": "on_time",
    "on_time_perc_5": "on_time_5",
    "on_time_perc_4": "on_time_4",
    "on_time_perc_20": "on_time_20",
    "optimistic_on_time_perc": "optimistic_on_time",
    "pessimistic_on_time_perc": "pessimistic_on_time",
    "headway_adherence": "headway_adherence",
}


def observed_share(observed: Column) -> Column:
    return ratio(F.count(observed), F.count(F.lit(1)))


def middle(value: Column, approximate: bool = False) -> Column:
    """Exact median by default.

    The exact one keeps one counter for each distinct value of a group, which
    is bounded when values are whole seconds or minutes of a day.  For values
    without such a bound ``exact_median`` is the way.
    """
    return F.percentile_approx(value, 0.5, 10_000) if approximate else F.median(value)


def _daily_measures(observed: str, date: str, approximate: bool) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        F.count(observed).alias("n_observed"),
        count_where(F.col("on_time")).alias("n_on_time"),
        F.min(date).alias("min_date"),
        F.max(date).alias("max_date"),
        observed_share(F.col(observed)).alias("observed"),
        middle(F.col("observed_pct"), approximate).alias("median_observed"),
        *[flag_share(F.col(flag)).alias(name) for name, flag in SHARE_FLAGS.items()],
        F.avg("headway").alias("mean_headway"),
        middle(F.col("headway"), approximate).alias("median_headway"),
    ]


def otp_daily(
    adherence: DataFrame,
    by: Sequence[str] = (),
    date: str = "service_date",
    part: str = "time",
    observed: str = "obs_secs",
    approximate: bool = False,
    fine_clock: bool = False,
) -> DataFrame:
    """Rates for each service day and day part, also by line or by stop; ``fine_clock`` as in ``otp_grains``."""
    measures, keys = _daily_measures(observed, date, approximate), [date, part, *by]
    if not fine_clock:
        return adherence.groupBy(*keys).agg(*measures)
    rates = adherence.groupBy(*keys).agg(*measures[:-1])
    return same_keys_join(rates, exact_median(adherence, keys, "headway", "median_headway"), keys, "left")


def otp_grains(
    adherence: DataFrame,
    line: str,
    stop: str,
    date: str = "service_date",
    part: str = "time",
    observed: str = "obs_secs",
    approximate: bool = False,
    fine_clock: bool = False,
) -> DataFrame:
    """System, line and stop grain from one scan, told apart by ``grain``.

    With ``fine_clock`` the headways have no bound on their distinct values
    (fractions of seconds), and their medians come from ``medians``, for all
    grains at once; the input is then read several times.
    """
    d, p, l, s = (F.col(c) for c in (date, part, line, stop))
    level = F.grouping_id(date, part, line, stop).cast("bigint")
    grain = F.when(level == 3, "system").when(level == 1, "line").otherwise("stop")
    measures = _daily_measures(observed, date, approximate)
    if fine_clock:
        measures = measures[:-1]  # without the median of headways
    rates = adherence.groupingSets([[d, p], [d, p, l], [d, p, s]], d, p, l, s).agg(grain.alias("grain"), *measures)
    if not fine_clock:
        return rates
    every = medians(adherence, [[date, part], [date, part, line], [date, part, stop]], "headway", "median_headway")
    named = F.element_at(F.array(F.lit("system"), F.lit("line"), F.lit("stop")), F.col("_grain") + 1)
    every = every.withColumn("grain", named).drop("_grain")
    return same_keys_join(rates, every, ["grain", date, part, line, stop], "left")


MEANS = (
    "observed",
    "on_time_perc",
    "on_time_perc_5",
    "on_time_perc_4",
    "on_time_perc_20",
    "optimistic_on_time_perc",
    "pessimistic_on_time_perc",
    "mean_headway",
)
MEDIANS = ("median_observed", "median_headway")


def otp_period(daily: DataFrame, by: Sequence[str] = ("time",), strict: bool = False) -> DataFrame:
    """Unweighted means of the daily rates and medians of the daily medians.

    A day without a value is left out, and ``n_days_used`` counts the days that
    entered ``on_time_perc``.  With ``strict`` one such day makes the mean
    NULL, as an average that does not skip missing values would.
    ``pooled_*`` are totals over totals.
    """

    def over_days(agg: Column, name: str) -> Column:
        if not strict:
            return agg
        return F.when(F.count(name) == F.count(F.lit(1)), agg)

    return daily.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_days"),
        F.count("on_time_perc").alias("n_days_used"),
        F.sum("n").alias("n_rows"),
        ratio(F.sum("n"), F.count(F.lit(1))).alias("n_per_day"),
        F.min("min_date").alias("min_date"),
        F.max("max_date").alias("max_date"),
        *[over_days(F.avg(m), m).alias(m) for m in MEANS],
        *[over_days(F.median(m), m).alias(m) for m in MEDIANS],
        ratio(F.sum("n_observed"), F.sum("n")).alias("pooled_observed"),
        ratio(F.sum("n_on_time"), F.sum("n_observed")).alias("pooled_on_time_perc"),
    )


def exact_median(
    df: DataFrame, keys: Sequence[str], value: str, out: str = "median", rows_per_piece: int = ROWS_PER_PIECE
) -> DataFrame:
    """Exact median of values of any spread by selection, with no group held in one task (``medians``)."""
    return medians(df, [list(keys)], value, out, gather=rows_per_piece).drop("_grain")
