"""Timetable against observation: match, delay flags, headways, trip coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timepoint.operators.ordered import ROWS_PER_PIECE, group_stats, previous_value, previous_values
from timepoint.session import written


@dataclass(frozen=True)
class DelayWindows:
    """Tolerance limits; all in the unit of the delay (seconds by default)."""

    # Windows of the published analysis, bounds inclusive.
    on_time: Mapping[str, tuple[float | None, float]] = None
    late: Mapping[str, float] = None
    early: Mapping[str, float] = None

    def __post_init__(self):
        defaults = {
            "on_time": {
                "on_time": (-120, 420),
                "on_time_5": (-60, 300),
                "on_time_4": (-60, 240),
                "on_time_20": (None, 1200),
            },
            "late": {"late": 420, "late_5": 300, "late_4": 240, "late_20": 1200},
            "early": {"early": -120, "early_1": -60},
        }
        for name, value in defaults.items():
            if getattr(self, name) is None:
                object.__setattr__(self, name, value)


# Headway limits (minutes over, share under).
HEADWAY_SLACK = 3.0
BUNCHED_RATIO = 0.75


def match_schedule(
    timetable: DataFrame,
    observed: DataFrame,
    keys: Sequence[str],
    scheduled: str,
    split_hot: bool = True,
) -> DataFrame:
    """Timetable rows with a scheduled time, left-joined to what was observed.

    Rows nobody observed stay: they are the buses that never came.  Both sides
    compare the keys as text where their types differ, because ids come as
    numbers from one source and as text from the other.  No join hint: the
    planner broadcasts a side only when its measured size allows it.

    An outer join can be split on its left side only, and it is the sightings
    that pile up on one key (vehicles without a real trip id).  So the matched
    rows come from an inner join, which adaptive execution splits on either
    side, and the others from an anti join with the distinct keys.  With
    ``split_hot`` off it is one outer join, for sightings known to be even.
    """
    keys = list(keys)
    left = timetable.where(F.col(scheduled).isNotNull())
    right = observed
    for key in keys:
        if left.schema[key].dataType != right.schema[key].dataType:
            left = left.withColumn(key, F.col(key).cast("string"))
            right = right.withColumn(key, F.col(key).cast("string"))
    if split_hot:
        missing = missing_buses(left, right, keys)
        joined = left.join(right, keys, "inner").unionByName(missing, allowMissingColumns=True)
    else:
        joined = left.join(right, keys, "left")
    return joined.withColumn("planned", F.col(scheduled).isNotNull())


def missing_buses(timetable: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Timetable rows nobody observed: the closing batch of a streamed day.

    The distinct keys are combined before they are shuffled.
    """
    return timetable.join(seen.select(*keys).distinct(), list(keys), "left_anti")


def add_delay(df: DataFrame, scheduled: str, observed: str, out: str = "delay") -> DataFrame:
    """Signed delay, computed once; every flag below reads it."""
    return df.withColumn(out, F.col(observed) - F.col(scheduled))


def on_time_flags(df: DataFrame, delay: str = "delay", windows: DelayWindows = DelayWindows()) -> DataFrame:
    d = F.col(delay)
    flags = {
        name: (d <= high) if low is None else d.between(low, high)
        for name, (low, high) in windows.on_time.items()
    }
    return df.withColumns(flags)


def late_early_flags(df: DataFrame, delay: str = "delay", windows: DelayWindows = DelayWindows()) -> DataFrame:
    d = F.col(delay)
    flags = {name: d > limit for name, limit in windows.late.items()}
    flags |= {name: d < limit for name, limit in windows.early.items()}
    return df.withColumns(flags)


def minutes_late(df: DataFrame, delay: str = "delay", per_minute: float = 60.0) -> DataFrame:
    return df.withColumn("minutes_late", F.col(delay) / F.lit(per_minute))


def on_time_bounds(df: DataFrame, observed: str, flag: str = "on_time") -> DataFrame:
    """A missing bus counts as on time (optimistic) or as not on time (pessimistic)."""
    missing = F.col(observed).isNull()
    return df.withColumns(
        {
            "optimistic_on_time": F.when(missing, F.lit(True)).otherwise(F.col(flag)),
            "pessimistic_on_time": F.when(missing, F.lit(False)).otherwise(F.col(flag)),
        }
    )


def add_headway(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    out: str,
    tie: Sequence[str] = (),
    per_minute: float = 60.0,
    rows_per_piece: int | None = None,
) -> DataFrame:
    """Minutes since the previous arrival in the group, by the clock in ``at``."""
    prev = previous_value(df, keys, at, "_before", tie, rows_per_piece)
    return prev.withColumn(out, (F.col(at) - F.col("_before")) / F.lit(per_minute)).drop("_before")


def headway_flags(
    df: DataFrame,
    observed: str = "headway",
    scheduled: str = "scheduled_headway",
    slack: float = HEADWAY_SLACK,
    ratio: float = BUNCHED_RATIO,
) -> DataFrame:
    """Too far apart, too close together, and neither of the two."""
    h, s = F.col(observed), F.col(scheduled)
    over, bunched = h > s + slack, h < s * ratio
    return df.withColumns(
        {"over_spaced": over, "bunched": bunched, "headway_adherence": ~(over | bunched)}
    )


def trip_coverage(df: DataFrame, keys: Sequence[str], row: str, observed: str, of: DataFrame | None = None) -> DataFrame:
    """Planned stops, observed rows and their ratio for each trip, on every row.

    Several vehicles on one trip give several matches, so the ratio can pass 1.
    ``of`` are the rows to count, where ``df`` is the same rows after dearer steps.
    """
    whole = group_stats(
        df,
        keys,
        of,
        planned_stops=F.max(row).cast("bigint"),
        observed_stops=F.count(observed),
    )
    share = F.try_divide(F.col("observed_stops").cast("double"), F.col("planned_stops").cast("double"))
    return whole.withColumn("observed_pct", share)


def assess(
    timetable: DataFrame,
    observed: DataFrame,
    match_keys: Sequence[str],
    headway_keys: Sequence[str],
    trip_keys: Sequence[str],
    scheduled: str = "sched_secs",
    seen_at: str = "obs_secs",
    row: str = "row",
    tie: Sequence[str] = (),
    windows: DelayWindows = DelayWindows(),
    per_minute: float = 60.0,
    rows_per_piece: int = ROWS_PER_PIECE,
) -> DataFrame:
    """The whole adherence table.

    The match is computed once and written; coverage and both headways read it.
    Headway groups of more than ``rows_per_piece`` rows are ordered in pieces,
    all others whole, both clocks on one exchange.
    """
    matched = written(match_schedule(timetable, observed, match_keys, scheduled), "matched")
    clocks = {"_seen_before": seen_at, "_planned_before": scheduled}
    spaced = previous_values(matched, headway_keys, clocks, tie, rows_per_piece).withColumns(
        {
            "headway": (F.col(seen_at) - F.col("_seen_before")) / F.lit(per_minute),
            "scheduled_headway": (F.col(scheduled) - F.col("_planned_before")) / F.lit(per_minute),
        }
    )
    # The summary of coverage repeats nothing but a scan of the match.
    covered = trip_coverage(spaced.drop(*clocks), trip_keys, row, seen_at, of=matched)
    flagged = covered.transform(headway_flags).transform(add_delay, scheduled, seen_at)
    flagged = flagged.transform(on_time_flags, "delay", windows).transform(late_early_flags, "delay", windows)
    return flagged.transform(minutes_late, "delay", per_minute).transform(on_time_bounds, seen_at)
