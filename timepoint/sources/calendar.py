"""Service days: weekdays that are neither a holiday nor inside a break."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Days without school, and breaks with both ends included.
HOLIDAYS = (
    "2017-09-04", "2017-09-21", "2017-09-22", "2017-10-09", "2017-11-10", "2017-11-23", "2017-11-24",
    "2017-12-22", "2017-12-25", "2017-12-26", "2017-12-27", "2017-12-28", "2017-12-29",
    "2018-09-03", "2018-09-10", "2018-09-19", "2018-09-20", "2018-11-12", "2018-11-22", "2018-11-23",
    "2018-12-24", "2018-12-25", "2018-12-26", "2018-12-27", "2018-12-28", "2018-12-31",
    "2019-09-02", "2019-09-30", "2019-10-01", "2019-10-09", "2019-10-14", "2019-11-11", "2019-11-27",
    "2019-11-28", "2019-11-29", "2019-12-23", "2019-12-24", "2019-12-25",
    "2020-01-01", "2020-01-20", "2020-02-17", "2020-04-10", "2020-05-25", "2020-06-05", "2020-06-11",
    "2020-06-12", "2020-06-15", "2020-06-16", "2020-06-17", "2020-06-18", "2020-06-19",
    "2021-01-01", "2021-01-18", "2021-02-15", "2021-04-02", "2021-05-31", "2021-06-18", "2021-06-21",
    "2021-06-22", "2021-06-23", "2021-06-24", "2021-06-25",
    "2022-01-17", "2022-02-21", "2022-04-15", "2022-05-30", "2022-06-17", "2022-06-20", "2022-06-21",
    "2022-06-22", "2022-06-23", "2022-06-24", "2022-09-05", "2022-11-11", "2022-11-24", "2022-11-25",
    "2023-01-01",
    "2024-09-02", "2024-10-18", "2024-11-04", "2024-11-05",
)
BREAKS = (
    ("2017-03-24", "2017-04-03"), ("2017-06-16", "2017-09-05"), ("2018-03-30", "2018-04-06"),
    ("2018-06-15", "2018-09-04"), ("2019-04-19", "2019-04-26"), ("2019-06-14", "2019-09-03"),
    ("2020-04-06", "2020-04-13"), ("2020-06-15", "2020-09-08"), ("2021-03-26", "2021-04-05"),
    ("2021-06-21", "2021-09-08"), ("2022-04-15", "2022-04-22"), ("2022-06-20", "2022-09-06"),
    ("2022-12-22", "2023-01-04"), ("2024-11-27", "2024-11-30"), ("2024-12-23", "2025-01-06"),
)
STUDY_START, STUDY_END = "2024-08-26", "2025-01-14"


def is_service_day(
    date: Column,
    holidays: Sequence[str] = HOLIDAYS,
    breaks: Sequence[tuple[str, str]] = BREAKS,
) -> Column:
    """The calendar as a predicate: no join, and on a date partition it prunes folders."""
    ok = F.weekday(date) < 5
    if holidays:
        ok = ok & ~date.isin(*[dt.date.fromisoformat(d) for d in holidays])
    for first, last in breaks:
        ok = ok & ~date.between(dt.date.fromisoformat(first), dt.date.fromisoformat(last))
    return ok


def service_calendar(
    spark: SparkSession,
    start: str = STUDY_START,
    end: str = STUDY_END,
    holidays: Sequence[str] = HOLIDAYS,
    breaks: Sequence[tuple[str, str]] = BREAKS,
) -> DataFrame:
    """One row for each service day of a range, as ``date``."""
    every = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return spark.range(1).select(every.alias("date")).where(is_service_day(F.col("date"), holidays, breaks))


def service_days_only(
    df: DataFrame,
    date: str,
    holidays: Sequence[str] = HOLIDAYS,
    breaks: Sequence[tuple[str, str]] = BREAKS,
) -> DataFrame:
    return df.where(is_service_day(F.col(date), holidays, breaks))
