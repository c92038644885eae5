"""Wall-clock arithmetic and the time-of-day rules.

Times of day are numbers of seconds since service-day midnight, not ``TIME``
values, because scheduled times may pass 24:00.  Nothing here depends on the
session time zone when the input is TIMESTAMP_NTZ.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000
MICROS = 1_000_000


def micros_of_day(ts: Column) -> Column:
    """Microseconds since midnight of the timestamp's own date."""
    whole = F.hour(ts) * 3600 + F.minute(ts) * 60
    return whole.cast("bigint") * MICROS + (F.extract(F.lit("SECOND"), ts) * MICROS).cast("bigint")


def wall_micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 00:00 on the same wall clock."""
    return F.unix_date(F.to_date(ts)).cast("bigint") * DAY_MICROS + micros_of_day(ts)


def service_micros(ts: Column, service_date: Column) -> Column:
    """Microseconds since midnight of the service day; passes 24 h after midnight."""
    days = F.date_diff(F.to_date(ts), service_date).cast("bigint")
    return days * DAY_MICROS + micros_of_day(ts)


def service_seconds(ts: Column, service_date: Column) -> Column:
    return service_micros(ts, service_date) / F.lit(float(MICROS))


def local_time(epoch_seconds: Column, zone: str) -> Column:
    """Epoch seconds (number or text) to TIMESTAMP_NTZ on the clock of ``zone``.

    The arithmetic starts from an NTZ epoch, so the session zone plays no part.
    """
    secs = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), epoch_seconds.try_cast("decimal(18,6)")
    )
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), secs)


def clock_parts(seconds: Column) -> dict[str, Column]:
    """Hour, minute and second of a seconds-of-day value; hours may exceed 23."""
    secs = seconds.cast("bigint")
    return {
        "hour": F.floor(secs / 3600).cast("bigint"),
        "minute": F.floor(F.pmod(secs, F.lit(3600)) / 60).cast("bigint"),
        "second": F.pmod(secs, F.lit(60)).cast("bigint"),
    }


def clock_seconds(text: Column) -> Column:
    """``H:MM[:SS]`` text to seconds; text of another shape gives NULL."""
    part = F.split(text, ":")
    return (
        F.try_element_at(part, F.lit(1)).try_cast("bigint") * 3600
        + F.try_element_at(part, F.lit(2)).try_cast("bigint") * 60
        + F.coalesce(F.try_element_at(part, F.lit(3)).try_cast("bigint"), F.lit(0))
    )


def date_key(date: Column) -> Column:
    """``2024-08-26`` -> ``20240826`` (the feed's start_date form)."""
    return F.date_format(date, "yyyyMMdd")


# Hours of the two peaks, scheduled-hour and observed-hour form.
MORNING_HOURS = (5, 6, 7, 8)
SCHOOL_MORNING_HOURS = (6, 7, 8)
AFTERNOON_HOURS = (14, 15, 16)
STUDY_HOURS = (5, 16)
POLL_START_HOUR = 4


def day_part(
    hour: Column,
    morning: tuple[int, ...] = MORNING_HOURS,
    afternoon: tuple[int, ...] = AFTERNOON_HOURS,
    otherwise: str | None = "other",
) -> Column:
    part = F.when(hour.isin(*afternoon), F.lit("afternoon")).when(hour.isin(*morning), F.lit("morning"))
    return part.otherwise(F.lit(otherwise)) if otherwise is not None else part


def in_hours(hour: Column, first: int = STUDY_HOURS[0], last: int = STUDY_HOURS[1]) -> Column:
    return hour.between(first, last)


def school_hours(hour: Column, minute: Column) -> Column:
    """Arrivals that could serve a bell: 06:00-08:59 and 14:21-16:59."""
    late_start = (hour == 14) & (minute > 20)
    return hour.isin(*SCHOOL_MORNING_HOURS) | late_start | hour.isin(15, 16)


def bell_window(part: Column, at: Column, opening: Column, closing: Column, minutes: int) -> Column:
    """Strictly inside the ``minutes`` before the opening or after the closing bell."""
    width = minutes * 60
    before = (part == "morning") & (at > opening - width) & (at < opening)
    after = (part == "afternoon") & (at > closing) & (at < closing + width)
    return before | after


def polling_hours(ts: Column, start: int = POLL_START_HOUR) -> Column:
    """The poller runs from ``start`` to midnight; an hour of day never reaches 24."""
    return F.hour(ts) >= start
