"""Look-up joins.  None carries a broadcast hint: a look-up table that is small
by its measured size is broadcast by the planner, a large one is not."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timepoint.operators.ordered import number_all_rows, same_keys_join


def as_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Ids arrive as numbers or as text; joins compare them as text."""
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


def attach_names(df: DataFrame, names: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join to a list of names (routes, lines); rows without a name stay."""
    return df.join(names, list(keys), "left")


def attach_stop_schools(
    df: DataFrame, stop_school: DataFrame, stop: str, school: str | Sequence[str], also: Sequence[str] = ()
) -> DataFrame:
    """One row for each school near the stop (and of the same ``also`` columns); rows near no school go."""
    schools = [school] if isinstance(school, str) else list(school)
    return df.join(stop_school.select(stop, *also, *schools).distinct(), [stop, *also], "inner")


def attach_bells(df: DataFrame, bells: DataFrame, keys: Sequence[str], opening: str, closing: str) -> DataFrame:
    """Bell times by school; rows of schools without any bell time go."""
    joined = df.join(bells, list(keys), "left")
    return joined.where(F.col(opening).isNotNull() | F.col(closing).isNotNull())


def attach_area(df: DataFrame, crosswalk: DataFrame, key: str) -> DataFrame:
    """Tract to community area; tracts without an area stay under NULL."""
    return df.join(crosswalk, key, "left")


def matched_only(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An outer join followed by dropping the unmatched is an inner join."""
    return df.join(other, list(keys), "inner")


def od_with_points(
    od: DataFrame, schools: DataFrame, homes: DataFrame, school_key: str, home_key: str
) -> DataFrame:
    """Origin-destination rows with the school's and the home tract's point."""
    return od.join(schools, school_key, "left").join(homes, home_key, "left")


def attach_enrollment(trips: DataFrame, enrollment: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Trips with the riders of their key, as many key columns as needed."""
    return trips.join(enrollment, list(keys), "left")


def difference(new: DataFrame, old: DataFrame, key: str, new_share: str, old_share: str, out: str) -> DataFrame:
    """Change of a share between two periods, for every key of the newer one.

    The NULL key (places without an area) of one period meets that of the other.
    """
    return same_keys_join(new, old, [key], "left").withColumn(out, F.col(new_share) - F.col(old_share))


def zip_rows(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """Pair rows by position; each side names the order its position comes from."""
    l = number_all_rows(left, left_order, "row_number")
    r = number_all_rows(right, right_order, "row_number")
    return l.join(r, "row_number", "left")


def look_up_text(df: DataFrame, col: str, text: str) -> DataFrame:
    return df.where(F.col(col).contains(text))


def recode_join(df: DataFrame, col: str, names: DataFrame, key: str, value: str) -> DataFrame:
    """Recode through a table, for maps too long for a literal."""
    pairs = names.select(F.col(key).alias(col), F.col(value).alias("_new"))
    return df.join(pairs, col, "left").withColumn(col, F.coalesce("_new", col)).drop("_new")


def keep_days(df: DataFrame, days: DataFrame, date: str) -> DataFrame:
    """Rows on listed days (a semi join on the calendar)."""
    return df.join(days.select(F.col("date").alias(date)), date, "left_semi")


def not_in(values: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Values of the first table that the second lacks."""
    return values.join(others.select(key), key, "left_anti")


def map_column(mapping: Mapping[str, str]) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.create_map(*pairs)
