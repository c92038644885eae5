"""Text clean-up expressions."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# School classes that count as middle or high schools.
SCHOOL_LEVELS = "9 - 12|6 - 12|6 - 8|5 - 8"


def base_stop_id(stop_id: Column) -> Column:
    """Drop everything from the first underscore on."""
    return F.regexp_replace(stop_id, "_.*", "")


def slug(name: Column) -> Column:
    return F.lower(F.replace(name, F.lit(" "), F.lit("_")))


def percent_number(text: Column) -> Column:
    return F.replace(text, F.lit("%"), F.lit("")).try_cast("double")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\w+"))


def strip_prefix(text: Column, prefix: str) -> Column:
    return F.replace(text, F.lit(prefix), F.lit(""))


def school_level(klass: Column, pattern: str = SCHOOL_LEVELS) -> Column:
    return klass.rlike(pattern)


def recode(value: Column, names: dict[str, str]) -> Column:
    """Replace listed values, keep the others.  ``names`` is a literal map."""
    if not names:
        return value
    lookup = F.create_map(*[F.lit(x) for x in chain.from_iterable(names.items())])
    return F.coalesce(F.try_element_at(lookup, value), value)


def snake(name: str) -> str:
    """One column name in snake_case, as the sources' clean-up produces it."""
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name.strip())
    spaced = spaced.replace("%", "_percent_").replace("#", "_number_")
    plain = re.sub(r"[^0-9A-Za-z]+", "_", spaced).strip("_").lower()
    return f"x{plain}" if plain[:1].isdigit() or not plain else plain


def clean_names(df: DataFrame) -> DataFrame:
    """snake_case column names; repeats get _2, _3, ..."""
    seen: dict[str, int] = {}
    out = []
    for raw in df.columns:
        name = snake(raw)
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*out)
