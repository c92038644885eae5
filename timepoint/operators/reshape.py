"""Wide to long and back, list columns, stacking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Riders assumed behind a masked count.
MASKED_COUNT = 5


def unpivot_wide(df: DataFrame, ids: Sequence[str], name: str, value: str, prefix: str = "x") -> DataFrame:
    """One row for each id and wide column; the columns' prefix is taken off."""
    wide = [c for c in df.columns if c not in set(ids)]
    return df.unpivot(list(ids), wide, name, value).withColumn(
        name, F.regexp_replace(name, f"^{prefix}", "")
    )


def impute_masked(df: DataFrame, value: str, fill: int = MASKED_COUNT, known: str | None = None) -> DataFrame:
    """Masked counts become ``fill``; then only positive counts (of known schools) stay."""
    filled = df.withColumn(value, F.coalesce(F.col(value), F.lit(fill)))
    keep = F.col(value) > 0
    return filled.where(keep if known is None else keep & F.col(known).isNotNull())


def pivot_sums(df: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence[str]) -> DataFrame:
    """Listed values of ``name`` as columns, each a sum."""
    return df.groupBy(*keys).pivot(name, list(names)).agg(F.sum(value))


def stack(*frames: DataFrame) -> DataFrame:
    """Rows of all tables by column name; missing columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def split_to_rows(df: DataFrame, col: str, out: str, separator: str = ", ") -> DataFrame:
    return df.withColumn(out, F.explode(F.split(col, separator)))


def explode_list(df: DataFrame, col: str, keep_empty: bool = False) -> DataFrame:
    step = F.explode_outer if keep_empty else F.explode
    return df.withColumn(col, step(col))


def endpoints_to_rows(df: DataFrame, points: Mapping[str, tuple[Column, Column]], keep: Sequence[str]) -> DataFrame:
    """One row for each named endpoint, with its lat and lon."""
    ends = [
        F.struct(F.lit(kind).alias("coord_type"), lat.alias("lat"), lon.alias("lon"))
        for kind, (lat, lon) in points.items()
    ]
    return df.select(*keep, F.inline(F.array(*ends)))
