"""Operators that depend on row order: previous value, numbering, first row.

A plain ``lag`` or ``row_number`` sends a whole group to one task.  Where a
group may be large, pass ``rows_per_piece``: groups with more rows than that are
range-sorted over the cluster by (keys, value, ties) into pieces of about so many
rows, wherever in the order that falls and whatever values are equal, and only
the borders of the pieces, one row for each, are ordered over the group.  All
other groups are ordered by the plain window.  The result is the same.

The input of the piecewise forms is read several times; pass a table or
``written`` rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timepoint.session import written

ROWS_PER_PIECE = 2_000_000


def split_hot(df: DataFrame, keys: Sequence[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups of at most ``most`` rows, and those of larger ones; None where there are none."""
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > most).select(*keys)
    if large.isEmpty():
        return df, None
    return same_keys_join(df, large, keys, "left_anti"), same_keys_join(df, large, keys, "left_semi")


def in_pieces(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], rows_per_piece: int) -> DataFrame:
    """The rows with the number of their piece (``_piece``) in the order of (keys, order).

    Written, because the borders between pieces are drawn from a sample: read
    again, every row keeps its piece.
    """
    pieces = max(2, math.ceil(df.count() / rows_per_piece))
    placed = df.repartitionByRange(pieces, *keys, *order).withColumn("_piece", F.spark_partition_id())
    return written(placed, "pieces")


def previous_value(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    out: str,
    tie: Sequence[str] = (),
    rows_per_piece: int | None = None,
) -> DataFrame:
    """Value of ``at`` on the row before, in (at, tie) order inside ``keys``.

    Rows with NULL ``at`` sort last: they get NULL and precede nobody.
    """
    return previous_values(df, keys, {out: at}, tie, rows_per_piece)


def previous_values(
    df: DataFrame, keys: Sequence[str], outs: Mapping[str, str], tie: Sequence[str] = (), rows_per_piece: int | None = None
) -> DataFrame:
    """``previous_value`` by several clocks (out -> at); the plain windows share one exchange."""
    keys, tie = list(keys), list(tie)
    plain, hot = (df, None) if rows_per_piece is None else split_hot(df, keys, rows_per_piece)
    for out, at in outs.items():
        w = Window.partitionBy(*keys).orderBy(F.col(at).asc_nulls_last(), *tie)
        plain = plain.withColumn(out, F.when(F.col(at).isNotNull(), F.lag(at).over(w)))
    if hot is None:
        return plain
    for out, at in outs.items():
        hot = _previous_in_pieces(hot, keys, at, out, tie, rows_per_piece)
    return plain.unionByName(hot)


def _previous_in_pieces(df, keys, at, out, tie, rows_per_piece) -> DataFrame:
    order = [F.col(at).asc_nulls_last(), *tie]
    placed = in_pieces(df, keys, order, rows_per_piece)
    inside = Window.partitionBy("_piece", *keys).orderBy(*order)
    ends = placed.where(F.col(at).isNotNull()).groupBy("_piece", *keys).agg(F.max(at).alias("_end"))
    before = F.lag("_end").over(Window.partitionBy(*keys).orderBy("_piece"))
    borders = ends.select("_piece", *keys, before.alias("_carried"))
    rows = placed.withColumn("_prev", F.lag(at).over(inside))
    met = same_keys_join(rows, borders, ["_piece", *keys], "left")
    value = F.when(F.col(at).isNotNull(), F.coalesce("_prev", "_carried"))
    return met.withColumn(out, value).drop("_piece", "_prev", "_carried")


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    out: str = "row",
    rows_per_piece: int | None = None,
) -> DataFrame:
    """1-based position inside ``keys`` by an explicit, unique order."""
    keys = list(keys)
    plain, hot = (df, None) if rows_per_piece is None else split_hot(df, keys, rows_per_piece)
    w = Window.partitionBy(*keys).orderBy(*order)
    numbered = plain.withColumn(out, F.row_number().over(w).cast("bigint"))
    if hot is None:
        return numbered
    placed = in_pieces(hot, keys, order, rows_per_piece)
    sizes = placed.groupBy("_piece", *keys).agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carry = sizes.select("_piece", *keys, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_piece", *keys).orderBy(*order)
    rows = same_keys_join(placed.withColumn("_nth", F.row_number().over(inside)), carry, ["_piece", *keys], "left")
    return numbered.unionByName(rows.withColumn(out, (F.col("_before") + F.col("_nth")).cast("bigint")).drop("_piece", "_nth", "_before"))


def number_all_rows(df: DataFrame, order: Sequence[str | Column], out: str = "row") -> DataFrame:
    """Positions 1..n over the whole table without a one-task window.

    The table is range-sorted and written with its numbers, so that the partition
    borders stay fixed on a retry; only the row counts per partition are
    accumulated, one small row for each partition.
    """
    placed = written(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_id", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("_part", part)
        .join(offsets, "_part")
        .withColumn(out, (F.col("_before") + inside + 1).cast("bigint"))
        .drop("_id", "_part", "_before")
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key by ``order``; combined map-side, no group is sorted."""
    return _pick(df, keys, order, F.min_by)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _pick(df, keys, order, F.max_by)


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in set(keys)]
    if not rest:
        return df.distinct()
    row = F.struct(*rest)
    best = df.groupBy(*keys).agg(pick(row, F.struct(*order)).alias("_row"))
    return best.select(*[c if c in set(keys) else F.col("_row")[c].alias(c) for c in df.columns])


def rows_at_minimum(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """All rows (ties included) whose ``value`` is the smallest of its group."""
    low = df.groupBy(*keys).agg(F.min(value).alias("_low"))
    return same_keys_join(df, low, keys, "inner").where(F.col(value) == F.col("_low")).drop("_low")


def same_keys_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi join in which NULL keys match, as they do in a grouping."""
    l, r = left.alias("_l"), right.alias("_r")
    cond = None
    for k in keys:
        same = F.col(f"_l.`{k}`").eqNullSafe(F.col(f"_r.`{k}`"))
        cond = same if cond is None else cond & same
    extra = [F.col(f"_r.`{c}`") for c in right.columns if c not in set(keys)]
    return l.join(r, cond, how).select("_l.*", *([] if how in ("left_anti", "left_semi") else extra))


def group_stats(df: DataFrame, keys: Sequence[str], of: DataFrame | None = None, **stats: Column) -> DataFrame:
    """Group aggregates (of the rows of ``of``, if given) kept on every row: aggregate, then join back.

    Unlike an unordered window this combines map-side, and the join back can be
    split by adaptive skew handling when one key is hot.
    """
    small = (df if of is None else of).groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
    return same_keys_join(df, small, keys, "left")


def share_of_total(df: DataFrame, value: str, out: str, total: str | None = None) -> DataFrame:
    """Percentage of the grand total; the total is a scalar subquery, not a window."""
    whole = df.agg(F.sum(value)).scalar()
    shared = df.withColumn(out, F.try_divide(F.col(value).cast("double") * 100, whole.cast("double")))
    return shared.withColumn(total, whole) if total else shared


def sample_one(df: DataFrame, keys: Sequence[str], id_col: str, seed: str) -> DataFrame:
    """One repeatable pseudo-random row per key: the smallest md5(seed|id)."""
    mixed = F.md5(F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string")).cast("binary"))
    return first_per_key(df.withColumn("_mix", mixed), keys, ["_mix", id_col]).drop("_mix")
