"""Exact medians of many groups at once by selection: no sort of the table, no group held in one task.

The rows, widths and weights of all groups, at every grain, come from one scan. A group of more than ``gather`` rows is
narrowed first: its range is probed at ``CELLS`` equal steps, one more scan sums what lies in each cell for all such groups
together, and only the cell that holds the middle stays open, with the weight below it. Cells have their own least and
greatest value, so each round works on values that are there. What is left, at most ``gather`` rows of a group, is ordered
by a window. Each round is one aggregate with partial sums, whatever the skew of the groups.

A weighted median is the value at which half of the weight is reached, or the mean of it and the next one where half is
reached exactly; with equal weights that is the plain median. Weights should be whole numbers or decimals, whose sums do
not depend on the order; rows without a value or a weight above zero are left out, and a group of none has no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timepoint.operators.ordered import same_keys_join
from timepoint.session import written

GATHER = 1_000_000
CELLS = 256


def at_grains(df: DataFrame, grains: Sequence[Sequence[str]], value: str, weight: str | None) -> tuple[DataFrame, list[str]]:
    """A row for each grain (``_grain``, its place in the list) with the keys of that grain, others null, ``_v`` and ``_w``."""
    keys = list(dict.fromkeys(k for g in grains for k in g))
    rows = df.withColumns({"_v": F.col(value), "_w": F.col(weight) if weight else F.lit(1).cast("long")})
    rows = rows.where(F.col("_v").isNotNull() & (F.col("_w") > 0))
    kind = {f.name: f.dataType for f in df.schema}
    grain = [
        F.struct(F.lit(i).alias("_grain"), *[(F.col(k) if k in g else F.lit(None).cast(kind[k])).alias(k) for k in keys])
        for i, g in enumerate(grains)
    ]
    return rows.select(F.explode(F.array(*grain)).alias("_g"), "_v", "_w").select("_g.*", "_v", "_w"), ["_grain", *keys]


def _ordered(rows: DataFrame, of: list[str], out: str) -> DataFrame:
    """The medians of rows that are few for each group; ``_below`` and ``_whole`` are weights below them and of the group."""
    reached = 2 * (F.col("_below") + F.sum("_w").over(Window.partitionBy(*of).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    half = rows.withColumn("_reached", reached)
    first = F.min(F.when(F.col("_reached") >= F.col("_whole"), F.col("_v")))
    after = F.min(F.when(F.col("_reached") > F.col("_whole"), F.col("_v")))
    return half.groupBy(*of).agg(((first + after) / 2).cast("double").alias(out))


def _narrowed(rows: DataFrame, open_: DataFrame, of: list[str]) -> DataFrame:
    """The cells that hold the middle: one for a group, or two where the half is reached at the border between them."""
    inside = same_keys_join(rows, open_, of, "inner").where("_v >= _least and _v <= _greatest")
    v, least, greatest = (F.col(c).cast("double") for c in ("_v", "_least", "_greatest"))
    cell = F.least(F.floor(F.coalesce(F.try_divide(v - least, greatest - least), F.lit(0.0)) * CELLS), F.lit(CELLS - 1))
    cells = inside.groupBy(*of, "_whole", "_below", cell.alias("_cell")).agg(
        F.count("*").alias("_n"), F.min("_v").alias("_from"), F.max("_v").alias("_to"), F.sum("_w").alias("_own")
    )
    upto = F.col("_below") + F.sum("_own").over(Window.partitionBy(*of).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0))
    held = cells.withColumn("_upto", upto).where(
        (2 * F.col("_upto") >= F.col("_whole")) & (2 * (F.col("_upto") - F.col("_own")) <= F.col("_whole"))
    )
    return held.select(*of, "_whole", "_n", F.col("_from").alias("_least"), F.col("_to").alias("_greatest"), (F.col("_upto") - F.col("_own")).alias("_below"))


def medians(
    df: DataFrame, grains: Sequence[Sequence[str]], value: str, out: str = "median", weight: str | None = None, gather: int = GATHER
) -> DataFrame:
    """The median of ``value`` for each group of each grain: ``_grain``, the keys of all grains, ``out``.

    ``df`` is read twice, and once more for each round in which a group is narrowed; pass a table or ``written`` rows.
    """
    rows, of = at_grains(df, grains, value, weight)
    sizes = rows.groupBy(*of).agg(
        F.count("*").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_greatest"), F.sum("_w").alias("_whole")
    )
    large = written(sizes.where(F.col("_n") > gather).withColumn("_below", F.lit(0)), "large-groups")
    if large.isEmpty():
        if weight is None:  # a counter for each value of a group, of which there are at most ``gather``
            return rows.groupBy(*of).agg(F.median("_v").cast("double").alias(out))
        whole = F.sum("_w").over(Window.partitionBy(*of))
        return _ordered(rows.withColumns({"_whole": whole, "_below": F.lit(0)}), of, out)
    whole = F.sum("_w").over(Window.partitionBy(*of))
    small = same_keys_join(rows, large.select(*of), of, "left_anti").withColumns({"_whole": whole, "_below": F.lit(0)})
    found, open_ = _ordered(small, of, out), large
    while not open_.isEmpty():
        held = written(_narrowed(rows, open_, of), "cells")
        # Two cells: the half is reached at the end of the first one, so the values beside the border make the median.
        settled = held.groupBy(*of).agg(
            F.count("*").alias("_cells"), F.min("_greatest").alias("_a"), F.max("_least").alias("_b"), F.max("_n").alias("_most"),
            F.max(F.col("_least") == F.col("_greatest")).alias("_one"),
        )
        done = settled.where("_cells = 2 or _one")
        found = found.unionByName(done.select(*of, ((F.col("_a") + F.col("_b")) / 2).cast("double").alias(out)))
        rest = same_keys_join(held, done.select(*of), of, "left_anti")
        few = rest.where(F.col("_n") <= gather)
        met = same_keys_join(rows, few.select(*of, "_least", "_greatest", "_whole", "_below"), of, "inner")
        found = found.unionByName(_ordered(met.where("_v >= _least and _v <= _greatest"), of, out))
        open_ = rest.where(F.col("_n") > gather)
    return found


def weighted_median(df: DataFrame, keys: Sequence[str], value: str, weight: str, out: str = "weighted_median", gather: int = GATHER) -> DataFrame:
    """The value of each group at which half of the weight is reached."""
    return medians(df, [list(keys)], value, out, weight, gather).drop("_grain")
