"""Where children live: census tracts, sides of the city, community areas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timepoint.functions.stats import ratio
from timepoint.operators.joins import difference
from timepoint.operators.ordered import share_of_total

# The census counts of boys and girls under 18 by age group.
CHILD_VARIABLES = (
    "B01001_003", "B01001_004", "B01001_005", "B01001_006",
    "B01001_027", "B01001_028", "B01001_029", "B01001_030",
)
COMMUTERS, COMMUTE_MINUTES = "B08006_001E", "B08013_001E"


def children_by_tract(
    acs: DataFrame, tract: str = "geoid", variables: Sequence[str] = CHILD_VARIABLES
) -> DataFrame:
    """Children of each tract and their percentage of the city's.

    Summed straight from the long form, without the wide table in between.
    """
    wanted = F.when(F.col("variable").isin(*variables), F.col("estimate"))
    kids = acs.groupBy(tract).agg(F.coalesce(F.sum(wanted), F.lit(0)).alias("total_kids"))
    return share_of_total(kids, "total_kids", "pct_kids", total="all_kids")


def children_by_group(tracts: DataFrame, group: str) -> DataFrame:
    """By side of the city or by community area, largest share first; NULL is a group."""
    sums = tracts.groupBy(group).agg(
        F.sum("pct_kids").alias("pct_total"), F.sum("total_kids").alias("total_kids")
    )
    return sums.orderBy(F.desc("pct_total"), group)


def share_change(new: DataFrame, old: DataFrame, key: str, new_tag: str, old_tag: str) -> DataFrame:
    """Shares of both periods side by side and the difference in points."""
    n = new.withColumnsRenamed({"pct_total": f"pct_total_{new_tag}", "total_kids": f"total_kids_{new_tag}"})
    o = old.withColumnsRenamed({"pct_total": f"pct_total_{old_tag}", "total_kids": f"total_kids_{old_tag}"})
    return difference(n, o, key, f"pct_total_{new_tag}", f"pct_total_{old_tag}", "pct_diff").orderBy(
        F.desc(f"pct_total_{old_tag}"), key
    )


def ratio_of_totals(df: DataFrame, top: str, bottom: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Total over total, e.g. commute minutes by workers."""
    return df.groupBy(*by).agg(ratio(F.sum(top), F.sum(bottom)).alias(out))
