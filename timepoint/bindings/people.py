"""Where people live: nations are tracts, regions areas, orders before and since 1995 the two censuses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timepoint.bindings import rounded, table
from timepoint.functions.geo import side_of
from timepoint.operators.joins import attach_area
from timepoint.operators.people import children_by_group, children_by_tract, ratio_of_totals, share_change

VARIABLES = ("BUILDING", "FURNITURE", "HOUSEHOLD")


# Both halves together are all orders.
TURN = "1995-06-01"


def census(spark: SparkSession, folder: str, year: int) -> DataFrame:
    """Long table of counts: one row for each order since the turn (2000) or before it (1996)."""
    turn = F.lit(TURN).cast("timestamp_ntz")
    taken = F.col("o_orderdate") >= turn if year == 2000 else F.col("o_orderdate") < turn
    o = table(spark, folder, "orders").where(taken).select("o_custkey")
    c = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("geoid"),
        F.col("c_mktsegment").alias("variable"),
    )
    return o.join(c, "o_custkey").select("geoid", "variable", F.lit(1).cast("bigint").alias("estimate"))


def crosswalk(spark, folder):
    """Tract to area; the tracts of one region are in none."""
    n = table(spark, folder, "nation").where("n_regionkey <> 4")
    return n.select(F.col("n_nationkey").alias("geoid"), F.col("n_regionkey").alias("area"))


def tracts(spark, folder, year):
    return children_by_tract(census(spark, folder, year), variables=VARIABLES)


def areas(spark, folder, year):
    return children_by_group(attach_area(tracts(spark, folder, year), crosswalk(spark, folder), "geoid"), "area")


def tract_shares(spark, folder):
    return rounded(tracts(spark, folder, 2000), 9, ["pct_kids"])


def area_shares(spark, folder):
    return rounded(areas(spark, folder, 2000), 6, ["pct_total"])


def side_shares(spark, folder):
    df = tracts(spark, folder, 2000).withColumn("side", side_of(F.col("geoid"), F.lit(12)))
    return rounded(children_by_group(df, "side"), 6, ["pct_total"])


def share_changes(spark, folder):
    df = share_change(areas(spark, folder, 2000), areas(spark, folder, 1996), "area", "2000", "1996")
    return rounded(df, 6, ["pct_total_2000", "pct_total_1996", "pct_diff"])


def totals_ratio(spark, folder):
    df = table(spark, folder, "lineitem")
    by = ratio_of_totals(df, "l_quantity", "l_linenumber", "minutes_per_worker", ["l_returnflag"])
    return by


QUERIES = {
    "children_shares": tract_shares,
    "children_by_area": area_shares,
    "children_by_side": side_shares,
    "share_change": share_changes,
    "ratio_of_totals": totals_ratio,
}


def _year_sql(year: int) -> str:
    return f"""k{year} AS (
  SELECT c_nationkey AS geoid,
         count(*) FILTER (WHERE c_mktsegment IN ('BUILDING', 'FURNITURE', 'HOUSEHOLD')) AS total_kids
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate {'>=' if year == 2000 else '<'} DATE '{TURN}'
  GROUP BY c_nationkey
), t{year} AS (
  SELECT *, CAST(sum(total_kids) OVER () AS BIGINT) AS all_kids,
         CAST(total_kids AS DOUBLE) * 100 / CAST(sum(total_kids) OVER () AS DOUBLE) AS pct_kids FROM k{year}
), a{year} AS (
  SELECT n_regionkey AS area, sum(pct_kids) AS pct_total, CAST(sum(total_kids) AS BIGINT) AS total_kids
  FROM t{year} LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 4) ON geoid = n_nationkey GROUP BY 1
)"""


ORACLES = {
    "children_shares": f"WITH {_year_sql(2000)} SELECT geoid, total_kids, all_kids, round(pct_kids, 9) AS pct_kids FROM t2000",
    "children_by_area": f"WITH {_year_sql(2000)} SELECT area, round(pct_total, 6) AS pct_total, total_kids FROM a2000",
    "children_by_side": f"""WITH {_year_sql(2000)} SELECT CASE WHEN geoid > 12 THEN 'east' ELSE 'west' END AS side,
        round(sum(pct_kids), 6) AS pct_total, CAST(sum(total_kids) AS BIGINT) AS total_kids FROM t2000 GROUP BY 1""",
    "share_change": f"""WITH {_year_sql(2000)}, {_year_sql(1996)}
        SELECT a2000.area AS area, round(a2000.pct_total, 6) AS pct_total_2000, a2000.total_kids AS total_kids_2000,
               round(a1996.pct_total, 6) AS pct_total_1996, a1996.total_kids AS total_kids_1996,
               round(a2000.pct_total - a1996.pct_total, 6) AS pct_diff
        FROM a2000 LEFT JOIN a1996 ON a2000.area IS NOT DISTINCT FROM a1996.area""",
    "ratio_of_totals": """SELECT l_returnflag, sum(l_quantity) / CAST(sum(l_linenumber) AS DOUBLE)
        AS minutes_per_worker FROM lineitem GROUP BY l_returnflag""",
}
