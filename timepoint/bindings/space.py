"""Embeddings as places: x and y are the first two values, label 0 are schools.

The map grows with the number of places, so that as many lie around each one
whatever the size of the table, and pairs grow in proportion to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timepoint.bindings import rounded, table
from timepoint.operators.arrivals import schools_per_stop
from timepoint.operators.ordered import sample_one
from timepoint.operators.spatial import (
    dissolve_and_centroid,
    point_in_polygon_join,
    spatial_anti_join,
    split_by_side,
    vertex_mean_center,
    within_distance_by_place,
    within_distance_flag,
    within_distance_join,
)
from timepoint.sources.tables import min_value_cells, raster_points

RADIUS = 0.05
PAD = 0.02


def places(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    scale = F.sqrt(vectors.agg(F.count(F.lit(1))).scalar() / F.lit(500.0))
    return vectors.select(
        "vec_id",
        (F.col("embedding")[0].cast("double") * scale).alias("x"),
        (F.col("embedding")[1].cast("double") * scale).alias("y"),
        F.col("label").cast("bigint").alias("label"),
    )


def schools(spark, folder):
    return places(spark, folder).where("label = 0").select(
        F.col("vec_id").alias("school_id"), F.col("x").alias("sx"), F.col("y").alias("sy")
    )


def _point(x, y):
    return F.struct(x.alias("x"), y.alias("y"))


def squares(spark, folder):
    x, y, r = F.col("sx"), F.col("sy"), F.lit(RADIUS)
    ring = F.array(_point(x - r, y - r), _point(x + r, y - r), _point(x + r, y + r), _point(x - r, y + r))
    return schools(spark, folder).select("school_id", ring.alias("ring"))


def near_schools(spark, folder):
    near = within_distance_join(places(spark, folder), schools(spark, folder), RADIUS, ("x", "y"), ("sx", "sy"))
    return near.select("vec_id", "school_id")


def near_schools_salted(spark, folder):
    near = within_distance_join(
        places(spark, folder), schools(spark, folder), RADIUS, ("x", "y"), ("sx", "sy"), how="left", salts=4
    )
    return near.select("vec_id", "school_id")


def near_schools_by_place(spark, folder):
    """Events placed by their user's point: many reports share one place."""
    at = places(spark, folder).withColumnRenamed("vec_id", "user_id")
    reports = table(spark, folder, "events").select("event_id", "user_id").join(at, "user_id")
    near = within_distance_by_place(reports, schools(spark, folder), RADIUS, ("x", "y"), ("sx", "sy"))
    return near.groupBy("school_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


def stop_school_lists(spark, folder):
    lists = schools_per_stop(near_schools(spark, folder), "vec_id", "school_id")
    return lists.select("vec_id", F.concat_ws(",", F.transform("schools", lambda s: s.cast("string"))).alias("schools"))


def points_in_polygon(spark, folder):
    hit = point_in_polygon_join(places(spark, folder), squares(spark, folder), ("x", "y"), 2 * RADIUS)
    return hit.select("vec_id", "school_id")


def points_outside(spark, folder):
    return spatial_anti_join(places(spark, folder), squares(spark, folder), ("x", "y"), 2 * RADIUS, PAD).select(
        "vec_id", "x", "y"
    )


def near_own_school(spark, folder):
    """Each home against the middle of the schools, within one row."""
    first = schools(spark, folder)
    homes = places(spark, folder).withColumns(
        {"sx": first.agg(F.avg("sx")).scalar(), "sy": first.agg(F.avg("sy")).scalar()}
    )
    return within_distance_flag(homes, ("x", "y"), ("sx", "sy"), 0.2, metres=False).select("vec_id", "is_within")


def _rings(spark, folder):
    e = table(spark, folder, "embeddings")
    v = [F.col("embedding")[i].cast("double") for i in range(5)]
    wide, high, slant = F.abs(v[2]) + 0.01, F.abs(v[3]) + 0.01, F.abs(v[4]) + 0.01
    ring = F.array(
        _point(v[0], v[1]),
        _point(v[0] + wide, v[1]),
        _point(v[0] + wide, v[1] + high),
        _point(v[0], v[1] + slant),
    )
    return e.select(F.col("label").cast("bigint").alias("label"), ring.alias("ring"))


def centroids(spark, folder):
    """Dissolve the parts of each label; tell whether it lies east of the mean vertex."""
    rings = _rings(spark, folder)
    tracts = dissolve_and_centroid(rings, ["label"])
    center = vertex_mean_center(rings).select("center_x").scalar()
    sided = split_by_side(tracts, "center_x", center)
    return rounded(sided, 9, ["area", "center_x", "center_y"])


def vertex_centers(spark, folder):
    return rounded(vertex_mean_center(_rings(spark, folder), keys=["label"]), 9, ["center_x", "center_y"])


def sample_per_group(spark, folder):
    """One repeatable built-up cell for each tract."""
    cells = min_value_cells(table(spark, folder, "customer"), 3000, "c_acctbal")
    return sample_one(cells, ["c_nationkey"], "c_custkey", "home").select("c_nationkey", "c_custkey", "c_acctbal")


def cells_in_box(spark, folder):
    return raster_points(places(spark, folder), (-0.1, -0.1, 0.1, 0.05)).select("vec_id", "x", "y")


QUERIES = {
    "near_schools": near_schools,
    "near_schools_salted": near_schools_salted,
    "near_schools_by_place": near_schools_by_place,
    "schools_per_stop": stop_school_lists,
    "points_in_polygon": points_in_polygon,
    "points_outside": points_outside,
    "near_own_school": near_own_school,
    "centroids": centroids,
    "vertex_centers": vertex_centers,
    "sample_per_group": sample_per_group,
    "cells_in_box": cells_in_box,
}

_PLACES = """
WITH z AS (SELECT sqrt(count(*) / 500::DOUBLE) AS scale FROM embeddings),
     p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * scale AS x, CAST(embedding[2] AS DOUBLE) * scale AS y,
                  CAST(label AS BIGINT) AS label FROM embeddings, z),
     s AS (SELECT vec_id AS school_id, x AS sx, y AS sy FROM p WHERE label = 0)
"""
_NEAR = "(x - sx) * (x - sx) + (y - sy) * (y - sy) <= 0.05::DOUBLE * 0.05::DOUBLE"
_OUT_X = "greatest((sx - 0.05::DOUBLE) - x, 0, x - (sx + 0.05::DOUBLE))"
_OUT_Y = "greatest((sy - 0.05::DOUBLE) - y, 0, y - (sy + 0.05::DOUBLE))"
_EDGES = """
WITH e AS (SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(embedding[1] AS DOUBLE) AS x,
       CAST(embedding[2] AS DOUBLE) AS y, abs(CAST(embedding[3] AS DOUBLE)) + 0.01::DOUBLE AS w,
       abs(CAST(embedding[4] AS DOUBLE)) + 0.01::DOUBLE AS h,
       abs(CAST(embedding[5] AS DOUBLE)) + 0.01::DOUBLE AS s FROM embeddings),
edge AS (
  SELECT vec_id, label, x AS x1, y AS y1, x + w AS x2, y AS y2 FROM e
  UNION ALL SELECT vec_id, label, x + w, y, x + w, y + h FROM e
  UNION ALL SELECT vec_id, label, x + w, y + h, x, y + s FROM e
  UNION ALL SELECT vec_id, label, x, y + s, x, y FROM e)
"""

ORACLES = {
    "near_schools": f"{_PLACES} SELECT vec_id, school_id FROM p JOIN s ON {_NEAR}",
    "near_schools_salted": f"{_PLACES} SELECT vec_id, school_id FROM p LEFT JOIN s ON {_NEAR}",
    "near_schools_by_place": f"""{_PLACES} SELECT school_id, count(*) AS n, count(DISTINCT user_id) AS users
        FROM events JOIN p ON user_id = vec_id JOIN s ON {_NEAR} GROUP BY school_id""",
    "schools_per_stop": f"""{_PLACES} SELECT vec_id,
        string_agg(CAST(school_id AS VARCHAR), ',' ORDER BY school_id) AS schools
        FROM p JOIN s ON {_NEAR} GROUP BY vec_id""",
    "points_in_polygon": f"""{_PLACES} SELECT vec_id, school_id FROM p LEFT JOIN s
        ON x BETWEEN sx - 0.05::DOUBLE AND sx + 0.05::DOUBLE AND y BETWEEN sy - 0.05::DOUBLE AND sy + 0.05::DOUBLE""",
    "points_outside": f"""{_PLACES} SELECT vec_id, x, y FROM p WHERE NOT EXISTS (SELECT 1 FROM s
        WHERE {_OUT_X} * {_OUT_X} + {_OUT_Y} * {_OUT_Y} <= 0.02::DOUBLE * 0.02::DOUBLE)""",
    "near_own_school": f"""{_PLACES}, c AS (SELECT avg(sx) AS cx, avg(sy) AS cy FROM s)
        SELECT vec_id, (x - cx) * (x - cx) + (y - cy) * (y - cy) <= 0.2::DOUBLE * 0.2::DOUBLE AS is_within
        FROM p, c""",
    "centroids": f"""{_EDGES}, m AS (
          SELECT vec_id, label, sum(x1 * y2 - x2 * y1) AS a, sum((x1 + x2) * (x1 * y2 - x2 * y1)) AS mx,
                 sum((y1 + y2) * (x1 * y2 - x2 * y1)) AS my FROM edge GROUP BY vec_id, label),
        t AS (SELECT label, sum(a) / 2 AS area, sum(mx) / (3 * sum(a)) AS cx, sum(my) / (3 * sum(a)) AS cy
              FROM m GROUP BY label),
        c AS (SELECT avg(x1) AS vx FROM edge)
        SELECT label, round(area, 9) AS area, round(cx, 9) AS center_x, round(cy, 9) AS center_y,
               CASE WHEN cx > vx THEN 'east' ELSE 'west' END AS side FROM t, c""",
    "vertex_centers": f"""{_EDGES} SELECT label, round(avg(x1), 9) AS center_x, round(avg(y1), 9) AS center_y
        FROM edge GROUP BY label""",
    "sample_per_group": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey
          ORDER BY md5('home|' || CAST(c_custkey AS VARCHAR)), c_custkey) AS rn FROM customer WHERE c_acctbal > 3000)
        SELECT c_nationkey, c_custkey, c_acctbal FROM r WHERE rn = 1""",
    "cells_in_box": f"""{_PLACES} SELECT vec_id, x, y FROM p
        WHERE x BETWEEN -0.1::DOUBLE AND 0.1::DOUBLE AND y BETWEEN -0.1::DOUBLE AND 0.05::DOUBLE""",
}
