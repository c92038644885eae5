import math

import pytest
from hypothesis import HealthCheck, example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from timepoint.functions.geo import haversine_metres, inside, near_boundary, polygon_edges
from timepoint.operators.arrivals import schools_per_stop
from timepoint.operators.spatial import (
    dissolve_and_centroid,
    near_polygon_flag,
    point_in_polygon_join,
    spatial_anti_join,
    split_by_side,
    vertex_mean_center,
    within_distance_by_place,
    within_distance_flag,
    within_distance_join,
)

RING = "ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>"
SQUARE = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
SLOW = settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))


def polygons(spark, rows):
    return spark.createDataFrame(rows, f"pid INT, ring {RING}")


def points(spark, rows):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rows)], "id INT, x DOUBLE, y DOUBLE")


def test_square(spark):
    pts = points(spark, [(1, 1), (3, 1), (2, 1), (2, 2), (2.5, 0.5)])
    got = point_in_polygon_join(pts, polygons(spark, [(7, SQUARE)]), ("x", "y"), 1.5)
    assert {r.id: r.pid for r in got.collect()} == {0: 7, 1: None, 2: 7, 3: 7, 4: None}
    closed = polygons(spark, [(7, [*SQUARE, SQUARE[0]])])
    assert point_in_polygon_join(pts, closed, ("x", "y"), 9, how="inner").count() == 3
    out = spatial_anti_join(pts, polygons(spark, [(7, SQUARE)]), ("x", "y"), 1, pad=0.5)
    assert [r.id for r in out.collect()] == [1]


def test_hole(spark):
    df = spark.createDataFrame(
        [(1, [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)], [[(3.0, 3.0), (6.0, 3.0), (6.0, 6.0), (3.0, 6.0)]])],
        f"pid INT, ring {RING}, holes ARRAY<{RING}>",
    )
    pts = points(spark, [(1, 1), (4, 4), (6, 4)])
    got = point_in_polygon_join(pts, df, ("x", "y"), 4, holes="holes", how="inner", salts=3)
    assert sorted(r.id for r in got.collect()) == [0, 2]


def test_centroids(spark):
    parts = polygons(spark, [(1, SQUARE), (1, [(5.5, 0.5), (5.5, 1.5), (6.5, 1.5), (6.5, 0.5)]), (2, SQUARE)])
    got = {r.pid: (r.area, r.center_x, r.center_y) for r in dissolve_and_centroid(parts, ["pid"]).collect()}
    assert got == {1: (5.0, 2.0, 1.0), 2: (4.0, 1.0, 1.0)}
    assert tuple(vertex_mean_center(polygons(spark, [(1, SQUARE)])).first()) == (1.0, 1.0)
    sides = split_by_side(spark.createDataFrame([(1.0,), (1.5,)], "lon DOUBLE"), "lon", F.lit(1.0))
    assert [r.side for r in sides.collect()] == ["west", "east"]


def test_radius_bound_and_diagonal_cells(spark):
    pts = points(spark, [(1, 0), (1.0001, 0), (-0.7, -0.7), (0.999, 0)])
    target = spark.createDataFrame([("s", 0.0, 0.0)], "school STRING, tx DOUBLE, ty DOUBLE")
    got = within_distance_join(pts, target, 1.0, ("x", "y"), ("tx", "ty"))
    assert sorted(r.id for r in got.collect()) == [0, 2, 3]
    assert set(got.columns) == {"id", "x", "y", "school"}


coords = st.lists(st.tuples(st.floats(-3, 3), st.floats(-3, 3)), min_size=1, max_size=25)


@given(a=coords, b=coords, radius=st.sampled_from([0.1, 0.7, 2.0]), salts=st.sampled_from([1, 3]))
@example(a=[(0.0, 2.0)], b=[(0.0, -2.4085436815657093e-203)], radius=2.0, salts=1)
@example(a=[(1e9 + 0.7, 3e12)], b=[(1e9, 3e12 - 0.7)], radius=0.7, salts=1)
@example(a=[(123456789.1, 0.0)], b=[(123456789.0, 0.0)], radius=0.1, salts=1)
@SLOW
def test_distance_join_equals_all_pairs(spark, a, b, radius, salts):
    pts = points(spark, a)
    targets = points(spark, b).toDF("tid", "tx", "ty")
    want = sorted(
        (i, j) for i, (x, y) in enumerate(a) for j, (u, v) in enumerate(b)
        if (x - u) * (x - u) + (y - v) * (y - v) <= radius * radius
    )
    got = within_distance_join(pts, targets, radius, ("x", "y"), ("tx", "ty"), salts=salts)
    assert sorted((r.id, r.tid) for r in got.collect()) == want
    once = within_distance_by_place(pts, targets, radius, ("x", "y"), ("tx", "ty"))
    assert sorted((r.id, r.tid) for r in once.collect()) == want
    left = within_distance_join(pts, targets, radius, ("x", "y"), ("tx", "ty"), how="left", salts=salts)
    assert left.select("id").distinct().count() == len(a)


def metres(lon1, lat1, lon2, lat2):
    r = 6_371_008.8
    p1, p2 = math.radians(lat1), math.radians(lat2)
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * r * math.asin(math.sqrt(h))


places = st.lists(st.tuples(st.floats(-76.65, -76.6), st.floats(39.25, 39.3)), min_size=1, max_size=20)


@given(a=places, b=places)
@SLOW
def test_metre_join_equals_all_pairs(spark, a, b):
    pts, targets = points(spark, a), points(spark, b).toDF("tid", "tx", "ty")
    got = within_distance_join(pts, targets, 804.672, ("x", "y"), ("tx", "ty"), metres=True)
    want = sorted((i, j) for i, p in enumerate(a) for j, q in enumerate(b) if metres(*p, *q) <= 804.672)
    assert sorted((r.id, r.tid) for r in got.collect()) == want


def test_metre_join_at_the_edges_of_the_map(spark):
    a = [(179.999, 0.0), (10.0, 89.999), (0.0, -89.9999)]
    b = [(-179.999, 0.0), (-170.0, 89.999), (90.0, -89.9999)]
    got = within_distance_join(points(spark, a), points(spark, b).toDF("tid", "tx", "ty"), 300.0, ("x", "y"),
                               ("tx", "ty"), metres=True)
    assert sorted((r.id, r.tid) for r in got.collect()) == [(0, 0), (1, 1), (2, 2)]


def test_pad_in_metres(spark):
    lat, lon, d = 39.3, -76.6, 0.001
    ring = [(lon, lat), (lon + d, lat), (lon + d, lat + d), (lon, lat + d)]
    east = 1 / (111_195.08 * math.cos(math.radians(lat)))
    pts = points(spark, [(lon - 49 * east, lat + d / 2), (lon - 51 * east, lat + d / 2), (lon, lat - 49 / 111_195.08)])
    hit = point_in_polygon_join(pts, polygons(spark, [(1, ring)]), ("x", "y"), 0.01, how="inner", pad=50, metres=True)
    assert sorted(r.id for r in hit.collect()) == [0, 2]
    out = spatial_anti_join(pts, polygons(spark, [(1, ring)]), ("x", "y"), 0.01, pad=50, metres=True)
    assert [r.id for r in out.collect()] == [1]


def test_haversine(spark):
    df = spark.range(1).select(haversine_metres(F.lit(-76.6), F.lit(39.3), F.lit(-76.61), F.lit(39.31)))
    assert df.first()[0] == pytest.approx(metres(-76.6, 39.3, -76.61, 39.31))


def contains(ring, x, y):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
        turn = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
        if turn == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
            return True
    return odd


grid = st.tuples(st.integers(-6, 6), st.integers(-6, 6))


@given(rings=st.lists(st.lists(grid, min_size=3, max_size=7), min_size=1, max_size=4),
       pts=st.lists(grid, min_size=1, max_size=20), cell=st.sampled_from([1, 2.5, 20]))
@SLOW
def test_polygon_join_equals_all_pairs(spark, rings, pts, cell):
    rings = [[(float(x), float(y)) for x, y in r] for r in rings]
    df = point_in_polygon_join(points(spark, pts), polygons(spark, list(enumerate(rings))), ("x", "y"), cell, how="inner")
    want = sorted((i, j) for i, (x, y) in enumerate(pts) for j, r in enumerate(rings) if contains(r, x, y))
    assert sorted((r.id, r.pid) for r in df.collect()) == want


def test_flags_of_one_row(spark):
    df = polygons(spark, [(1, SQUARE)]).selectExpr("*", "2.5D AS x", "1D AS y", "1D AS u", "1D AS v")
    near = near_polygon_flag(df, ("x", "y"), "ring", 0.5).first().is_within
    far = near_polygon_flag(df, ("x", "y"), "ring", 0.49).first().is_within
    assert (near, far) == (True, False)
    assert within_distance_flag(df, ("x", "y"), ("u", "v"), 1.5, metres=False).first().is_within
    edges = polygon_edges(F.col("ring"))
    got = df.select(inside(F.col("x"), F.col("y"), edges), near_boundary(F.col("x"), F.col("y"), edges, 0.5)).first()
    assert tuple(got) == (False, True)


def test_schools_of_a_stop(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (2, "c")], "stop INT, school STRING")
    assert {r.stop: r.schools for r in schools_per_stop(df, "stop", "school").collect()} == {1: ["a", "b"], 2: ["c"]}


def test_spatial_plans_compare_cells_not_everything(spark):
    pts = spark.range(1000).selectExpr("id", "CAST(id AS DOUBLE) AS x", "CAST(id AS DOUBLE) AS y")
    targets = spark.range(1000).selectExpr("id AS tid", "CAST(id AS DOUBLE) AS tx", "CAST(id AS DOUBLE) AS ty")
    rings = targets.select("tid", F.expr("array(struct(tx AS x, ty AS y), struct(tx + 1 AS x, ty AS y), struct(tx AS x, ty + 1 AS y))").alias("ring"))
    for df in (
        within_distance_join(pts, targets, 2.0, ("x", "y"), ("tx", "ty"), "left"),
        point_in_polygon_join(pts, rings, ("x", "y"), 1.0),
        spatial_anti_join(pts, rings, ("x", "y"), 1.0, 0.1),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
