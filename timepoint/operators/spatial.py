"""Spatial joins as equi joins on grid cells with an exact test on top.

A point lies in exactly one cell.  Targets and polygons are listed in every
cell they could reach, so each pair meets once and nothing is compared with
everything.  The points are never multiplied; the smaller side is.  A crowded
cell is split by adaptive skew handling, or by ``salts`` where a plan must not
depend on it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timepoint.functions.geo import (
    METRES_PER_DEGREE,
    bounds,
    cell,
    cell_range,
    haversine_metres,
    inside,
    near_boundary,
    planar_sq,
    polygon_edges,
    ring_moments,
    side_of,
    sphere_axes,
)


def _with_salt(points: DataFrame, targets: DataFrame, salts: int, spread: Sequence[str]):
    """Points spread over ``salts`` copies of the targets."""
    if salts <= 1:
        return points, targets, None
    salted = points.withColumn("_sj_ps", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    return salted, targets.withColumn("_sj_ts", copies), F.col("_sj_ps") == F.col("_sj_ts")


def _finish(joined: DataFrame) -> DataFrame:
    return joined.drop(*[c for c in joined.columns if c.startswith("_sj_")])


def within_distance_join(
    points: DataFrame,
    targets: DataFrame,
    radius: float,
    point_xy: tuple[str, str],
    target_xy: tuple[str, str],
    how: str = "inner",
    metres: bool = False,
    salts: int = 1,
) -> DataFrame:
    """Pairs at most ``radius`` apart (bound included).

    With ``metres`` the coordinates are lon and lat and the distance is the
    great-circle one; the cells are then cubes around the globe, so no latitude
    is special.  The target coordinates do not come out.
    """
    p = [F.col(c) for c in point_xy]
    t = [F.col("_sj_tx"), F.col("_sj_ty")]
    near = targets.withColumnsRenamed({target_xy[0]: "_sj_tx", target_xy[1]: "_sj_ty"})
    axes = list(zip(sphere_axes(*p), sphere_axes(*t))) if metres else list(zip(p, t))
    placed, cond = points, None
    for i, (a, b) in enumerate(axes):
        # Wider than the radius by what rounding can take from a difference of the two, so that no cell is skipped:
        # where the test passes, a lies between b - reach and b + reach, and cells never fall as values rise.
        reach = F.lit(radius * (1 + 1e-9) + 1e-6) if metres else (F.abs(b) + radius) * 1e-14 + radius
        placed = placed.withColumn(f"_sj_p{i}", cell(a, radius))
        near = near.withColumn(f"_sj_t{i}", F.explode(cell_range(b - reach, b + reach, radius)))
        same = F.col(f"_sj_p{i}") == F.col(f"_sj_t{i}")
        cond = same if cond is None else cond & same
    placed, near, salt = _with_salt(placed, near, salts, points.columns)
    close = haversine_metres(*p, *t) <= radius if metres else planar_sq(*p, *t) <= radius * radius
    cond = cond & close
    return _finish(placed.join(near, cond if salt is None else cond & salt, how))


def within_distance_by_place(
    points: DataFrame,
    targets: DataFrame,
    radius: float,
    point_xy: tuple[str, str],
    target_xy: tuple[str, str],
    **options,
) -> DataFrame:
    """The same inner join with the test done once for each distinct place.

    Many reports come from the same spot (a depot, a stop).
    """
    places = points.select(*point_xy).distinct()
    hits = within_distance_join(places, targets, radius, point_xy, target_xy, "inner", **options)
    return points.join(hits, list(point_xy), "inner")


def _polygon_cells(polygons: DataFrame, ring: str, holes: str | None, size: float, pad: float, metres: bool):
    b = bounds(F.col(ring))
    pad_x = pad_y = F.lit(float(pad))
    if metres and pad:
        pad_y = pad_y / METRES_PER_DEGREE
        # A degree of longitude is shortest at the latitude farthest from the equator.
        far = F.least(F.greatest(F.abs(b["min_y"]), F.abs(b["max_y"])) + pad_y, F.lit(89.9))
        pad_x = pad_y / F.cos(F.radians(far))
    box = {
        "_sj_min_x": b["min_x"] - pad_x,
        "_sj_max_x": b["max_x"] + pad_x,
        "_sj_min_y": b["min_y"] - pad_y,
        "_sj_max_y": b["max_y"] + pad_y,
    }
    edges = polygon_edges(F.col(ring), F.col(holes) if holes else None)
    shaped = polygons.withColumns({"_sj_edges": edges, **box}).drop(*[c for c in (ring, holes) if c])
    cells_x = cell_range(F.col("_sj_min_x"), F.col("_sj_max_x"), size)
    cells_y = cell_range(F.col("_sj_min_y"), F.col("_sj_max_y"), size)
    banded = shaped.withColumn("_sj_t1", F.explode(cells_y))
    # A row of cells needs the edges in its band only: the ray of the inside test runs along the row, and an edge
    # within the pad of a point overlaps the band widened by the pad.
    reach = F.abs(F.col("_sj_t1")) * (size * 1e-12) + (pad_y + size * 1e-9)
    low, high = F.col("_sj_t1") * size - reach, (F.col("_sj_t1") + 1) * size + reach
    clipped = F.filter("_sj_edges", lambda e: (F.greatest(e["y1"], e["y2"]) >= low) & (F.least(e["y1"], e["y2"]) <= high))
    return banded.withColumn("_sj_edges", clipped).withColumn("_sj_t0", F.explode(cells_x))


def _polygon_join(points, polygons, xy, ring, holes, size, pad, metres, how, salts) -> DataFrame:
    x, y = (F.col(c) for c in xy)
    cells = _polygon_cells(polygons, ring, holes, size, pad, metres)
    placed = points.withColumns({"_sj_p0": cell(x, size), "_sj_p1": cell(y, size)})
    placed, cells, salt = _with_salt(placed, cells, salts, points.columns)
    edges = F.col("_sj_edges")
    hit = inside(x, y, edges)
    if pad:
        hit = hit | near_boundary(x, y, edges, pad, metres)
    box = x.between(F.col("_sj_min_x"), F.col("_sj_max_x")) & y.between(F.col("_sj_min_y"), F.col("_sj_max_y"))
    cond = (F.col("_sj_p0") == F.col("_sj_t0")) & (F.col("_sj_p1") == F.col("_sj_t1")) & box & hit
    return _finish(placed.join(cells, cond if salt is None else cond & salt, how))


def point_in_polygon_join(
    points: DataFrame,
    polygons: DataFrame,
    xy: tuple[str, str],
    cell_size: float,
    ring: str = "ring",
    holes: str | None = None,
    how: str = "left",
    pad: float = 0.0,
    metres: bool = False,
    salts: int = 1,
) -> DataFrame:
    """Points with the polygons they fall in, or within ``pad`` of.

    ``cell_size`` (in the unit of the coordinates) about the size of a usual
    polygon keeps both the cells of one polygon and the polygons of one cell
    few.  With ``metres`` the coordinates are lon and lat and ``pad`` is metres.
    """
    return _polygon_join(points, polygons, xy, ring, holes, cell_size, pad, metres, how, salts)


def spatial_anti_join(
    points: DataFrame,
    polygons: DataFrame,
    xy: tuple[str, str],
    cell_size: float,
    pad: float = 0.0,
    ring: str = "ring",
    holes: str | None = None,
    metres: bool = False,
    salts: int = 1,
) -> DataFrame:
    """Points in none of the polygons, nor within ``pad`` of one."""
    return _polygon_join(points, polygons, xy, ring, holes, cell_size, pad, metres, "left_anti", salts)


def within_distance_flag(
    df: DataFrame, xy: tuple[str, str], other: tuple[str, str], radius: float, out: str = "is_within",
    metres: bool = True,
) -> DataFrame:
    """Is the home point within ``radius`` of its own school; same row, no join."""
    a, b = [F.col(c) for c in xy], [F.col(c) for c in other]
    test = haversine_metres(*a, *b) <= radius if metres else planar_sq(*a, *b) <= radius * radius
    return df.withColumn(out, test)


def near_polygon_flag(
    df: DataFrame, xy: tuple[str, str], ring: str, radius: float, out: str = "is_within", metres: bool = False
) -> DataFrame:
    """The same against the school's polygon."""
    x, y, edges = F.col(xy[0]), F.col(xy[1]), polygon_edges(F.col(ring))
    return df.withColumn(out, inside(x, y, edges) | near_boundary(x, y, edges, radius, metres))


def dissolve_and_centroid(parts: DataFrame, keys: Sequence[str], ring: str = "ring") -> DataFrame:
    """Area and centroid of disjoint parts together, by sums over the parts."""
    m = parts.select(*keys, ring_moments(F.col(ring)).alias("m"))
    # The sign of the area is the drawing direction; it cancels out of the moments.
    sign = F.signum("m.area2")
    sums = m.groupBy(*keys).agg(
        F.sum(F.abs("m.area2")).alias("_a"),
        F.sum(sign * F.col("m.mx")).alias("_mx"),
        F.sum(sign * F.col("m.my")).alias("_my"),
    )
    return sums.select(
        *keys,
        (F.col("_a") / 2).alias("area"),
        F.try_divide(F.col("_mx"), F.col("_a") * 3).alias("center_x"),
        F.try_divide(F.col("_my"), F.col("_a") * 3).alias("center_y"),
    )


def vertex_mean_center(parts: DataFrame, ring: str = "ring", keys: Sequence[str] = ()) -> DataFrame:
    """Plain mean of all vertices."""
    v = parts.select(*keys, F.explode(ring).alias("p"))
    return v.groupBy(*keys).agg(F.avg("p.x").alias("center_x"), F.avg("p.y").alias("center_y"))


def split_by_side(df: DataFrame, lon: str, center: Column, out: str = "side") -> DataFrame:
    return df.withColumn(out, side_of(F.col(lon), center))
