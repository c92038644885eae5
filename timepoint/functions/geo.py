"""Points, rings and grid cells as plain columns.

A point is two DOUBLE columns, a ring an ARRAY<STRUCT<x, y>> (closed or not),
and the edges of a polygon an ARRAY<STRUCT<x1, y1, x2, y2>>.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_METRES = 6_371_008.8
METRES_PER_DEGREE = math.pi * EARTH_METRES / 180
# Distances of the analysis, in metres.
HALF_MILE = 804.672
NEAR_SCHOOL = 2414.01
PARK_PAD, SCHOOL_PAD, AREA_PAD = 50.0, 100.0, 3000.0


def planar_sq(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Squared distance; compare it with a squared radius."""
    dx, dy = x1 - x2, y1 - y2
    return dx * dx + dy * dy


def haversine_metres(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_METRES) * F.asin(F.least(F.sqrt(h), F.lit(1.0)))


def sphere_axes(lon: Column, lat: Column) -> list[Column]:
    """The point on the globe as three coordinates in metres.

    Two points at most r apart on the ground are at most r apart on each axis,
    at any latitude and across the date line.
    """
    x, y = F.radians(lon), F.radians(lat)
    r = F.lit(EARTH_METRES)
    return [r * F.cos(y) * F.cos(x), r * F.cos(y) * F.sin(x), r * F.sin(y)]


def cell(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(size)).cast("bigint")


def cell_range(low: Column, high: Column, size: float) -> Column:
    return F.sequence(cell(low, size), cell(high, size))


def ring_edges(ring: Column) -> Column:
    """Edges of one ring; a ring that does not end where it began is closed."""
    shifted = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(
        ring,
        shifted,
        lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")),
    )


def polygon_edges(ring: Column, holes: Column | None = None) -> Column:
    """Edges of the outer ring and the holes together; the even-odd rule tells them apart."""
    if holes is None:
        return ring_edges(ring)
    return F.concat(ring_edges(ring), F.flatten(F.transform(holes, ring_edges)))


def bounds(ring: Column) -> dict[str, Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return {
        "min_x": F.array_min(xs),
        "max_x": F.array_max(xs),
        "min_y": F.array_min(ys),
        "max_y": F.array_max(ys),
    }


def on_boundary(x: Column, y: Column, edges: Column) -> Column:
    def touches(e):
        turn = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        in_x = x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        in_y = y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
        return (turn == 0) & in_x & in_y

    return F.exists(edges, touches)


def inside(x: Column, y: Column, edges: Column) -> Column:
    """Even-odd rule; a point on the boundary is inside."""

    def crosses(e):
        spans = (e["y1"] > y) != (e["y2"] > y)
        meets = (e["x2"] - e["x1"]) * F.try_divide(y - e["y1"], e["y2"] - e["y1"]) + e["x1"]
        return spans & (x < meets)

    odd = F.size(F.filter(edges, crosses)) % 2 == 1
    return odd | on_boundary(x, y, edges)


def near_boundary(x: Column, y: Column, edges: Column, radius: float, metres: bool = False) -> Column:
    """Is any edge within ``radius``.

    With ``metres`` the coordinates are lon and lat, and distances are taken on
    the plane that touches the globe at the point, which is exact enough for
    the few kilometres a pad has.
    """
    ky = F.lit(METRES_PER_DEGREE) if metres else F.lit(1.0)
    kx = ky * F.cos(F.radians(y)) if metres else ky

    def close(e):
        # The edge as seen from the point, in the unit of the radius.
        ax, ay = (e["x1"] - x) * kx, (e["y1"] - y) * ky
        dx, dy = (e["x2"] - e["x1"]) * kx, (e["y2"] - e["y1"]) * ky
        along = F.try_divide(-(ax * dx + ay * dy), dx * dx + dy * dy)
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0))))
        nx, ny = ax + t * dx, ay + t * dy
        return nx * nx + ny * ny <= radius * radius

    return F.exists(edges, close)


def ring_moments(ring: Column) -> Column:
    """STRUCT<area2, mx, my>: twice the signed area and the first moments times six."""

    def add(acc, e):
        cross = e["x1"] * e["y2"] - e["x2"] * e["y1"]
        return F.struct(
            (acc["area2"] + cross).alias("area2"),
            (acc["mx"] + (e["x1"] + e["x2"]) * cross).alias("mx"),
            (acc["my"] + (e["y1"] + e["y2"]) * cross).alias("my"),
        )

    zero = F.struct(F.lit(0.0).alias("area2"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))
    return F.aggregate(ring_edges(ring), zero, add)


def side_of(lon: Column, center_lon: Column) -> Column:
    return F.when(lon > center_lon, "east").otherwise("west")
