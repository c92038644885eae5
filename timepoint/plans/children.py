"""Where children live in two census years, by side of the city and community area."""

from __future__ import annotations

from pyspark.sql import DataFrame

from timepoint.operators.joins import attach_area
from timepoint.operators.people import children_by_group, children_by_tract, share_change
from timepoint.operators.spatial import dissolve_and_centroid, split_by_side, vertex_mean_center


def located_tracts(acs: DataFrame, shapes: DataFrame, center_shapes: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Tracts with their children, centroid, side of the city and area.

    ``shapes``: geoid, ring.  The city centre is the mean vertex of ``center_shapes``.
    """
    center = vertex_mean_center(center_shapes).select("center_x").scalar()
    # The crosswalk brings the community area; the surface is not needed.
    placed = dissolve_and_centroid(shapes, ["geoid"]).drop("area")
    tracts = placed.join(children_by_tract(acs), "geoid", "left")
    return attach_area(split_by_side(tracts, "center_x", center), crosswalk, "geoid")


def children_reports(old: DataFrame, new: DataFrame, old_tag: str = "2010", new_tag: str = "2023"):
    """Both years by side and by area, and the change by area."""
    out = {}
    for tag, tracts in ((old_tag, old), (new_tag, new)):
        out[f"side_{tag}"] = children_by_group(tracts, "side")
        out[f"area_{tag}"] = children_by_group(tracts, "area")
    out["change"] = share_change(out[f"area_{new_tag}"], out[f"area_{old_tag}"], "area", new_tag, old_tag)
    return out
