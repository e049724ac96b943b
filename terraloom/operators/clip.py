"""Pixels within areas, as a spatial join on the cells of the areas' cover.

A pixel lies in one cell of each level and the cells of an area don't overlap, so no pair of pixel and area comes twice. Pixels of
whole cells need no test; those of cells on the outline are tested against the cell's own edges, from its reference point.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.functions.geometry import edges_meet_box, point_inside_from
from terraloom.operators.cover import CELL, Cover, cover, keyed, reference


def clip(pixels: DataFrame, aois: DataFrame, rule: str = "center", pixel: float | None = None, cell: float = CELL, cells: Cover | None = None) -> DataFrame:
    """Pixels (lon, lat of their centres) of each area, plus aoi_id.

    rule "center" keeps a pixel whose centre lies in the area; "touched" keeps one whose square, of side pixel, meets the area.
    cells is a cover that was made before, with a margin of half a pixel for "touched"; areas outside it aren't met.
    """
    half = pixel / 2 if rule == "touched" else 0.0
    if cells is None:
        cells = cover(aois, cell, half)
    elif cells.margin < half:
        raise ValueError(f"the cover's margin {cells.margin} is below half a pixel {half}")
    dealt = keyed(pixels, cells.cell, cells.levels)
    joined = dealt.join(cells.cells, ["level", "cell_x", "cell_y"])
    lon, lat, edges = F.col("lon"), F.col("lat"), F.col("edges")
    inside = point_inside_from(edges, lon, lat, reference(F.col("__x"), cells.cell, 0), reference(F.col("__y"), cells.cell, 1), F.col("from_inside"))
    if rule == "touched":
        inside = inside | edges_meet_box(edges, lon - half, lat - half, lon + half, lat + half)
    return joined.where(F.col("whole") | inside).select("aoi_id", *pixels.columns)
