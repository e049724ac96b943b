"""Column expressions over rings, boxes and edges (longitude first, degrees)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kilometres and metres in a degree, the same in both axes.
KM_PER_DEGREE, M_PER_DEGREE = 111.32, 111320.0


def ring_box(ring: Column) -> Column:
    """The box of a ring of points: minx, miny, maxx, maxy."""
    xs, ys = F.transform(ring, lambda p: p[0]), F.transform(ring, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def envelope(box: Column) -> Column:
    """The same box as north, south, east, west."""
    return F.struct(box["maxy"].alias("north"), box["miny"].alias("south"), box["maxx"].alias("east"), box["minx"].alias("west"))


def box_ring(north: Column, south: Column, east: Column, west: Column) -> Column:
    """A closed ring from the south-west corner on, counter-clockwise."""
    corner = lambda x, y: F.array(x, y)
    return F.array(F.array(corner(west, south), corner(east, south), corner(east, north), corner(west, north), corner(west, south)))


def box_area_km2(box: Column) -> Column:
    return ((box["maxx"] - box["minx"]) * F.lit(KM_PER_DEGREE)) * ((box["maxy"] - box["miny"]) * F.lit(KM_PER_DEGREE))


def boxes_meet(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return (a["minx"] <= b["maxx"]) & (a["maxx"] >= b["minx"]) & (a["miny"] <= b["maxy"]) & (a["maxy"] >= b["miny"])


def ring_edges(rings: Column) -> Column:
    """All edges of all rings, as (x1, y1, x2, y2). A ring that ends elsewhere than it starts is closed by one more."""

    def edges(ring: Column) -> Column:
        def edge(i: Column) -> Column:
            a, b = F.get(ring, i), F.get(ring, F.when(i + 1 < F.size(ring), i + 1).otherwise(0))
            return F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2"))

        open_ = F.when(F.get(ring, F.lit(0)) == F.get(ring, F.size(ring) - 1), 2).otherwise(1)
        return F.transform(F.sequence(F.lit(0), F.size(ring) - open_), edge)

    usable = F.filter(rings, lambda r: F.size(r) >= 2)
    return F.flatten(F.transform(usable, edges))


def point_inside(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd rule over the edges of all rings, so holes count as outside."""

    def crossed(e: Column) -> Column:
        spans = (e["y1"] > y) != (e["y2"] > y)
        return spans & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"])

    return F.size(F.filter(edges, crossed)) % 2 == 1


def _crossing(e: Column, y: Column) -> tuple[Column, Column]:
    """Whether an edge spans a height, and where it crosses it."""
    spans = (e["y1"] > y) != (e["y2"] > y)
    return spans, (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]


def point_inside_from(edges: Column, x: Column, y: Column, from_x: Column, from_y: Column, from_inside: Column) -> Column:
    """point_inside(x, y), from the answer at another point and the edges near the two lines from there to (from_x, y) to (x, y).

    Along the first line the number of edges above that cross x = from_x changes, along the second the number of
    crossings to the right; an edge that meets neither line changes nothing. Both counts use the same comparisons as
    point_inside does, so that rounding can't make the two disagree; rings must be closed.
    """

    def above(e: Column, height: Column) -> Column:
        """Whether the edge crosses x = from_x above the height."""
        spans, at = _crossing(e, height)
        up1, up2 = e["y1"] > height, e["y2"] > height
        side1, side2 = e["x1"] > from_x, e["x2"] > from_x
        return F.when(spans, (from_x < at) != F.when(up1, side1).otherwise(side2)).otherwise(up1 & up2 & (side1 != side2))

    def changes(e: Column) -> Column:
        spans, at = _crossing(e, y)
        return (above(e, y) != above(e, from_y)) != (spans & F.coalesce((x < at) != (from_x < at), F.lit(False)))

    return from_inside != (F.size(F.filter(edges, changes)) % 2 == 1)


def edge_meets_box(e: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Whether a segment meets a closed box: the parts of the segment within the box in x and in y must overlap."""

    def part(start: Column, end: Column, low: Column, high: Column) -> tuple[Column, Column]:
        length = F.nullif(end - start, F.lit(0.0))
        within = (low <= start) & (start <= high)
        a, b = (low - start) / length, (high - start) / length
        return F.coalesce(F.least(a, b), F.when(within, 0.0).otherwise(2.0)), F.coalesce(F.greatest(a, b), F.when(within, 1.0).otherwise(-1.0))

    (x0, x1), (y0, y1) = part(e["x1"], e["x2"], minx, maxx), part(e["y1"], e["y2"], miny, maxy)
    return F.greatest(F.lit(0.0), x0, y0) <= F.least(F.lit(1.0), x1, y1)


def edges_meet_box(edges: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    return F.exists(edges, lambda e: edge_meets_box(e, minx, miny, maxx, maxy))
