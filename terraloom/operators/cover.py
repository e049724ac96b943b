"""Areas as cells of a quadtree: coarse cells where the area is whole, the finest only along its outline.

The finest cells have the side `cell`; every level above is FAN times as wide (FAN = 4, two steps of a quadtree at once). An
edge is dealt to the finest cells that it meets, so that a cell on the outline holds its own edges only, and with them whether
a reference point of the cell lies inside. A larger cell is kept whole where no edge meets it, as large as it can be. The
number of cells grows with the outline, not with the surface. A point lies in one finest cell and in one cell of each
level above, so it finds its cells by as many keys as there are levels in use.

Everything is keyed by area and cell, so the edges of one large area are spread over many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.sources.staging import stage

#: Degrees of the finest cells.
CELL = 0.05
FAN = 4
#: Levels above the finest: with cells of 0.05 degrees the widest have 51.2.
LEVELS = 5
#: The reference point of a cell, as a share of its side; off the lines on which coordinates tend to lie.
REFERENCE = (0.41421356, 0.61803399)


@dataclass(frozen=True)
class Cover:
    """The cells of areas (aoi_id, level, cell_x, cell_y, whole, edges, from_inside), their finest side, and the levels in use."""

    cells: DataFrame
    cell: float
    margin: float
    levels: tuple[int, ...]


def side(cell: float, level: int) -> float:
    return cell * FAN**level


def _at(value: Column, cell: float) -> Column:
    return F.floor(value / F.lit(cell))


def _edges(aois: DataFrame, cell: float) -> DataFrame:
    """aoi_id, height, edge: a row for each edge, and how many levels the tree of its area has above the finest."""
    box = F.col("box")
    span = F.greatest(box["maxx"] - box["minx"], box["maxy"] - box["miny"])
    # A cell as wide as the area itself can't be whole, so the tree of an area ends there.
    levels = F.ceil(F.log(float(FAN), F.greatest(span / F.lit(cell), F.lit(1.0))) - F.lit(1e-9))
    return aois.where(box.isNotNull()).select("aoi_id", F.least(F.lit(LEVELS), F.greatest(F.lit(0), levels)).cast("int").alias("height"), F.explode("edges").alias("edge"))


def outline_cells(edges: DataFrame, cell: float, margin: float) -> DataFrame:
    """aoi_id, cell_x, cell_y, edges, height: the finest cells that an edge meets or comes as near as the margin to."""
    slack = margin + cell * 1e-6  # rounding can't leave an edge out
    e = lambda k: F.col(f"edge.{k}")
    low_x, high_x = F.least(e("x1"), e("x2")), F.greatest(e("x1"), e("x2"))
    low_y, high_y = F.least(e("y1"), e("y2")), F.greatest(e("y1"), e("y2"))
    columns = edges.withColumn("cell_x", F.explode(F.sequence(_at(low_x - slack, cell), _at(high_x + slack, cell))))
    # The heights that the edge passes within the widened column; a steep edge passes all of its own.
    west, east = F.col("cell_x") * F.lit(cell) - slack, (F.col("cell_x") + 1) * F.lit(cell) + slack
    run = F.nullif(e("x2") - e("x1"), F.lit(0.0))
    height = lambda x: e("y1") + (e("y2") - e("y1")) * ((x - e("x1")) / run)
    a, b = height(F.greatest(west, low_x)), height(F.least(east, high_x))
    flat = (e("x2") - e("x1") == 0) | (F.abs(e("x2") - e("x1")) < F.abs(e("y2") - e("y1")) * 1e-9)
    bottom = F.when(flat, low_y).otherwise(F.greatest(low_y, F.least(a, b)))
    top = F.when(flat, high_y).otherwise(F.least(high_y, F.greatest(a, b)))
    dealt = columns.withColumn("cell_y", F.explode(F.sequence(_at(F.least(bottom, top) - slack, cell), _at(F.greatest(bottom, top) + slack, cell))))
    return dealt.groupBy("aoi_id", "cell_x", "cell_y").agg(F.collect_list("edge").alias("edges"), F.max("height").alias("height"))


def _crossings(edges: DataFrame, cell: float) -> DataFrame:
    """aoi_id, row, x: where edges cross the reference height of each row of finest cells."""
    e = lambda k: F.col(f"edge.{k}")
    rows = F.sequence(_at(F.least(e("y1"), e("y2")), cell) - 1, _at(F.greatest(e("y1"), e("y2")), cell) + 1)
    dealt = edges.withColumn("row", F.explode(rows))
    y = reference(F.col("row"), cell, 1)
    spans = (e("y1") > y) != (e("y2") > y)
    x = (e("x2") - e("x1")) * (y - e("y1")) / F.nullif(e("y2") - e("y1"), F.lit(0.0)) + e("x1")
    return dealt.where(spans).select("aoi_id", "row", x.alias("x"))


def reference(number: Column, cell: float, axis: int) -> Column:
    """A coordinate of the reference point of the finest cells of a column (axis 0) or row (axis 1)."""
    return (number + F.lit(REFERENCE[axis])) * F.lit(cell)


def cover(aois: DataFrame, cell: float = CELL, margin: float = 0.0, staged: bool = False) -> Cover:
    """The cells of aois (aoi_id, edges, box). Whole cells are farther from the outline than the margin.

    staged writes the cells to the shared folder, for a cover that several joins use.
    """
    edges = stage(_edges(aois, cell))
    top = edges.agg(F.max("height")).first()[0] or 0
    outline = outline_cells(edges, cell, margin)
    # Whether each cell's reference point is inside: the crossings to its right in its row. One at the point itself isn't to its right.
    own = outline.select("aoi_id", F.col("cell_y").alias("row"), reference(F.col("cell_x"), cell, 0).alias("at"), F.lit(0).alias("event"), F.lit(0).alias("level"), "cell_x", "cell_y", "edges")
    blank = lambda kind: F.lit(None).cast(kind)
    none = blank(outline.schema["edges"].dataType).alias("edges")
    events = _crossings(edges, cell).select("aoi_id", "row", F.col("x").alias("at"), F.lit(1).alias("event"), blank("int").alias("level"), blank("long").alias("cell_x"), blank("long").alias("cell_y"), none)
    placed = own.unionByName(events)
    if top > 0:  # else all areas are as small as a finest cell
        free = _free_cells(outline)
        first = F.pow(F.lit(FAN), F.col("level")).cast("long")
        points = free.select("aoi_id", (F.col("cell_y") * first).alias("row"), reference(F.col("cell_x") * first, cell, 0).alias("at"), F.lit(0).alias("event"), "level", "cell_x", "cell_y", none)
        placed = placed.unionByName(points)
    right = Window.partitionBy("aoi_id", "row").orderBy(F.col("at").desc(), "event").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = placed.withColumn("inside", F.sum("event").over(right) % 2 == 1)
    kept = counted.where((F.col("event") == 0) & (F.col("edges").isNotNull() | F.col("inside")))
    cells = kept.select("aoi_id", "level", "cell_x", "cell_y", F.col("edges").isNull().alias("whole"), "edges", F.col("inside").alias("from_inside"))
    # An area's widest cells can't be whole, so they are no keys.
    return Cover(stage(cells) if staged else cells, cell, margin, tuple(range(max(top, 1))))


def _free_cells(outline: DataFrame) -> DataFrame:
    """aoi_id, level, cell_x, cell_y: the cells that no edge meets, next below one that an edge meets."""
    above = F.explode(F.expr("filter(sequence(0, height), level -> level > 0)"))
    wide = F.pow(F.lit(FAN), F.col("level")).cast("long")
    outer = lambda c: F.floor(F.col(c) / wide).alias(c)
    parents = outline.withColumn("level", above).select("aoi_id", "level", outer("cell_x"), outer("cell_y")).distinct()
    inner = lambda c, k: (F.col(c) * FAN + k).alias(c)
    steps = F.sequence(F.lit(0), F.lit(FAN * FAN - 1))
    children = parents.select("*", F.explode(steps).alias("k")).select(
        "aoi_id", (F.col("level") - 1).alias("level"), inner("cell_x", F.col("k") % FAN), inner("cell_y", F.floor(F.col("k") / FAN)), F.lit(False).alias("met")
    )
    met = parents.unionByName(outline.select("aoi_id", F.lit(0).alias("level"), "cell_x", "cell_y")).withColumn("met", F.lit(True))
    cells = children.unionByName(met).groupBy("aoi_id", "level", "cell_x", "cell_y").agg(F.bool_or("met").alias("met"))
    return cells.where(~F.col("met")).drop("met")


def keyed(points: DataFrame, cell: float, levels: tuple[int, ...], x: str = "lon", y: str = "lat") -> DataFrame:
    """points, once for each level in use, with the cell of that level: level, cell_x, cell_y."""
    # The cells above are those of the finest cell, so that all levels agree on where a point lies.
    fine = points.withColumns({"__x": _at(F.col(x), cell), "__y": _at(F.col(y), cell)})
    keys = [F.struct(F.lit(k).alias("level"), F.floor(F.col("__x") / F.lit(FAN**k)).alias("cell_x"), F.floor(F.col("__y") / F.lit(FAN**k)).alias("cell_y")) for k in levels or (0,)]
    return fine.select(*points.columns, F.inline(F.array(*keys)), "__x", "__y")
