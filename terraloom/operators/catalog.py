"""Which scenes and tiles cover an area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.functions.geometry import boxes_meet

#: Degrees of the finest cells on which boxes are brought together. Each level above is FAN times as wide, up to the whole globe.
CELL, FAN, LEVELS = 0.5, 4, 5
QUARTERS = (1, 4, 7, 10)


def _box(prefix: str) -> dict[str, Column]:
    return {k: F.col(f"{prefix}{k}") for k in ("minx", "miny", "maxx", "maxy")}


def _level(b: dict[str, Column], cell: float) -> Column:
    """The lowest level whose cells are as wide as the box, so that it meets four of them at most; the highest if none is."""
    span = F.greatest(b["maxx"] - b["minx"], b["maxy"] - b["miny"])
    out = F.lit(LEVELS)
    for k in reversed(range(LEVELS)):
        out = F.when(span <= cell * FAN**k, k).otherwise(out)
    return out


def _keyed(df: DataFrame, prefix: str, cell: float, levels: dict[str, Column]) -> DataFrame:
    """A row for each cell that the box meets on each of the levels (an array by kind of match): kind, level, cell_x, cell_y."""
    b = _box(prefix)
    df = df.withColumn("__own", _level(b, cell))
    pairs = F.flatten(F.array(*(F.transform(at, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("level"))) for kind, at in levels.items())))  # noqa: B023
    df = df.withColumn("__key", F.explode(pairs)).select("*", F.col("__key.kind").alias("kind"), F.col("__key.level").alias("level")).drop("__key", "__own")
    at = lambda c: F.floor(c / (F.lit(cell) * F.pow(F.lit(float(FAN)), F.col("level"))))
    df = df.withColumn("cell_x", F.explode(F.sequence(at(b["minx"]), at(b["maxx"]))))
    return df.withColumn("cell_y", F.explode(F.sequence(at(b["miny"]), at(b["maxy"]))))


def covering(aois: DataFrame, scenes: DataFrame, cell: float = CELL) -> DataFrame:
    """Each area with each scene whose box meets its own; aois has aoi_id and box, scenes has minx, miny, maxx, maxy.

    Every box has the level whose cells are as wide as itself, so it meets few of them, however large it is. Two boxes
    meet on the level of the larger one, to which the smaller is lifted: an area no larger than a scene by the kind "scene", a
    larger one by the kind "area". A pair counts only in the cell that holds the south-west corner of the overlap, so that
    none comes twice and nothing must be made distinct.
    """
    areas = aois.where(F.col("box").isNotNull()).select("aoi_id", *(F.col(f"box.{k}").alias(f"aoi_{k}") for k in ("minx", "miny", "maxx", "maxy")))
    own = F.col("__own")
    alone, up = F.array(own), F.sequence(own, F.lit(LEVELS))
    above = F.filter(up, lambda k: k > own)
    keys = ["kind", "level", "cell_x", "cell_y"]
    joined = _keyed(areas, "aoi_", cell, {"scene": up, "area": alone}).join(_keyed(scenes, "", cell, {"scene": alone, "area": above}), keys)
    x, y = F.greatest("aoi_minx", "minx"), F.greatest("aoi_miny", "miny")
    side = F.lit(cell) * F.pow(F.lit(float(FAN)), F.col("level"))
    home = (F.floor(x / side) == F.col("cell_x")) & (F.floor(y / side) == F.col("cell_y"))
    return joined.where(boxes_meet(_box("aoi_"), _box("")) & home).select("aoi_id", *scenes.columns)


def search_scenes(aois: DataFrame, scenes: DataFrame, collection: str, as_of: str, days: int = 90, max_cloud: float = 30.0) -> DataFrame:
    """Scenes of a collection over each area, of the days up to as_of (both ends included), with less cloud than max_cloud."""
    last = F.lit(as_of).cast("date")
    # The column is compared as it is stored, so that the scan can skip files and row groups by it.
    in_days = (F.col("dt") >= F.date_sub(last, days)) & (F.col("dt") < F.date_add(last, 1))
    wanted = scenes.where((F.col("collection") == collection) & in_days & (F.col("cloud_cover") < max_cloud))
    return covering(aois, wanted)


def top_scenes(found: DataFrame, k: int) -> DataFrame:
    """At most k scenes of each area: the least clouded, then the newest."""
    rank = F.row_number().over(Window.partitionBy("aoi_id").orderBy("cloud_cover", F.col("dt").desc(), "scene_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def first_item(found: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    return found.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") == 1).drop("__n")


def with_enough_scenes(found: DataFrame, least: int = 2) -> DataFrame:
    """Areas with at least so many scenes: aoi_id, scene_count."""
    return found.groupBy("aoi_id").agg(F.countDistinct("scene_id").alias("scene_count")).where(F.col("scene_count") >= least)


def uncovered(aois: DataFrame, tiles: DataFrame, collections: list[str]) -> DataFrame:
    """Areas that lack a tile of one of the collections: aoi_id, missing (the first such collection), error."""
    parts = []
    for i, name in enumerate(collections):
        covered = covering(aois, tiles.where(F.col("collection") == name)).select("aoi_id")
        parts.append(aois.join(covered, "aoi_id", "left_anti").select("aoi_id", F.lit(i).alias("n"), F.lit(name).alias("missing")))
    lacking = parts[0]
    for p in parts[1:]:
        lacking = lacking.unionByName(p)
    return lacking.groupBy("aoi_id").agg(F.min_by("missing", "n").alias("missing")).withColumn("error", F.lit("No data coverage for this area"))
