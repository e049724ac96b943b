"""The scene catalogue as a table: a folder for each collection and each tile of the globe, rows within it by day.

A scene is kept once, in the folder of the tile that holds its south-west corner, together with its width in tiles. A search
first finds the folders that its areas can reach, as a small table; joined to the catalogue it prunes partitions
when the query runs, so that scans read those folders only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from terraloom.operators import catalog
from terraloom.sources.staging import stage

#: Degrees of a tile.
TILE = 10.0
KEYS = ("collection", "reach", "tile_x", "tile_y")


def _tile(value: Column, tile: float) -> Column:
    return F.floor(value / F.lit(tile)).cast("int")


def write_scenes(scenes: DataFrame, path: str, mode: str = "overwrite", tile: float = TILE) -> None:
    """Write a catalogue (collection, dt, minx, miny, maxx, maxy and any other columns).

    reach is how many tiles a scene extends beyond its own, as a power of two, so that a search knows how far to look.
    """
    steps = F.greatest(_tile(F.col("maxx"), tile) - _tile(F.col("minx"), tile), _tile(F.col("maxy"), tile) - _tile(F.col("miny"), tile))
    reach = F.when(steps == 0, 0).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(steps, F.lit(1)))))).cast("int")
    dealt = scenes.withColumns({"reach": reach, "tile_x": _tile(F.col("minx"), tile), "tile_y": _tile(F.col("miny"), tile)})
    dealt.repartition(*KEYS).sortWithinPartitions(*KEYS, "dt").write.mode(mode).partitionBy(*KEYS).parquet(path)


def read_scenes(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    kinds = {"collection": StringType()}
    fields = [f for f in schema.fields if f.name not in KEYS]
    return spark.read.schema(StructType([*fields, *(StructField(k, kinds.get(k, IntegerType())) for k in KEYS)])).parquet(path)


def reachable(aois: DataFrame, table: DataFrame, tile: float = TILE) -> DataFrame:
    """The folders (reach, tile_x, tile_y) in which a scene over one of the areas can be. Their number is bounded by the globe's tiles."""
    reaches = [r["reach"] for r in table.select("reach").distinct().collect()]  # powers of two up to the globe's width
    box = F.col("box")
    out = aois.where(box.isNotNull()).select("box", F.explode(F.array(*(F.lit(r) for r in reaches)) if reaches else F.array().cast("array<int>")).alias("reach"))
    # A scene that starts up to reach tiles to the west or south of an area can extend over it.
    span = lambda low, high: F.sequence(_tile(box[low], tile) - F.col("reach"), _tile(box[high], tile))
    return out.withColumn("tile_x", F.explode(span("minx", "maxx"))).withColumn("tile_y", F.explode(span("miny", "maxy"))).select("reach", "tile_x", "tile_y").distinct()


def search_table(aois: DataFrame, table: DataFrame, collection: str, as_of: str, tile: float = TILE, **options) -> DataFrame:
    """catalog.search_scenes over a table read by read_scenes: aoi_id and the scene's columns. tile is that of the table."""
    near = stage(reachable(aois, table.where(F.col("collection") == collection), tile))
    # Tiles of the globe at most. Spark prunes partitions at run time only by a side that has a filter.
    near = F.broadcast(near.where(F.col("reach") >= 0))
    found = catalog.search_scenes(aois, table.join(near, ["reach", "tile_x", "tile_y"], "left_semi"), collection, as_of, **options)
    return found.drop("reach", "tile_x", "tile_y")
