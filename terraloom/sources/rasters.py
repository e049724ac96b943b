"""Pixel tables and scene catalogues stored as Parquet, and a gazetteer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terraloom.sources.staging import stage


def read_pixels(spark: SparkSession, path: str, skip_broken: bool = False) -> DataFrame:
    """A pixel table; with skip_broken, unreadable files are left out."""
    reader = spark.read
    if skip_broken:
        reader = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    return reader.parquet(path)


def load_cube(bands: DataFrame, names: list[str]) -> DataFrame:
    """From rows (scene_id, r, c, band, value), one row per pixel with a column for each band."""
    return bands.where(F.col("band").isin(*names)).groupBy("scene_id", "r", "c").pivot("band", names).agg(F.first("value", ignorenulls=True))


def regrid(pixels: DataFrame, x0: float, y0: float, resolution: float, value: str) -> DataFrame:
    """Of each cell of a coarser grid the pixel in it that is nearest its centre: row, col, value. The grid starts at its north-west corner.

    Cells without a pixel of their own are left out; `nearest` looks beyond the cell.
    """
    col, row = F.floor((F.col("lon") - F.lit(x0)) / F.lit(resolution)), F.floor((F.lit(y0) - F.col("lat")) / F.lit(resolution))
    cell = pixels.withColumns({"col": col, "row": row})
    dx = F.col("lon") - (F.lit(x0) + (F.col("col") + F.lit(0.5)) * F.lit(resolution))
    dy = F.col("lat") - (F.lit(y0) - (F.col("row") + F.lit(0.5)) * F.lit(resolution))
    far = F.round(dx * dx + dy * dy, 12)
    return cell.groupBy("row", "col").agg(F.min_by(F.col(value), F.struct(far, "r", "c")).alias(value))


def grid_cells(spark: SparkSession, x0: float, y0: float, resolution: float, rows: int, cols: int) -> DataFrame:
    """row, col, x, y (of the centre) of every cell of a grid, from its north-west corner on."""
    cells = spark.range(rows * cols).select(F.floor(F.col("id") / cols).alias("row"), (F.col("id") % cols).alias("col"))
    x, y = F.lit(x0) + (F.col("col") + 0.5) * F.lit(resolution), F.lit(y0) - (F.col("row") + 0.5) * F.lit(resolution)
    return cells.withColumns({"x": x, "y": y})


def nearest(targets: DataFrame, pixels: DataFrame, value: str, reach: float, bucket: float) -> DataFrame:
    """row, col, value: of each target (row, col, x, y) the value of the nearest pixel (r, c, lon, lat), no farther than reach; else null.

    Pixels are dealt to square buckets. Targets look into their own bucket, then into rings around it, one ring in each round,
    until nothing nearer can lie outside the rings seen; so each round is an equi-join of the targets that are still open.
    A bucket of about two pixels' width settles nearly all in two rounds. Pixels that lie equally near go by row, then column.
    """
    at = lambda c: F.floor(F.col(c) / F.lit(bucket))
    dealt = stage(pixels.where(F.col(value).isNotNull()).select("r", "c", "lon", "lat", F.col(value).alias("__value"), at("lon").alias("__bx"), at("lat").alias("__by")))
    best = f"struct<far:double, r:{dealt.schema['r'].dataType.simpleString()}, c:{dealt.schema['c'].dataType.simpleString()}, value:{dealt.schema['__value'].dataType.simpleString()}>"
    todo = targets.select("row", "col", "x", "y", at("x").alias("__tx"), at("y").alias("__ty"), F.lit(None).cast(best).alias("best"))
    done, ring = [], 0
    while True:
        steps = [(i, j) for i in range(-ring, ring + 1) for j in range(-ring, ring + 1) if max(abs(i), abs(j)) == ring]
        around = F.explode(F.array(*(F.struct((F.col("__tx") + i).alias("__bx"), (F.col("__ty") + j).alias("__by")) for i, j in steps)))
        asked = todo.withColumn("__at", around).select("*", "__at.__bx", "__at.__by").drop("__at")
        dx, dy = F.col("lon") - F.col("x"), F.col("lat") - F.col("y")
        met = asked.join(dealt, ["__bx", "__by"], "left").withColumn("__far", F.round(dx * dx + dy * dy, 12))
        found = F.min(F.when(F.col("__far").isNotNull(), F.struct(F.col("__far").alias("far"), "r", "c", F.col("__value").alias("value"))))
        todo = met.groupBy("row", "col", "x", "y", "__tx", "__ty").agg(F.least(F.min("best"), found).alias("best"))
        # All pixels up to this distance lie in the rings seen so far.
        west, south = F.col("x") - F.col("__tx") * F.lit(bucket), F.col("y") - F.col("__ty") * F.lit(bucket)
        seen = F.least(west, south, F.lit(bucket) - west, F.lit(bucket) - south) + F.lit(ring * bucket)
        todo = stage(todo.withColumn("__over", F.coalesce(F.col("best.far") < seen * seen, F.lit(False)) | (seen >= reach)))
        done.append(todo.where("__over"))
        todo = todo.where(~F.col("__over")).drop("__over")
        ring += 1
        if todo.isEmpty():
            break
    all_ = reduce(DataFrame.unionByName, done)
    return all_.select("row", "col", F.when(F.col("best.far") <= reach * reach, F.col("best.value")).alias(value))


def aligned_cube(targets: DataFrame, bands: dict[str, tuple[DataFrame, float]], reach: float) -> DataFrame:
    """row, col and a column for each band, all on the targets' grid: bands hold pixels (r, c, lon, lat, the band) and their resolution."""
    out = targets.select("row", "col")
    for name, (pixels, resolution) in bands.items():
        out = out.join(nearest(targets, pixels, name, reach, 2 * resolution), ["row", "col"], "left")
    return out


def search_places(places: DataFrame, queries: DataFrame, k: int = 5, least: int = 3) -> DataFrame:
    """Up to k places for each query of at least so many characters: those whose name has a word that begins with the query.

    Each distinct string is answered once. Names are cut into the prefixes of their words, so that the match is an
    equi-join on a prefix as long as the shortest query; only the k best of a string meet the queries that ask for it.
    """
    asked = queries.where(F.length(F.trim("q")) >= least).select("query_id", F.lower(F.trim("q")).alias("q"))
    strings = asked.select("q", F.substring("q", 1, least).alias("start")).distinct()
    words = F.filter(F.array_distinct(F.split(F.lower("display_name"), " ")), lambda w: F.length(w) >= least)
    named = places.withColumn("word", F.explode(words)).withColumn("start", F.substring("word", 1, least))
    found = strings.join(named, "start").where(F.col("word").startswith(F.col("q"))).dropDuplicates(["q", "place_id"])
    rank = F.row_number().over(Window.partitionBy("q").orderBy("display_name", "place_id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k).drop("start", "word")
    return asked.join(best, "q").select(
        "query_id", "rank", "place_id", "display_name", F.col("lat").try_cast("double").alias("lat"), F.col("lon").try_cast("double").alias("lon")
    )
