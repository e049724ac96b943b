"""Cloud-masked median vegetation index, and its coarse fallback."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.functions.geometry import box_area_km2
from terraloom.operators import catalog
from terraloom.operators.clip import clip
from terraloom.operators.cover import Cover
from terraloom.operators.quantiles import exact_quantiles
from terraloom.sources.staging import stage

# The scene classes that count as clear.
CLEAR = (4, 5, 6, 7, 11)
BANDS = ("b04", "b08", "scl")
#: The fallback's fill threshold (values up to it are missing) and scale.
FILL, SCALE = -2000, 0.0001
WARNING = "Coarse resolution (500m) - use smaller areas for better accuracy"


def solar_day_mosaic(pixels: DataFrame, scenes: DataFrame) -> DataFrame:
    """One row per solar day and cell: of each band the value of the day's earliest scene that has one (0 is none).

    The solar day is the local date at the scene's middle longitude.
    """
    shift = F.floor((F.col("minx") + F.col("maxx")) / 2 / 15 * 3600).cast("long")
    dated = scenes.select("scene_id", "dt", F.to_date(F.timestamp_seconds(F.unix_timestamp("dt") + shift)).alias("solar_day"))
    joined = pixels.join(dated, "scene_id")
    order = F.struct("dt", "scene_id")
    # A band without data takes no part: min_by passes over null orders.
    pick = lambda band: F.min_by(F.col(band), F.when(F.col(band) != 0, order)).alias(band)
    return joined.groupBy("solar_day", "r", "c").agg(*(pick(b) for b in BANDS))


def cloud_mask(cube: DataFrame) -> DataFrame:
    return cube.where(F.col("scl").isin(*CLEAR))


def with_ndvi(cube: DataFrame) -> DataFrame:
    red, near = F.col("b04").cast("double"), F.col("b08").cast("double")
    return cube.withColumn("ndvi", (near - red) / (near + red + F.lit(1e-8)))


def median_composite(cube: DataFrame) -> DataFrame:
    """The median over time of each cell: r, c, ndvi."""
    return cube.groupBy("r", "c").agg(F.median("ndvi").alias("ndvi"))


def ndvi_stats(
    aois: DataFrame, cells: DataFrame, scenes: DataFrame, pixels: DataFrame, as_of: str, pixel: float,
    max_area_km2: float | None = 100.0, min_scenes: int = 2, max_cloud: float = 30.0, resolution_m: int = 20, collection: str = "sentinel-2-l2a", approx: bool = False,
    cover: Cover | None = None,
) -> DataFrame:
    """Statistics of the median composite per area; areas that are too large, have too few scenes or no valid cell are left out.

    The composite of a cell doesn't depend on the area, so it is made once, for the cells that any area touches. cover is that of
    all areas, if it was made before.
    """
    usable = aois.where(F.col("box").isNotNull())
    if max_area_km2 is not None:
        usable = usable.where(box_area_km2(F.col("box")) <= max_area_km2)
    usable = stage(usable)  # it is read four times below
    found = catalog.search_scenes(usable, scenes, collection, as_of, max_cloud=max_cloud)
    counts = catalog.with_enough_scenes(found, min_scenes)
    chosen = usable.join(counts.select("aoi_id"), "aoi_id", "left_semi")
    if cover is None:
        touched = clip(cells, chosen, "touched", pixel)
    else:
        touched = clip(cells, chosen, "touched", pixel, cells=replace(cover, cells=cover.cells.join(chosen.select("aoi_id"), "aoi_id", "left_semi")))
    touched = touched.select("aoi_id", "r", "c")
    needed = pixels.join(found.select("scene_id").distinct(), "scene_id", "left_semi").join(touched.select("r", "c").distinct(), ["r", "c"], "left_semi")
    composite = median_composite(with_ndvi(cloud_mask(solar_day_mosaic(needed, scenes))))
    valid = touched.join(composite, ["r", "c"]).where((F.col("ndvi") > -1) & (F.col("ndvi") < 1))
    valid = stage(valid.select("aoi_id", "ndvi"))  # the quartiles are found in several passes
    own = [F.avg("ndvi").alias("mean"), F.min("ndvi").alias("min"), F.max("ndvi").alias("max"), F.stddev_pop("ndvi").alias("std")]
    if approx:
        stats = valid.groupBy("aoi_id").agg(*own, F.percentile_approx("ndvi", [0.25, 0.75], 10_000).alias("q"))
    else:
        stats = valid.groupBy("aoi_id").agg(*own).join(exact_quantiles(valid, ["aoi_id"], "ndvi", [0.25, 0.75]), "aoi_id")
    return stats.join(counts, "aoi_id").select(
        "aoi_id", "mean", "min", "max", "std", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p75"), "scene_count",
        F.lit(resolution_m).alias("resolution_m"), F.lit("median_composite_optimized").alias("method"), F.lit(None).cast("string").alias("warning"),
    )


def fallback_pixels(coarse: DataFrame) -> DataFrame:
    """The scaled values of the first item of each quarter month; months without an item are skipped."""
    firsts = coarse.where(F.col("month").isin(*catalog.QUARTERS)).groupBy("month").agg(F.min("half").alias("half"))
    kept = coarse.join(firsts, ["month", "half"], "left_semi")
    return kept.withColumn("ndvi", F.when(F.col("raw") > FILL, F.col("raw") * F.lit(SCALE)))


def _coarse_record() -> list:
    """Sums are of the stored integers and scaled once, so that no order of rows or partitions shows in the digits."""
    v = F.when(F.col("raw") > FILL, F.col("raw").cast("long"))
    mean = F.sum(v) / F.count(v)
    spread = F.sqrt(F.greatest(F.sum(v * v) / F.count(v) - mean * mean, F.lit(0.0)))
    return [(stat * F.lit(SCALE)).alias(name) for stat, name in ((mean, "mean"), (F.min(v), "min"), (F.max(v), "max"), (spread, "std"))]


def _completed(stats: DataFrame, *keys: str) -> DataFrame:
    none = F.lit(None)
    return stats.where(F.col("mean").isNotNull()).select(
        *keys, "mean", "min", "max", "std", none.cast("double").alias("p25"), none.cast("double").alias("p75"), none.cast("long").alias("scene_count"),
        F.lit(500).alias("resolution_m"), F.lit("modis_fallback").alias("method"), F.lit(WARNING).alias("warning"),
    )


def fallback_stats(coarse: DataFrame) -> DataFrame:
    """One record over all pixels of all months, not clipped; no row without pixels."""
    return _completed(fallback_pixels(coarse).agg(*_coarse_record()))


def fallback_by_area(coarse: DataFrame, aois: DataFrame) -> DataFrame:
    """The same clipped to each area; coarse has lon and lat."""
    return _completed(clip(fallback_pixels(coarse), aois).groupBy("aoi_id").agg(*_coarse_record()), "aoi_id")


FIELDS = ("mean", "min", "max", "std", "p25", "p75", "scene_count", "resolution_m", "method", "warning")


def resolve(aois: DataFrame, primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """aoi_id, ndvi (a struct) of every area: the primary record, else the whole fallback record, else null.

    fallback has one row for each area, or a single row without aoi_id that holds for all of them.
    """
    own = primary.select("aoi_id", F.struct(*FIELDS).alias("own"))
    out = aois.select("aoi_id").join(own, "aoi_id", "left")
    record = F.struct(*FIELDS).alias("coarse")
    if "aoi_id" in fallback.columns:
        out = out.join(fallback.select("aoi_id", record), "aoi_id", "left")
    else:  # one row at most: an aggregate without keys
        out = out.withColumn("one", F.lit(1)).join(F.broadcast(fallback.select(F.lit(1).alias("one"), record)), "one", "left")
    return out.select("aoi_id", F.coalesce("own", "coarse").alias("ndvi"))
