"""The whole analysis: one nested record for each area."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.operators import catalog, ndvi, zonal
from terraloom.operators.clip import clip
from terraloom.operators.cover import cover as cells_of

DATASETS = ("dem", "ndvi", "landcover")


def build_context(
    aois: DataFrame, dem: DataFrame, cover: DataFrame, scenes: DataFrame, scene_pixels: DataFrame, coarse: DataFrame, as_of: str, pixel: float,
    dem_nodata: float = -32768.0, cover_nodata: int = 0, datasets: tuple[str, ...] = DATASETS, tiles: DataFrame | None = None, **ndvi_options,
) -> DataFrame:
    """aoi_id, dem, ndvi, landcover (structs), error. Datasets that aren't asked for are null and not computed.

    With tiles, areas that lack an elevation or land-cover tile get an error and no records.
    """
    usable = aois.where(F.col("error").isNull())
    errors = aois.select("aoi_id", "error")
    if tiles is not None:
        lacking = catalog.uncovered(usable, tiles, ["nasadem", "esa-worldcover"]).select("aoi_id", F.col("error").alias("uncovered"))
        errors = errors.join(lacking, "aoi_id", "left").select("aoi_id", F.coalesce("error", "uncovered").alias("error"))
        usable = usable.join(lacking, "aoi_id", "left_anti")
    out = errors
    cells = cells_of(usable, margin=pixel / 2, staged=True)  # one cover for all joins with pixels
    if "dem" in datasets:
        stats = zonal.classify_terrain(zonal.elevation_stats(usable, clip(dem, usable, cells=cells), dem_nodata))
        fields = ("mean", "min", "max", "std", "elevation_range_m", "terrain_type", "error")
        out = out.join(stats.select("aoi_id", F.struct(*fields).alias("dem")), "aoi_id", "left")
    else:
        out = out.withColumn("dem", F.lit(None).cast("struct<mean:double,min:double,max:double,std:double,elevation_range_m:double,terrain_type:string,error:string>"))
    if "ndvi" in datasets:
        grid = cover.select("r", "c", "lon", "lat")
        primary = ndvi.ndvi_stats(usable, grid, scenes, scene_pixels, as_of, pixel, cover=cells, **ndvi_options)
        out = out.join(ndvi.resolve(usable, primary, ndvi.fallback_stats(coarse)), "aoi_id", "left")
    else:
        out = out.withColumn("ndvi", F.lit(None).cast("struct<mean:double,min:double,max:double,std:double,p25:double,p75:double,scene_count:bigint,resolution_m:int,method:string,warning:string>"))
    if "landcover" in datasets:
        found = zonal.land_cover(usable, zonal.class_percentages(clip(cover, usable, cells=cells), cover_nodata))
        out = out.join(found.select("aoi_id", F.struct("classes", "dominant_class", "dominant_percentage", "error").alias("landcover")), "aoi_id", "left")
    else:
        out = out.withColumn("landcover", F.lit(None).cast("struct<classes:map<string,double>,dominant_class:string,dominant_percentage:double,error:string>"))
    return out.select("aoi_id", "dem", "ndvi", "landcover", "error")
