"""Statistics of clipped pixels by area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The land-cover classes.
CLASSES = {
    10: "Tree cover",
    20: "Shrubland",
    30: "Grassland",
    40: "Cropland",
    50: "Built-up areas",
    60: "Bare or sparse vegetation",
    70: "Snow and ice",
    80: "Permanent water bodies",
    90: "Herbaceous wetlands",
    95: "Mangroves",
    100: "Moss and lichen",
}


def elevation_stats(aois: DataFrame, clipped: DataFrame, nodata: float, value: str = "elevation") -> DataFrame:
    """mean, min, max, std (of the population) per area; an area without valid pixels gets nulls and an error."""
    v = F.nullif(F.col(value), F.lit(nodata))
    stats = clipped.groupBy("aoi_id").agg(F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("std"))
    out = aois.select("aoi_id").join(stats, "aoi_id", "left")
    return out.withColumn("error", F.when(F.col("mean").isNull(), "No valid elevation pixels"))


def classify_terrain(stats: DataFrame) -> DataFrame:
    """stats plus elevation_range_m and terrain_type; both null without statistics. The class goes by the exact range."""
    span = F.col("max") - F.col("min")
    kind = F.when(span < 50, "relatively flat").when(span < 300, "moderately undulating").when(span.isNotNull(), "highly variable or mountainous")
    return stats.withColumns({"elevation_range_m": F.round(span, 1), "terrain_type": kind})


def class_label(code: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in CLASSES.items() for x in pair))
    return F.coalesce(table[code], F.concat(F.lit("Unknown ("), code.cast("string"), F.lit(")")))


def label_by_join(df: DataFrame, classes: DataFrame) -> DataFrame:
    """df (with code) plus label, from a table of classes; unknown codes are named by their number."""
    unknown = F.concat(F.lit("Unknown ("), F.col("code").cast("string"), F.lit(")"))
    return df.join(classes, "code", "left").withColumn("label", F.coalesce("label", unknown))


def class_percentages(clipped: DataFrame, nodata: int, row: str = "r", col: str = "c") -> DataFrame:
    """aoi_id, code, n, pct (of the area's valid pixels, two places), first_pixel (row and column of the earliest)."""
    counts = clipped.where(F.col("code") != nodata).groupBy("aoi_id", "code").agg(F.count("*").alias("n"), F.min(F.struct(row, col)).alias("first_pixel"))
    total = F.sum("n").over(Window.partitionBy("aoi_id"))
    return counts.withColumn("pct", F.round(F.col("n") / total * 100, 2))


def land_cover(aois: DataFrame, percentages: DataFrame) -> DataFrame:
    """classes (label to percent), dominant_class and dominant_percentage per area; the earliest class wins a tie."""
    named = percentages.withColumn("label", class_label(F.col("code")))
    rank = F.struct(F.col("pct"), (-F.col("first_pixel.r")).alias("up"), (-F.col("first_pixel.c")).alias("left"))
    per_area = named.groupBy("aoi_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "pct")))).alias("classes"),
        F.max_by("label", rank).alias("dominant_class"),
        F.max("pct").alias("dominant_percentage"),
    )
    out = aois.select("aoi_id").join(per_area, "aoi_id", "left")
    return out.withColumn("error", F.when(F.col("classes").isNull(), "No valid landcover pixels"))
