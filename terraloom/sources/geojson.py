"""Areas of interest from GeoJSON text, and GeoJSON out of them. Malformed input becomes an error column, never a failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.functions import geometry

_GEOMETRY = "geometry struct<type:string, coordinates:string>"
SCHEMA = f"type string, properties string, {_GEOMETRY}, features array<struct<type:string, properties:string, {_GEOMETRY}>>"
RINGS = "array<array<array<double>>>"
#: Shapes that the export keeps: what can be drawn as an area or a line.
EXPORTED = ("Polygon", "LineString", "Circle", "Rectangle")


def read_aois(spark: SparkSession, path: str) -> DataFrame:
    """One row per GeoJSON file: path and text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("geojson"))


def parse(df: DataFrame, text_col: str = "geojson") -> DataFrame:
    """df plus parsed and error (null where the text is a JSON object with a type)."""
    parsed = df.withColumn("parsed", F.from_json(F.col(text_col), SCHEMA))
    return parsed.withColumn("error", F.when(F.col("parsed.type").isNull(), "Invalid JSON"))


def normalize_features(df: DataFrame, mode: str = "first") -> DataFrame:
    """df (from parse) plus feature: of a collection the first feature (or, with mode="all", a row each), a feature itself.

    Anything else, an empty collection and unsupported geometry give an error.
    """
    kind = F.col("parsed.type")
    single = F.struct(kind.alias("type"), F.col("parsed.properties").alias("properties"), F.col("parsed.geometry").alias("geometry"))
    features = F.when(kind == "FeatureCollection", F.col("parsed.features")).when(kind == "Feature", F.array(single))
    if mode == "all":
        df = df.select("*", F.posexplode_outer(features).alias("feature_no", "feature"))
    else:
        df = df.withColumn("feature", F.get(features, F.lit(0)))
    error = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(~kind.isin("FeatureCollection", "Feature"), "Unsupported GeoJSON type")
        .when(F.col("feature").isNull(), "Empty FeatureCollection")
        .when(~F.coalesce(F.col("feature.geometry.type"), F.lit("")).isin("Polygon", "MultiPolygon"), "Unsupported geometry")
    )
    return df.withColumn("error", error)


def with_rings(df: DataFrame) -> DataFrame:
    """df (from normalize_features) plus rings, exterior (the first ring) and edges; a MultiPolygon gives all its parts' rings."""
    kind, text = F.col("feature.geometry.type"), F.col("feature.geometry.coordinates")
    many = F.flatten(F.from_json(text, f"array<{RINGS}>"))
    rings = F.when(F.col("error").isNull(), F.when(kind == "Polygon", F.from_json(text, RINGS)).when(kind == "MultiPolygon", many))
    df = df.withColumn("rings", rings)
    df = df.withColumn("error", F.when(F.col("error").isNull() & (F.col("rings").isNull() | (F.size("rings") == 0)), "Invalid coordinates").otherwise(F.col("error")))
    box = F.when(kind == "Polygon", geometry.ring_box(F.get("rings", F.lit(0)))).otherwise(geometry.ring_box(F.flatten("rings")))
    return df.withColumns({"edges": geometry.ring_edges(F.col("rings")), "box": F.when(F.col("error").isNull(), box)})


def aois_of(df: DataFrame, id_col: str = "aoi_id", text_col: str = "geojson", mode: str = "first") -> DataFrame:
    """id, rings, edges, box, error of every area in df."""
    out = with_rings(normalize_features(parse(df, text_col), mode))
    more = ["feature_no"] if mode == "all" else []
    return out.select(id_col, *more, "rings", "edges", "box", "error")


def resolve(df: DataFrame) -> DataFrame:
    """The area that counts: an uploaded one before a drawn box; rows with neither are left out.

    df has uploaded (GeoJSON text) and north, south, east, west.
    """
    drawn = F.when(
        F.col("north").isNotNull() & F.col("south").isNotNull() & F.col("east").isNotNull() & F.col("west").isNotNull(),
        feature_text(geometry.box_ring(F.col("north"), F.col("south"), F.col("east"), F.col("west"))),
    )
    out = df.withColumns({"geojson": F.coalesce("uploaded", drawn), "origin": F.when(F.col("uploaded").isNotNull(), "upload").otherwise("bbox")})
    return out.where(F.col("geojson").isNotNull())


def feature_text(rings: Column) -> Column:
    """A polygon feature as GeoJSON text."""
    polygon = F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), polygon.alias("geometry"), F.struct().alias("properties")))


def to_feature_collection(shapes: DataFrame, group: list[str], order: str) -> DataFrame:
    """One FeatureCollection text per group, features by order; shapes has geom_type and rings."""
    kept = shapes.where(F.col("geom_type").isin(*EXPORTED))
    feature = F.struct(
        F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.col("rings").alias("coordinates")).alias("geometry")
    )
    listed = kept.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), feature.alias("feature")))).alias("all"))
    features = F.transform("all", lambda x: x["feature"])
    return listed.select(*group, F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), features.alias("features"))).alias("geojson"))
