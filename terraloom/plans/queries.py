"""The registered queries: each operator applied to the derived tables, with a flat result."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.functions import geometry
from terraloom.operators import catalog, clip, context, cover, ndvi, quantiles, render, rollup, zonal
from terraloom.sources import context_store, fixtures, geojson, geojson_files, rasters, scene_table, staging
from terraloom.sources.fixtures import AS_OF, PIXEL
from terraloom.streaming import live, streams

NODATA = -32768.0
ELEVATION = ("mean", "min", "max", "std")


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return fixtures.table(spark, sf_dir, name)


def _rounded(names: tuple[str, ...] | list[str], places: int = 6) -> dict[str, Column]:
    return {n: F.round(F.col(n), places) for n in names}


def _rings(spark: SparkSession, sf_dir: str, vertices: str = "fx_aoi_vertex") -> DataFrame:
    """aoi_id, rings (as arrays)."""
    vertex = _t(spark, sf_dir, vertices)
    ring = vertex.groupBy("aoi_id", "ring").agg(F.sort_array(F.collect_list(F.struct("i", "x", "y"))).alias("p"))
    ring = ring.select("aoi_id", "ring", F.transform("p", lambda p: F.array(p["x"], p["y"])).alias("points"))
    rings = ring.groupBy("aoi_id").agg(F.sort_array(F.collect_list(F.struct("ring", "points"))).alias("r"))
    return rings.select("aoi_id", F.transform("r", lambda r: r["points"]).alias("rings"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four texts for each area: a feature, a collection of two, a bare geometry, and a text cut short."""
    areas = _rings(spark, sf_dir)
    feature = geojson.feature_text(F.col("rings"))
    bare = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.col("rings").alias("coordinates")))
    collection = F.concat(F.lit('{"type":"FeatureCollection","features":['), feature, F.lit(","), feature, F.lit("]}"))
    texts = F.array(feature, collection, bare, F.substring(feature, 1, 40))
    return areas.select("aoi_id", F.posexplode(texts).alias("variant", "geojson")).withColumn("request_id", F.col("aoi_id") * 4 + F.col("variant"))


def aois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All areas, read from their texts once: features for even ids, collections for odd ones."""
    texts = _requests(spark, sf_dir).where(F.col("variant") == F.col("aoi_id") % 2)
    return staging.stage(geojson.aois_of(texts))


def wide_aois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of up to thirty degrees, from their texts."""
    texts = _rings(spark, sf_dir, "fx_wide_vertex").select("aoi_id", geojson.feature_text(F.col("rings")).alias("geojson"))
    return staging.stage(geojson.aois_of(texts))


def aoi_parse(spark, sf_dir):
    out = geojson.parse(_requests(spark, sf_dir))
    return out.select("request_id", F.col("parsed.type").alias("type"), F.coalesce(F.size("parsed.features"), F.lit(0)).cast("long").alias("n_features"), "error")


def aoi_normalize(spark, sf_dir):
    out = geojson.with_rings(geojson.normalize_features(geojson.parse(_requests(spark, sf_dir))))
    points = F.aggregate("rings", F.lit(0), lambda n, r: n + F.size(r))
    return out.select("request_id", F.col("feature.geometry.type").alias("geometry"), F.coalesce(F.size("rings"), F.lit(0)).cast("long").alias("n_rings"), F.coalesce(points, F.lit(0)).cast("long").alias("n_points"), "error")


def aoi_features(spark, sf_dir):
    """Every feature of every text, not only the first."""
    out = geojson.normalize_features(geojson.parse(_requests(spark, sf_dir)), mode="all")
    return out.where(F.col("error").isNull()).groupBy("request_id").agg(F.count("*").alias("n_features"), F.max("feature_no").cast("long").alias("last_no"))


def aoi_bbox(spark, sf_dir):
    out = aois(spark, sf_dir).select("aoi_id", "box", geometry.envelope(F.col("box")).alias("e"))
    return out.select("aoi_id", "box.*", "e.*")


def bbox_polygon(spark, sf_dir):
    box = aoi_bbox(spark, sf_dir)
    rings = geometry.box_ring(F.col("north"), F.col("south"), F.col("east"), F.col("west"))
    return box.select("aoi_id", F.posexplode(rings[0]).alias("i", "p")).select("aoi_id", F.col("i").cast("long").alias("i"), F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def aoi_area(spark, sf_dir):
    return aois(spark, sf_dir).select("aoi_id", F.round(geometry.box_area_km2(F.col("box")), 6).alias("area_km2"))


def aoi_area_guard(spark, sf_dir, limit: float = 50.0):
    area = geometry.box_area_km2(F.col("box"))
    skip = F.when(area > limit, F.lit("area above limit"))
    return aois(spark, sf_dir).select("aoi_id", F.round(area, 6).alias("area_km2"), skip.alias("skip_reason"))


def aoi_resolve(spark, sf_dir):
    """Sessions with an upload (ids divisible by 3), a drawn box (even ids), both or neither."""
    box = aoi_bbox(spark, sf_dir).join(_requests(spark, sf_dir).where("variant = 0").select("aoi_id", "geojson"), "aoi_id")
    upload = F.when(F.col("aoi_id") % 3 == 0, F.col("geojson"))
    drawn = {k: F.when(F.col("aoi_id") % 2 == 0, F.col(k)).alias(k) for k in ("north", "south", "east", "west")}
    out = geojson.aois_of(geojson.resolve(box.select("aoi_id", upload.alias("uploaded"), *drawn.values())))
    points = F.aggregate("rings", F.lit(0), lambda n, r: n + F.size(r))
    return out.select("aoi_id", points.cast("long").alias("n_points"), "box.*")


def _scenes(spark, sf_dir, max_cloud: float = 30.0):
    return catalog.search_scenes(aois(spark, sf_dir), _t(spark, sf_dir, "fx_scene"), "sentinel-2-l2a", AS_OF, max_cloud=max_cloud)


def scene_search(spark, sf_dir):
    return _scenes(spark, sf_dir).select("aoi_id", "scene_id", F.to_date("dt").cast("string").alias("day"), "cloud_cover")


def scene_topk(spark, sf_dir, k: int = 8):
    return catalog.top_scenes(_scenes(spark, sf_dir), k).select("aoi_id", F.col("rank").cast("long").alias("rank"), "scene_id")


def scene_guard(spark, sf_dir):
    return catalog.with_enough_scenes(_scenes(spark, sf_dir, 4.0))


def first_item(spark, sf_dir):
    """The newest scene of each area and month."""
    found = _scenes(spark, sf_dir).withColumn("month", F.month("dt"))
    out = catalog.first_item(found, ["aoi_id", "month"], [F.col("dt").desc(), F.col("scene_id")])
    return out.select("aoi_id", F.col("month").cast("long").alias("month"), "scene_id")


def aoi_uncovered(spark, sf_dir):
    return catalog.uncovered(aois(spark, sf_dir), _t(spark, sf_dir, "fx_tile"), ["nasadem", "esa-worldcover"])


def clip_center(spark, sf_dir):
    return clip.clip(_t(spark, sf_dir, "fx_cell"), aois(spark, sf_dir)).select("aoi_id", "r", "c")


def clip_touched(spark, sf_dir):
    return clip.clip(_t(spark, sf_dir, "fx_cell"), aois(spark, sf_dir), "touched", PIXEL).select("aoi_id", "r", "c")


def clip_wide(spark, sf_dir):
    """Areas many times as large as the finest cells, from a scattered set of points."""
    return clip.clip(_t(spark, sf_dir, "fx_wide_px"), wide_aois(spark, sf_dir)).select("aoi_id", "px")


def cover_outline(spark, sf_dir, cell: float = 0.5):
    """Of each wide area, how many of the points lie in whole cells and how many in cells on the outline; together they are all that lie inside."""
    areas = wide_aois(spark, sf_dir)
    cells = cover.cover(areas, cell, staged=True)
    met = clip.clip(_t(spark, sf_dir, "fx_wide_px"), areas, cells=cells).groupBy("aoi_id").agg(F.count("*").alias("n_inside"))
    # Whole cells and cells on the outline, counted by the finest cells that they stand for.
    surface = cells.cells.where("whole").groupBy("aoi_id").agg(F.sum(F.pow(F.lit(float(cover.FAN**2)), F.col("level"))).cast("long").alias("whole_cells"))
    return areas.select("aoi_id").join(met, "aoi_id", "left").join(surface, "aoi_id", "left").select("aoi_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_inside", "whole_cells")))


def scene_search_wide(spark, sf_dir):
    """Scenes from a hundredth of a degree to the whole globe, over areas of all sizes."""
    areas = wide_aois(spark, sf_dir).unionByName(aois(spark, sf_dir).withColumn("aoi_id", F.col("aoi_id") + 100))
    return catalog.covering(areas, _t(spark, sf_dir, "fx_footprint")).select("aoi_id", "scene_id")


def _elevation(spark, sf_dir):
    areas = aois(spark, sf_dir)
    return zonal.elevation_stats(areas, clip.clip(_t(spark, sf_dir, "fx_dem"), areas), NODATA)


def dem_stats(spark, sf_dir):
    return _elevation(spark, sf_dir).withColumns(_rounded(ELEVATION))


def terrain_class(spark, sf_dir):
    return zonal.classify_terrain(_elevation(spark, sf_dir)).select("aoi_id", "elevation_range_m", "terrain_type")


def _percentages(spark, sf_dir):
    return zonal.class_percentages(clip.clip(_t(spark, sf_dir, "fx_lc"), aois(spark, sf_dir)), 0)


def landcover_pct(spark, sf_dir):
    return _percentages(spark, sf_dir).select("aoi_id", "code", "n", "pct")


def landcover_label(spark, sf_dir):
    classes = reduce(DataFrame.unionByName, (spark.range(1).select(F.lit(k).alias("code"), F.lit(v).alias("label")) for k, v in zonal.CLASSES.items()))
    return zonal.label_by_join(_percentages(spark, sf_dir), classes).select("aoi_id", "code", "label", "pct")


def _cover(spark, sf_dir):
    return zonal.land_cover(aois(spark, sf_dir), _percentages(spark, sf_dir))


def landcover_dominant(spark, sf_dir):
    return _cover(spark, sf_dir).select("aoi_id", "dominant_class", "dominant_percentage", "error")


def landcover_map(spark, sf_dir):
    return _cover(spark, sf_dir).select("aoi_id", F.explode("classes").alias("label", "pct"))


def scene_cube(spark, sf_dir):
    px = _t(spark, sf_dir, "fx_scene_px")
    bands = px.select("scene_id", "r", "c", F.explode(F.create_map(*(x for b in ndvi.BANDS for x in (F.lit(b), F.col(b).cast("long"))))).alias("band", "value"))
    return rasters.load_cube(bands, list(ndvi.BANDS))


def _mosaic(spark, sf_dir):
    return ndvi.solar_day_mosaic(_t(spark, sf_dir, "fx_scene_px"), _t(spark, sf_dir, "fx_scene"))


def solar_day_mosaic(spark, sf_dir):
    out = _mosaic(spark, sf_dir)
    return out.select(F.col("solar_day").cast("string").alias("solar_day"), "r", "c", *(F.coalesce(F.col(b).cast("long"), F.lit(0)).alias(b) for b in ndvi.BANDS))


def cloud_mask(spark, sf_dir):
    return ndvi.cloud_mask(_t(spark, sf_dir, "fx_scene_px")).groupBy("scl").agg(F.count("*").alias("n")).select(F.col("scl").cast("long").alias("scl"), "n")


def ndvi_scene(spark, sf_dir):
    out = ndvi.with_ndvi(ndvi.cloud_mask(_t(spark, sf_dir, "fx_scene_px")))
    return out.select("scene_id", "r", "c", F.round("ndvi", 9).alias("ndvi"))


def ndvi_median(spark, sf_dir):
    out = ndvi.median_composite(ndvi.with_ndvi(ndvi.cloud_mask(_mosaic(spark, sf_dir))))
    return out.select("r", "c", F.round("ndvi", 9).alias("ndvi"))


def _primary(spark, sf_dir, **options):
    names = ("fx_cell", "fx_scene", "fx_scene_px")
    return ndvi.ndvi_stats(aois(spark, sf_dir), *(_t(spark, sf_dir, n) for n in names), AS_OF, PIXEL, **options)


def ndvi_stats(spark, sf_dir):
    return _primary(spark, sf_dir).withColumns(_rounded(["mean", "min", "max", "std", "p25", "p75"])).drop("warning")


def ndvi_quartiles_approx(spark, sf_dir):
    """The same with approximate quartiles: whether they lie within the exact ones' neighbours, a hundredth apart."""
    exact, near = _primary(spark, sf_dir), _primary(spark, sf_dir, approx=True)
    both = exact.join(near.select("aoi_id", F.col("p25").alias("a25"), F.col("p75").alias("a75"), F.col("mean").alias("a_mean")), "aoi_id")
    within = F.col("a25").between(F.col("min"), F.col("p75")) & F.col("a75").between(F.col("p25"), F.col("max"))
    return both.select("aoi_id", within.alias("within"), (F.col("mean") == F.col("a_mean")).alias("same_mean"))


def coarse_quantiles(spark, sf_dir, held: int = 50):
    """Deciles and quartiles of the coarse index by month, in as many passes as ranges of 50 values take."""
    px = _t(spark, sf_dir, "fx_modis").where("raw > -2000").select("month", F.col("raw").cast("double").alias("raw"))
    out = quantiles.exact_quantiles(px, ["month"], "raw", [0.1, 0.25, 0.5, 0.75, 0.9, 1.0], held)
    names = ("p10", "p25", "p50", "p75", "p90", "p100")
    return out.select(F.col("month").cast("long").alias("month"), *(F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(names)))


def price_quantiles(spark, sf_dir):
    """Quantiles of a skewed value in few, large groups."""
    lines = _t(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_extendedprice") * F.col("l_quantity")).cast("double").alias("v"))
    out = quantiles.exact_quantiles(lines, ["l_returnflag"], "v", [0.0, 0.01, 0.5, 0.999], 100)
    return out.select("l_returnflag", *(F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("least", "p1", "median", "p999"))))


def ndvi_fallback(spark, sf_dir):
    return ndvi.fallback_stats(_t(spark, sf_dir, "fx_modis")).withColumns(_rounded(ELEVATION)).select(*ELEVATION, "resolution_m", "method")


def ndvi_fallback_clipped(spark, sf_dir):
    """The fallback clipped to each area."""
    coarse = _t(spark, sf_dir, "fx_modis").join(_t(spark, sf_dir, "fx_cell"), ["r", "c"])
    return ndvi.fallback_by_area(coarse, aois(spark, sf_dir)).withColumns(_rounded(ELEVATION)).select("aoi_id", *ELEVATION)


def ndvi_resolved(spark, sf_dir):
    """With an area limit of 50 square kilometres, so that some areas take the fallback."""
    primary = _primary(spark, sf_dir, max_area_km2=50.0)
    out = ndvi.resolve(aois(spark, sf_dir), primary, ndvi.fallback_stats(_t(spark, sf_dir, "fx_modis"))).select("aoi_id", "ndvi.*")
    return out.withColumns(_rounded(["mean", "p25"])).withColumn("scene_count", F.coalesce("scene_count", F.lit(0))).select("aoi_id", "mean", "p25", "scene_count", "resolution_m", "method", "warning")


def regrid(spark, sf_dir):
    """Elevation on a grid of 0.025 degrees."""
    return rasters.regrid(_t(spark, sf_dir, "fx_dem"), 36.6, -1.1, 0.025, "elevation")


def regrid_fine(spark, sf_dir):
    """Elevation on a grid finer than the pixels' own, with pixels up to two hundredths of a degree away; every third row of pixels is taken out."""
    targets = rasters.grid_cells(spark, 36.61, -1.12, 0.0037, 70, 80)
    out = rasters.nearest(targets, _t(spark, sf_dir, "fx_dem").where("r % 3 <> 1"), "elevation", 0.02, 0.02)
    return out.select("row", "col", "elevation")


def cube_aligned(spark, sf_dir):
    """Elevation and a coarse index (every fourth pixel) on one grid."""
    targets = rasters.grid_cells(spark, 36.6, -1.1, 0.015, 20, 20)
    coarse = _t(spark, sf_dir, "fx_lc").where("r % 4 = 0 and c % 4 = 0").select("r", "c", "lon", "lat", F.col("code").cast("long").alias("code"))
    return rasters.aligned_cube(targets, {"elevation": (_t(spark, sf_dir, "fx_dem"), 0.01), "code": (coarse, 0.04)}, 0.08)


def terrain_rollup(spark, sf_dir):
    """Elevation by area, region and all together, merged from the areas' states."""
    px = clip.clip(_t(spark, sf_dir, "fx_dem"), aois(spark, sf_dir)).withColumn("elevation", F.nullif("elevation", F.lit(NODATA)))
    kept = staging.stage(rollup.states(px, ["aoi_id"], "elevation"))
    out = rollup.rollup(kept.withColumn("region", F.col("aoi_id") % 4), ["region", "aoi_id"])
    named = {c: F.coalesce(F.col(c).cast("long"), F.lit(-1)) for c in ("region", "aoi_id")}
    return out.withColumns(named | _rounded(ELEVATION) | {"level": F.col("level").cast("long")})


def context_store_(spark, sf_dir):
    """Records of terrain, written in turns: all with a wrong class, then even areas, then odd ones. What is read back."""
    path = f"{staging.shared_folder(spark)}/contexts-{uuid.uuid4().hex}"
    terrain = staging.stage(zonal.classify_terrain(_elevation(spark, sf_dir)).select("aoi_id", F.struct("elevation_range_m", "terrain_type").alias("dem")))
    wrong = terrain.withColumn("dem", F.col("dem").withField("terrain_type", F.lit("wrong")))
    for part in (wrong, terrain.where("aoi_id % 2 = 0"), terrain.where("aoi_id % 2 = 1")):
        context_store.put(part, path, buckets=8)
    return context_store.get(spark, path, terrain.schema).select("aoi_id", "dem.*")


def build(spark: SparkSession, sf_dir: str, datasets=context.DATASETS, with_tiles: bool = False, limit: float = 50.0) -> DataFrame:
    names = ("fx_dem", "fx_lc", "fx_scene", "fx_scene_px", "fx_modis")
    tiles = _t(spark, sf_dir, "fx_tile") if with_tiles else None
    return context.build_context(aois(spark, sf_dir), *(_t(spark, sf_dir, n) for n in names), AS_OF, PIXEL, datasets=datasets, tiles=tiles, max_area_km2=limit)


def _flat(found: DataFrame) -> DataFrame:
    r = lambda c: F.round(F.col(c), 6)
    return found.select(
        "aoi_id", r("dem.mean").alias("dem_mean"), r("dem.std").alias("dem_std"), F.col("dem.elevation_range_m").alias("elevation_range_m"), F.col("dem.terrain_type").alias("terrain_type"),
        r("ndvi.mean").alias("ndvi_mean"), r("ndvi.p75").alias("ndvi_p75"), F.coalesce("ndvi.scene_count", F.lit(0)).alias("scene_count"), F.col("ndvi.method").alias("ndvi_method"),
        F.col("landcover.dominant_class").alias("dominant_class"), F.col("landcover.dominant_percentage").alias("dominant_percentage"), F.coalesce(F.size("landcover.classes"), F.lit(0)).cast("long").alias("n_classes"),
    )


def context_(spark, sf_dir):
    return _flat(build(spark, sf_dir))


def context_covered(spark, sf_dir):
    """Elevation and land cover only, of covered areas; the others get the error."""
    found = build(spark, sf_dir, ("dem", "landcover"), with_tiles=True)
    return found.select("aoi_id", F.round("dem.mean", 6).alias("dem_mean"), F.col("landcover.dominant_class").alias("dominant_class"), F.col("ndvi").isNull().alias("no_ndvi"), "error")


def context_json(spark, sf_dir):
    """The records as JSON text, read back."""
    found = build(spark, sf_dir)
    record = found.select(F.struct(F.struct("dem", "ndvi", "landcover").alias("summary")).alias("x")).schema["x"].dataType
    text = render.context_json(found)
    return _flat(text.select("aoi_id", F.from_json("json", record).alias("x")).select("aoi_id", "x.summary.*"))


def summary_text(spark, sf_dir):
    """The sentences, with numbers that end on a tie left out: the length and the parts that are text."""
    out = render.summary_text(build(spark, sf_dir))
    part = lambda pattern: F.regexp_extract("text", pattern, 1)
    return out.select("aoi_id", part("Terrain: ([^.]*)").alias("terrain"), part(r"NDVI method: (\w+)").alias("method"), part("(Note: [^.]*)").alias("note"), part(r"Elevation: averages around (-?\d+) m").alias("elevation"), part(r"composition: (.*)\.$").alias("cover"))


def narrative_prompt(spark, sf_dir):
    out = render.prompts(build(spark, sf_dir), (*render.AUDIENCES, "poet"))
    return out.select("aoi_id", "audience", F.coalesce(F.col("prompt").contains(F.concat(F.lit("Audience: "), "audience")), F.lit(False)).alias("names_audience"), F.coalesce(~F.col("prompt").contains("{"), F.lit(False)).alias("unfilled"), "error").drop("unfilled")


def narrative_qa(spark, sf_dir):
    """Order comments stand for narratives: an order's key and priority are the numbers to keep."""
    orders = _t(spark, sf_dir, "orders")
    summary = F.concat(F.lit("key "), (F.col("o_orderkey") % 100).cast("string"), F.lit(", class "), F.substring("o_orderpriority", 1, 1))
    text = F.concat(F.lit("Area "), (F.col("o_orderkey") % 100).cast("string"), F.lit(" of "), F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 2 == 0, F.repeat(F.lit(" word"), 140)).otherwise(""))
    out = render.check_narratives(orders.select("o_orderkey", summary.alias("summary"), text.alias("narrative")))
    return out.select("o_orderkey", F.col("n_words").cast("long").alias("n_words"), "right_length", F.size("missing_numbers").cast("long").alias("n_missing"), "plain_text", "passed")


def _drawn(spark, sf_dir):
    return _t(spark, sf_dir, "fx_draw").withColumns({"north": F.col("south") + 0.03, "east": F.col("west") + 0.03})


def geojson_export(spark, sf_dir):
    """The shapes of each session as a collection, read back."""
    drawn = _drawn(spark, sf_dir).where("action <> 'deleted'")
    shapes = drawn.select("session_id", "event_id", F.when(F.col("event_id") % 5 == 0, "Marker").otherwise("Rectangle").alias("geom_type"), geometry.box_ring(F.col("north"), F.col("south"), F.col("east"), F.col("west")).alias("rings"))
    out = geojson.parse(geojson.to_feature_collection(shapes, ["session_id"], "event_id"))
    first = F.from_json(F.get("parsed.features", F.lit(0))["geometry"]["coordinates"], geojson.RINGS)
    return out.select("session_id", F.size("parsed.features").cast("long").alias("n_features"), F.round(first[0][0][0], 6).alias("west"), F.round(first[0][0][1], 6).alias("south"))


def geojson_files_(spark, sf_dir):
    """The drawn shapes as files, a folder for each remainder of the session, read back and described by session."""
    path = f"{staging.shared_folder(spark)}/shapes-{uuid.uuid4().hex}"
    drawn = _drawn(spark, sf_dir).where("action <> 'deleted' and event_id % 5 <> 0")
    ring = geometry.box_ring(F.col("north"), F.col("south"), F.col("east"), F.col("west"))
    shape = F.struct(F.lit("Polygon").alias("type"), ring.alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct("session_id", "event_id").alias("properties"), shape.alias("geometry"))
    geojson_files.write_files(drawn.select((F.col("session_id") % 7).alias("part"), F.to_json(feature).alias("geojson")), path, "part")
    read = geojson.aois_of(geojson_files.read_files(spark, path).withColumn("p", F.from_json(F.get_json_object("geojson", "$.properties"), "session_id long, event_id long")), "p")
    first = F.min_by(F.col("box"), F.col("p.event_id"))
    out = read.where(F.col("error").isNull()).groupBy(F.col("p.session_id").alias("session_id")).agg(F.count("*").alias("n_features"), first.alias("box"))
    return out.select("session_id", "n_features", F.round("box.minx", 6).alias("west"), F.round("box.miny", 6).alias("south"))


def scene_table_search(spark, sf_dir):
    """Footprints kept as a table by collection and tile, searched from the table."""
    path = f"{staging.shared_folder(spark)}/scenes-{uuid.uuid4().hex}"
    cloud, day = (F.col("scene_id") % 100).cast("double"), F.date_add(F.lit(AS_OF).cast("date"), -(F.col("scene_id") % 120).cast("int"))
    scenes = _t(spark, sf_dir, "fx_footprint").withColumns({"collection": F.when(F.col("scene_id") % 5 == 0, "other").otherwise("s2"), "cloud_cover": cloud, "dt": day.cast("timestamp")})
    scene_table.write_scenes(scenes, path, tile=45.0)
    table = scene_table.read_scenes(spark, path, scenes.schema)
    return scene_table.search_table(wide_aois(spark, sf_dir), table, "s2", AS_OF, 45.0).select("aoi_id", "scene_id")


def place_search(spark, sf_dir):
    """Each place's second word, cut to four letters, asks for places; queries that are too short find nothing."""
    places = _t(spark, sf_dir, "fx_place")
    asked = places.select(F.col("place_id").alias("query_id"), F.substring(F.split("display_name", " ")[1], 1, 2 + F.col("place_id") % 3).alias("q"))
    found = rasters.search_places(places, asked)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "place_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def latest_shape(spark, sf_dir):
    return streams.latest_shape(_drawn(spark, sf_dir)).withColumns(_rounded(streams.BOX))


def debounce(spark, sf_dir):
    out = streams.debounce(_t(spark, sf_dir, "fx_draw"), "6 hours")
    return out.select("session_id", F.date_format("fired_at", "yyyy-MM-dd HH:mm:ss").alias("fired_at"), "event_id", "n_events")


def stream_requests(spark, sf_dir):
    """Requests that come twice, with their areas' terrain: the batch twin of the stream."""
    terrain = zonal.classify_terrain(_elevation(spark, sf_dir)).select("aoi_id", "terrain_type")
    return streams.enrich_requests(_requests_of(spark, sf_dir), terrain).select("request_id", "aoi_id", "terrain_type")


def _requests_of(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    twice = F.explode(F.array(F.lit(0), F.lit(1)))
    return events.select(F.col("event_id").alias("request_id"), "ts", (F.col("user_id") % 25).cast("int").alias("aoi_id"), twice.alias("n")).drop("n")


def live_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as a stream, each with the text of its area; areas that no batch has met are built on the way."""
    path = f"{sf_dir}/events.parquet"
    folder = f"{staging.shared_folder(spark)}/live-{uuid.uuid4().hex}"
    texts = staging.stage(_requests(spark, sf_dir).where(F.col("variant") == F.col("aoi_id") % 2).select(F.col("aoi_id").cast("long").alias("aoi_id"), "geojson"))
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    twice = F.explode(F.array(F.lit(0), F.lit(1)))
    asked = events.select(F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 25).cast("long").alias("aoi_id"), twice.alias("n")).drop("n").join(texts, "aoi_id", "left")
    dem = staging.stage(_t(spark, sf_dir, "fx_dem"))

    def terrain(areas: DataFrame) -> DataFrame:
        return zonal.classify_terrain(zonal.elevation_stats(areas, clip.clip(dem, areas), NODATA)).select("aoi_id", "terrain_type")

    live.start_answers(asked, terrain, f"{folder}/store", f"{folder}/out", f"{folder}/state", "aoi_id long, terrain_type string").awaitTermination()
    return spark.read.schema("request_id long, aoi_id long, terrain_type string").parquet(f"{folder}/out").select("request_id", F.col("aoi_id").cast("int").alias("aoi_id"), "terrain_type")


def live_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last change of each session's box, from a stream whose state is freed after 30 days without a change."""
    path = f"{sf_dir}/events.parquet"
    folder = f"{staging.shared_folder(spark)}/live-{uuid.uuid4().hex}"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    action = F.when(F.col("event_type") == "view", "created").when(F.col("event_type") == "click", "edited").when(F.col("event_type") == "error", "deleted")
    south, west = -1.50 + F.floor("value") % 37 * 0.01, 36.60 + F.floor("value") % 40 * 0.01
    drawn = events.select(F.col("user_id").cast("long").alias("session_id"), action.alias("action"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"), south.alias("south"), west.alias("west"))
    drawn = drawn.withColumns({"north": F.col("south") + 0.03, "east": F.col("west") + 0.03})
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, live.ROCKSDB)
    try:
        shapes = live.latest_shape_with_ttl(drawn, 30 * 24 * 3600)
        put = lambda df, i: df.write.mode("overwrite").parquet(f"{folder}/out/batch={i}")
        shapes.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    changes = spark.read.schema(f"{live.SHAPE}, batch int").parquet(f"{folder}/out").where(~F.col("expired"))
    last = changes.groupBy("session_id").agg(F.max_by(F.struct(*streams.BOX, "is_empty"), F.struct("ts", "event_id")).alias("last"))
    return last.select("session_id", "last.*").withColumns(_rounded(streams.BOX))


def stream_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """debounce by Structured Streaming over the events file; what the stream has fired once it has read everything.

    The last burst of a stream stays open until a later event passes the watermark, so bursts near the end are left out.
    """
    events = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parquet*")
    folder = f"{staging.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    drawn = events.where(F.col("event_type").isin("view", "click", "error")).select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("session_id"))
    fired = streams.debounce(drawn, "6 hours", "1 hour")
    run = fired.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    out = spark.read.schema(fired.schema).parquet(f"{folder}/out")
    return out.select("session_id", F.date_format("fired_at", "yyyy-MM-dd HH:mm:ss").alias("fired_at"), "event_id", "n_events")

