"""Small cases worked out by hand, and properties."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.functions import geometry
from terraloom.operators import catalog, clip, context, ndvi, render, zonal
from terraloom.sources import geojson, rasters
from terraloom.streaming import streams

SQUARE = [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [0.0, 0.0]]]
HOLED = [*SQUARE, [[0.4, 0.4], [0.4, 0.6], [0.6, 0.6], [0.6, 0.4], [0.4, 0.4]]]
CONCAVE = [[[0.0, 0.0], [1.0, 0.0], [1.0, 0.5], [0.5, 0.5], [0.5, 1.0], [0.0, 1.0], [0.0, 0.0]]]


def feature(rings, kind="Polygon"):
    return {"type": "Feature", "geometry": {"type": kind, "coordinates": rings}, "properties": {}}


def areas(spark, shapes):
    texts = [(i, s if isinstance(s, str) else json.dumps(s)) for i, s in enumerate(shapes)]
    return geojson.aois_of(spark.createDataFrame(texts, "aoi_id long, geojson string"))


def grid(spark, n=10):
    step = 1.0 / n
    return spark.createDataFrame([(r, c, (c + 0.5) * step, (r + 0.5) * step) for r in range(n) for c in range(n)], "r int, c int, lon double, lat double")


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("{", "Invalid JSON"),
        ("", "Invalid JSON"),
        (json.dumps({"type": "Polygon", "coordinates": SQUARE}), "Unsupported GeoJSON type"),
        (json.dumps({"type": "FeatureCollection", "features": []}), "Empty FeatureCollection"),
        (json.dumps(feature([1.0, 2.0], "Point")), "Unsupported geometry"),
        (json.dumps(feature([[0.0, 0.0], [1.0, 1.0]], "LineString")), "Unsupported geometry"),
        (json.dumps(feature([], "Polygon")), "Invalid coordinates"),
        (json.dumps(feature(SQUARE)), None),
        (json.dumps(feature([SQUARE, HOLED], "MultiPolygon")), None),
        (json.dumps({"type": "FeatureCollection", "features": [feature(SQUARE), feature(HOLED)]}), None),
    ],
)
def test_parsing(spark, text, error):
    row = areas(spark, [text]).first()
    assert row["error"] == error
    assert (row["box"] is None) == (error is not None)


def test_only_the_first_feature_counts_unless_all_are_asked_for(spark):
    text = json.dumps({"type": "FeatureCollection", "features": [feature(HOLED), feature(SQUARE)]})
    df = spark.createDataFrame([(1, text)], "aoi_id long, geojson string")
    assert [len(r["rings"]) for r in geojson.aois_of(df).collect()] == [2]
    assert sorted(len(r["rings"]) for r in geojson.aois_of(df, mode="all").collect()) == [1, 2]


def test_clip_rules(spark):
    shapes = [feature(SQUARE), feature(HOLED), feature(CONCAVE), feature([[[0.51, 0.51], [0.53, 0.51], [0.53, 0.53], [0.51, 0.51]]])]
    a, px = areas(spark, shapes), grid(spark)
    count = lambda df: {r["aoi_id"]: r["count"] for r in df.groupBy("aoi_id").count().collect()}
    assert count(clip.clip(px, a)) == {0: 100, 1: 96, 2: 75}
    touched = count(clip.clip(px, a, "touched", 0.1))
    assert touched[3] == 1
    assert all(touched[k] >= v for k, v in count(clip.clip(px, a)).items())
    assert count(clip.clip(px, a, cell=0.33)) == count(clip.clip(px.repartition(7), a, cell=0.01))


def test_box_round_trip(spark):
    df = spark.createDataFrame([(2.0, -1.0, 5.0, 3.0)], "north double, south double, east double, west double")
    rings = geometry.box_ring(F.col("north"), F.col("south"), F.col("east"), F.col("west"))
    row = df.select("*", geometry.envelope(geometry.ring_box(rings[0])).alias("e")).first()
    assert tuple(row["e"]) == (2.0, -1.0, 5.0, 3.0)


def test_terrain_bounds(spark):
    stats = spark.createDataFrame([(0.0, 49.99), (0.0, 50.0), (0.0, 299.99), (0.0, 300.0), (None, None)], "min double, max double")
    kinds = [r["terrain_type"] for r in zonal.classify_terrain(stats).collect()]
    assert kinds == ["relatively flat", "moderately undulating", "moderately undulating", "highly variable or mountainous", None]


def test_elevation_equals_numpy(spark):
    values = [3.0, 7.5, -32768.0, 11.25, 0.0]
    px = grid(spark, 10).limit(0).sparkSession.createDataFrame([(0, v) for v in values], "aoi_id long, elevation double")
    a = spark.createDataFrame([(0,), (1,)], "aoi_id long")
    rows = {r["aoi_id"]: r for r in zonal.elevation_stats(a, px, -32768.0).collect()}
    good = np.array([v for v in values if v != -32768.0])
    assert rows[0]["std"] == pytest.approx(np.std(good)) and rows[0]["mean"] == pytest.approx(good.mean())
    assert rows[1]["mean"] is None and rows[1]["error"] == "No valid elevation pixels"


def test_dominant_class_tie_goes_to_the_earliest_pixel(spark):
    px = spark.createDataFrame([(0, 0, 0, 0), (0, 0, 1, 77), (0, 0, 2, 10), (0, 1, 0, 77), (0, 1, 1, 10)], "aoi_id long, r int, c int, code int")
    a = spark.createDataFrame([(0,), (1,)], "aoi_id long")
    rows = {r["aoi_id"]: r for r in zonal.land_cover(a, zonal.class_percentages(px, 0)).collect()}
    assert rows[0]["dominant_class"] == "Unknown (77)" and rows[0]["classes"] == {"Tree cover": 50.0, "Unknown (77)": 50.0}
    assert rows[1]["error"] == "No valid landcover pixels"


def test_ndvi_of_no_light_is_zero_and_median_equals_numpy(spark):
    cube = spark.createDataFrame([(0, 0, 0, 0), (0, 1, 10, 30), (0, 1, 10, 20), (0, 1, 5, 20), (0, 1, 1, 3)], "r int, c int, b04 int, b08 int")
    out = {r["c"]: r["ndvi"] for r in ndvi.median_composite(ndvi.with_ndvi(cube)).collect()}
    want = np.median([(b - a) / (b + a + 1e-8) for a, b in ((10, 30), (10, 20), (5, 20), (1, 3))])
    assert out[0] == 0 and out[1] == pytest.approx(want, abs=1e-12)


def test_search_bounds(spark):
    a = areas(spark, [feature(SQUARE)])
    rows = [
        (1, "2024-06-29 23:00:00", 29.9, 0.9), (2, "2024-03-31 00:00:00", 10.0, 0.9), (3, "2024-03-30 23:59:59", 10.0, 0.9),
        (4, "2024-06-01 10:00:00", 30.0, 0.9), (5, "2024-06-01 10:00:00", 1.0, 1.1),
    ]
    scenes = spark.createDataFrame(rows, "scene_id long, day string, cloud_cover double, minx double").select(
        "scene_id", F.lit("s2").alias("collection"), F.col("day").cast("timestamp").alias("dt"), "cloud_cover",
        "minx", F.lit(-3.0).alias("miny"), F.lit(4.0).alias("maxx"), F.lit(3.0).alias("maxy"),
    )
    found = catalog.search_scenes(a, scenes, "s2", "2024-06-29")
    assert sorted(r["scene_id"] for r in found.collect()) == [1, 2]
    assert catalog.with_enough_scenes(found, 3).count() == 0


def test_fallback_drops_the_threshold_itself_and_skips_missing_months(spark):
    px = spark.createDataFrame([(1, 1, -2000), (1, 1, -1999), (1, 2, 9000), (2, 1, 5000), (7, 2, 1000)], "month int, half int, raw int")
    row = ndvi.fallback_stats(px).first()
    assert (row["min"], row["max"]) == (pytest.approx(-0.1999), pytest.approx(0.1)) and row["p25"] is None
    assert ndvi.fallback_stats(px.where("month = 2")).count() == 0


def test_summary_leaves_out_what_is_missing(spark):
    kinds = "dem struct<mean:double,min:double,max:double,std:double,terrain_type:string>, ndvi struct<mean:double,method:string,warning:string>, landcover struct<classes:map<string,double>>"
    rows = [(1, (1500.4, 1400.0, 1600.5, 20.04, "relatively flat"), None, None), (2, None, (0.314, "m", None), ({"A": 1.5},)), (3, None, None, None)]
    texts = {r["aoi_id"]: r["text"] for r in render.summary_text(spark.createDataFrame(rows, f"aoi_id long, {kinds}")).collect()}
    assert texts[1] == "Elevation: averages around 1500 m (range: 1400–1600.5 m, Standard deviation of 20.0). Terrain: relatively flat."
    assert "NDVI ≈ 0.31" in texts[2] and "Note" not in texts[2] and texts[2].endswith("Land cover composition: A (1.50%).")
    assert texts[3] == "No summary available."


def test_narrative_checks(spark):
    rows = [("a 1.5 b", "word " * 148 + "1.5"), ("a 1.5 b", "word " * 150), ("", "# " + "word " * 149), ("", "short")]
    out = render.check_narratives(spark.createDataFrame(rows, "summary string, narrative string")).collect()
    assert [r["passed"] for r in out] == [True, False, False, False]
    assert out[1]["missing_numbers"] == ["1.5"] and not out[2]["plain_text"]


def test_cube_from_long_rows(spark):
    rows = [(1, 0, 0, "b04", 5), (1, 0, 0, "b08", 7), (1, 0, 0, "other", 9), (1, 0, 1, "b04", 6)]
    cube = rasters.load_cube(spark.createDataFrame(rows, "scene_id int, r int, c int, band string, value int"), ["b04", "b08"])
    assert {(r["c"], r["b04"], r["b08"]) for r in cube.collect()} == {(0, 5, 7), (1, 6, None)}


def test_mosaic_takes_the_earliest_scene_with_data(spark):
    scenes = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (2, "2024-01-01 09:00:00"), (3, "2024-01-01 23:30:00")], "scene_id int, t string").select(
        "scene_id", F.col("t").cast("timestamp").alias("dt"), F.lit(36.0).alias("minx"), F.lit(38.0).alias("maxx")
    )
    px = spark.createDataFrame([(1, 0, 0, 5, 6, 4), (2, 0, 0, 0, 8, 5), (3, 0, 0, 1, 1, 4)], "scene_id int, r int, c int, b04 int, b08 int, scl int")
    rows = {str(r["solar_day"]): (r["b04"], r["b08"], r["scl"]) for r in ndvi.solar_day_mosaic(px, scenes).collect()}
    assert rows == {"2024-01-01": (5, 8, 5), "2024-01-02": (1, 1, 4)}


def test_areas_with_errors_stay_in_the_context(spark):
    a = areas(spark, [feature(SQUARE), "{"])
    px = grid(spark).withColumns({"elevation": F.col("r").cast("double"), "code": F.lit(10)})
    none = spark.createDataFrame([], "scene_id long, collection string, dt timestamp, cloud_cover double, minx double, miny double, maxx double, maxy double")
    out = context.build_context(a, px, px, none, none, none, "2024-06-29", 0.1, datasets=("dem", "landcover"))
    rows = {r["aoi_id"]: r for r in out.collect()}
    assert rows[0]["dem"]["max"] == 9.0 and rows[0]["landcover"]["dominant_class"] == "Tree cover" and rows[0]["ndvi"] is None
    assert rows[1]["error"] == "Invalid JSON" and rows[1]["dem"] is None


def test_bursts_exactly_a_gap_apart_merge(spark):
    rows = [(1, 1, "2024-01-01 00:00:00.000"), (1, 2, "2024-01-01 00:00:00.300"), (1, 3, "2024-01-01 00:00:00.601")]
    events = spark.createDataFrame(rows, "session_id int, event_id int, t string").select("session_id", "event_id", F.col("t").cast("timestamp").alias("ts"))
    assert sorted((r["event_id"], r["n_events"]) for r in streams.debounce(events).collect()) == [(2, 2), (3, 1)]


def test_edit_keeps_the_box_and_delete_empties_it(spark):
    rows = [(1, 1, "created", 5.0), (1, 2, "edited", 9.0), (2, 3, "created", 5.0), (2, 4, "deleted", 5.0)]
    events = spark.createDataFrame(rows, "session_id int, event_id int, action string, v double").select(
        "session_id", "event_id", "action", F.timestamp_seconds("event_id").alias("ts"), *(F.col("v").alias(k) for k in streams.BOX)
    )
    out = {r["session_id"]: (r["north"], r["is_empty"]) for r in streams.latest_shape(events).collect()}
    assert out == {1: (5.0, False), 2: (0.0, True)}


def test_broken_files_are_skipped_if_asked(spark, tmp_path):
    path = str(tmp_path / "pixels")
    spark.createDataFrame([(1, 0.5), (2, 0.7)], "r int, v double").coalesce(1).write.parquet(path)
    (tmp_path / "pixels" / "part-broken.parquet").write_bytes(b"PAR1 this is no file of pixels PAR1")
    schema = "r int, v double"
    assert rasters.read_pixels(spark.newSession(), path, skip_broken=True).count() == 2
    with pytest.raises(Exception, match="(?i)parquet|footer|corrupt|FAILED_READ"):
        spark.read.schema(schema).parquet(path).count()


def _run(stream, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()


def test_a_stream_of_requests_is_enriched_once_each(spark, tmp_path):
    path = str(tmp_path / "requests")
    rows = [("a", "2024-01-01 00:00:00", 1), ("b", "2024-01-01 00:01:00", 2), ("a", "2024-01-01 00:02:00", 1), ("c", "2024-01-01 00:03:00", 9)]
    requests = spark.createDataFrame(rows, "request_id string, ts string, aoi_id long").withColumn("ts", F.col("ts").cast("timestamp"))
    requests.coalesce(1).write.parquet(path)
    contexts = spark.createDataFrame([(1, "hills"), (2, "plain")], "aoi_id long, terrain string")
    _run(streams.enrich_requests(spark.readStream.schema(requests.schema).parquet(path), contexts), "enriched", "append")
    found = sorted(((r["request_id"], r["terrain"]) for r in spark.table("enriched").collect()), key=str)
    assert found == [("a", "hills"), ("b", "plain"), ("c", None)]
    assert found == sorted(((r["request_id"], r["terrain"]) for r in streams.enrich_requests(requests, contexts).collect()), key=str)


def test_a_stream_of_shapes_updates_each_session(spark, tmp_path):
    path = str(tmp_path / "shapes")
    schema = "session_id long, action string, ts timestamp, event_id long, north double, south double, east double, west double"
    make = lambda *rows: spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1)
    first = make((1, "created", "2024-01-01 00:00:00", 1, 2.0, 1.0, 4.0, 3.0), (2, "created", "2024-01-01 00:00:00", 2, 8.0, 7.0, 6.0, 5.0))
    second = make((1, "edited", "2024-01-01 00:01:00", 3, 9.0, 9.0, 9.0, 9.0), (2, "deleted", "2024-01-01 00:02:00", 4, 0.0, 0.0, 0.0, 0.0))
    first.write.parquet(path)
    stream = streams.latest_shape(spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(path))
    query = stream.writeStream.format("memory").queryName("shapes").outputMode("update").start()
    query.processAllAvailable()
    second.write.mode("append").parquet(path)
    query.processAllAvailable()
    query.stop()
    rows = spark.table("shapes").collect()
    last = {r["session_id"]: tuple(r) for r in rows}  # later updates come later
    want = {r["session_id"]: tuple(r) for r in streams.latest_shape(first.unionByName(second)).collect()}
    assert last == want and last[2][-1] and last[1][1:5] == (2.0, 1.0, 4.0, 3.0)


@pytest.mark.parametrize("partitions", [1, 4, 8, 32])
def test_the_clipped_fallback_is_the_same_in_any_partitioning(spark, partitions):
    cells = grid(spark, 20)
    coarse = cells.withColumns({"month": F.lit(1), "half": F.lit(1), "raw": ((F.col("r") * 61 + F.col("c") * 37) % 11000 - 2500).cast("int")})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = ndvi.fallback_by_area(coarse.repartition(partitions), areas(spark, [feature(SQUARE)])).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    raw = np.array([v for r in range(20) for c in range(20) if (v := (r * 61 + c * 37) % 11000 - 2500) > -2000])
    assert (found["mean"], found["std"]) == (raw.sum() / len(raw) * 0.0001, pytest.approx(raw.std() * 0.0001, rel=1e-9))

