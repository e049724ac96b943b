"""GeoJSON files written and read back."""

import json
import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from terraloom.sources import geojson, geojson_files


def _features(spark, n):
    text = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.col("id").alias("n"), F.lit("é\n\"").alias("name")).alias("properties"), F.lit(None).cast("string").alias("geometry")))
    return spark.range(n).select(text.alias("geojson"), F.concat(F.lit("a/ b"), F.col("id") % 3).alias("kind"))


def test_files_come_back_equal_and_broken_ones_as_errors(spark, tmp_path):
    path = tmp_path / "shapes"
    given = _features(spark, 50).unionByName(spark.createDataFrame([(None, "none")], "geojson string, kind string"))
    geojson_files.write_files(given.repartition(4), str(path), "kind")
    assert len({p.parent.name for p in path.rglob("*.geojson")}) == 3 and not (path / geojson_files.ASIDE).exists()
    for p in path.rglob("*.geojson"):
        assert json.loads(p.read_text())["type"] == "FeatureCollection"
    (path / "broken.geojson").write_text("{")
    (path / "bytes.geojson").write_bytes(b"\xff\xfe{")
    (path / "bare.geojson").write_text('{"type": "Point", "coordinates": [0, 0]}')
    (path / "empty.geojson").write_text('{"type": "FeatureCollection", "features": []}')
    (path / "list.geojson").write_text("[1]")
    found = geojson_files.read_files(spark, str(path)).collect()
    want = sorted(json.loads(r["geojson"])["properties"]["n"] for r in given.where("geojson is not null").collect())
    assert sorted(json.loads(r["geojson"])["properties"]["n"] for r in found if r["error"] is None) == want
    assert {r["path"].rsplit("/", 1)[1]: r["error"] for r in found if r["error"]} == {
        "broken.geojson": "Invalid JSON", "bytes.geojson": "Invalid JSON", "bare.geojson": "Unsupported GeoJSON type", "empty.geojson": "Empty FeatureCollection", "list.geojson": "Unsupported GeoJSON type",
    }


def test_append_adds_and_overwrite_replaces(spark, tmp_path):
    path = str(tmp_path / "shapes")
    count = lambda: geojson_files.read_files(spark, f"file://{path}").count()
    for mode, n in (("append", 5), ("append", 10), ("overwrite", 5)):
        geojson_files.write_files(_features(spark, 5), path, mode=mode)
        assert count() == n


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = tmp_path / "shapes"
    geojson_files.write_files(_features(spark, 4), str(path))
    fails = _features(spark, 40).repartition(4).withColumn("geojson", F.when(F.rand(1) < 2, F.when(F.col("geojson").contains('"n":33'), F.raise_error(F.lit("lost"))).otherwise(F.col("geojson"))))
    with pytest.raises(Exception, match="lost"):
        geojson_files.write_files(fails, str(path), "kind", mode="overwrite")
    assert geojson_files.read_files(spark, str(path)).count() == 4 and not (path / geojson_files.ASIDE).exists()
    with pytest.raises(Exception, match="geojson"):
        geojson_files.write_files(spark.range(3), str(path))


def test_areas_are_read_from_files(spark, tmp_path):
    ring = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]
    (tmp_path / "one.geojson").write_text(json.dumps({"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [ring]}}))
    (tmp_path / "two.geojson").write_text("no json")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in geojson.aois_of(geojson.read_aois(spark, str(tmp_path)), "path").collect()}
    assert len(rows["one.geojson"]["edges"]) == 3 and rows["two.geojson"]["error"] == "Invalid JSON"
    assert geojson_files.read_files(spark, str(tmp_path / "nothing")).count() == 0


def _rows(path):
    """What reading tasks give for a file, without Spark."""
    reader = geojson_files._Reader(str(path))
    return [tuple(r.values())[1:] for p in reader.partitions() for batch in reader.read(p) for r in batch.to_pylist()]


def _plain(data):
    """The same of a file's bytes, parsed at once."""
    try:
        found = json.loads(data.decode("utf-8"))
    except ValueError:
        return [(0, None, "Invalid JSON")]
    kind = found.get("type") if isinstance(found, dict) else None
    features = found.get("features") if kind == "FeatureCollection" else [found] if kind == "Feature" else None
    if not isinstance(features, list):
        return [(0, None, "Unsupported GeoJSON type")]
    return [(i, json.dumps(x), None) for i, x in enumerate(features)] or [(0, None, "Empty FeatureCollection")]


def test_files_read_piece_by_piece_equal_files_parsed_at_once(tmp_path, monkeypatch):
    whole = [
        r'{"type": "FeatureCollection", "features": [{"type": "Feature", "n": [1, -2.50, 1e3, 12E-2, true, null, {}]}, "a\"\ud83d\ude00\\", 12, -0.5e+10, NaN, -Infinity, [], [[]]], "more": [1, [2]]}',
        '{ "features" : [ 1 , {"é": "日本"} ] ,\n "bbox": [0, 1.5], "crs": {"a": [1]}, "type" : "FeatureCollection" } \n',
        '{"type": "Feature", "features": [1], "geometry": {"type": "Point", "coordinates": [1.0, 2]}, "properties": null}',
        '{"type": "FeatureCollection", "features": [1, 2], "features": [3], "x": [], "type": "FeatureCollection"}',
        '{"type": "FeatureCollection", "features": [1, 2], "features": {"a": 3}}',
        '{"type": "FeatureCollection", "features": []}', '{"type": ["FeatureCollection"], "features": [1]}', '{"type": "FeatureCollection"}', '{"type": {}, "features": [1]}',
        "{}", "[]", "[1, {}]", "12", '"Feature"', "null", "", " ", "{} {}", "[1,]", '{"a": 1,}', "{1: 2}", "\ufeff{}", '{"type": "Feature", "a": "\t"}', '{"type": "Feature", "a": "\\x"}',
        '{"type": "FeatureCollection", "features": [1 2]}', '{"type": "FeatureCollection", "features": [1, 2], }', '{"type": "FeatureCollection", "features": [1, 2]} x', "1" * 5000, "1" * 5000 + ".5",
    ]
    texts, rng = [x.encode("utf-8") for x in whole], random.Random(7)
    for x in texts[:4]:
        texts += [x[:k] for k in range(len(x))]
        texts += [x[: (k := rng.randrange(len(x)))] + rng.choice([b"", b'"', b",", b"]", b"}", b"[", b"1", b"\\", b"\xff"]) + x[k + rng.randrange(2) :] for _ in range(300)]
    path = tmp_path / "one.geojson"
    for piece in (1, 7, 40, 4 << 20):
        monkeypatch.setattr(geojson_files, "PIECE", piece, raising=False)
        for x in texts if piece != 4 << 20 else whole:
            path.write_bytes(x if isinstance(x, bytes) else x.encode("utf-8"))
            assert _rows(path) == _plain(path.read_bytes()), (piece, x)


@pytest.mark.parametrize("broken", [False, True])
def test_reading_holds_a_piece_of_a_large_file(tmp_path, monkeypatch, broken):
    monkeypatch.setattr(geojson_files, "PIECE", 1 << 16, raising=False)
    ring = [[round(x * 0.1, 3), 0.5] for x in range(5)]
    feature = json.dumps({"type": "Feature", "properties": {"n": 1, "name": "é"}, "geometry": {"type": "Polygon", "coordinates": [ring]}})
    n = 20_000
    path = tmp_path / "large.geojson"
    path.write_text('{"type": "FeatureCollection", "features": [' + ",".join([feature] * n + ["x"] * broken + [feature] * n * broken) + "]}")
    reader = geojson_files._Reader(str(path))
    [part] = reader.partitions()
    tracemalloc.start()
    rows, errors = 0, set()
    for batch in reader.read(part):
        rows += batch.num_rows if hasattr(batch, "num_rows") else 1
        errors |= set(batch.column("error").to_pylist() if hasattr(batch, "num_rows") else batch[3:])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (rows, errors) == ((1, {"Invalid JSON"}) if broken else (n, {None}))
    assert peak < path.stat().st_size / 2


def test_large_values_go_to_several_files(tmp_path, monkeypatch):
    monkeypatch.setattr(geojson_files, "FILE_BYTES", 1000, raising=False)
    rows = [{"geojson": json.dumps({"type": "Feature", "n": n}), "kind": n // 300} for n in range(600)]
    writer = geojson_files._Writer(str(tmp_path), "kind", False)
    writer.commit([writer.write(iter(rows))])
    files = sorted(tmp_path.rglob("*.geojson"))
    assert len(files) > 10 and max(p.stat().st_size for p in files) < 1200
    found = [json.loads(text)["n"] for _, text, _ in _rows(tmp_path)]
    assert sorted(found) == list(range(600))
    assert all(json.loads(x)["n"] // 300 == int(p.parent.name.partition("=")[2]) for p in files for _, x, _ in _rows(p))
