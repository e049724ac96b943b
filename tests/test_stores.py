"""Tables that are kept: contexts, scenes, states; and nearest pixels."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.operators import catalog, rollup
from terraloom.sources import context_store, rasters, scene_table, staging


def test_writing_an_area_again_replaces_its_record_only(spark, tmp_path):
    path = str(tmp_path / "contexts")
    make = lambda rows: spark.createDataFrame(rows, "aoi_id long, dem struct<mean:double>")
    context_store.put(make([(i, (float(i),)) for i in range(100)]), path, buckets=8)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "contexts").rglob("*.parquet")}
    changed = make([(5, (50.0,)), (5, (50.0,)), (777, (7.0,)), (None, (1.0,))])
    for _ in range(2):
        context_store.put(changed, path, buckets=8)
    schema = changed.schema
    rows = [(r["aoi_id"], r["dem"]["mean"]) for r in context_store.get(spark, path, schema).collect()]
    assert sorted(rows) == sorted([(i, 50.0 if i == 5 else float(i)) for i in range(100)] + [(777, 7.0)])
    kept = [p for p, at in files.items() if p.exists() and p.stat().st_mtime_ns == at]
    assert len(kept) >= 6 * len(files) // 8  # folders of other areas were left alone
    some = context_store.get(spark, path, schema, ids=[5, 777, 12345], buckets=8)
    assert sorted(r["aoi_id"] for r in some.collect()) == [5, 777]
    assert "PartitionFilters: [bucket" in some._jdf.queryExecution().toString()


SCENES = "scene_id long, collection string, dt timestamp, cloud_cover double, minx double, miny double, maxx double, maxy double"


@pytest.fixture(scope="module")
def scenes(spark):
    rng = np.random.default_rng(8)
    n = 600
    w = np.where(rng.random(n) < 0.05, 25.0, rng.uniform(0.1, 3, n))
    x, y = rng.uniform(-180, 150, n), rng.uniform(-90, 60, n)
    rows = [(i, "s2" if i % 3 else "other", "2024-05-01 00:00:00", float(i % 50), float(x[i]), float(y[i]), float(x[i] + w[i]), float(y[i] + w[i])) for i in range(n)]
    return spark.createDataFrame(rows, SCENES.replace("timestamp", "string")).withColumn("dt", F.col("dt").cast("timestamp"))


def test_a_search_reads_the_folders_of_its_areas_only(spark, scenes, tmp_path):
    path = str(tmp_path / "scenes")
    scene_table.write_scenes(scenes, path)
    table = scene_table.read_scenes(spark, path, scenes.schema)
    assert table.count() == scenes.count()
    box = "minx double, miny double, maxx double, maxy double"
    spots = [(1, 2.0, -9.0, 18.0, 16.0), (2, -88.0, -38.0, -62.0, -22.0)]
    a = spark.createDataFrame(spots, f"aoi_id long, {box}").select("aoi_id", F.struct("minx", "miny", "maxx", "maxy").alias("box"))
    found = scene_table.search_table(a, table, "s2", "2024-06-29", max_cloud=40.0)
    rows = sorted((r["aoi_id"], r["scene_id"]) for r in found.collect())
    want = sorted((r["aoi_id"], r["scene_id"]) for r in catalog.search_scenes(a, scenes, "s2", "2024-06-29", max_cloud=40.0).collect())
    assert rows == want and len(rows) > 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "PartitionFilters" in plan
    folders = {tuple(r) for r in table.where("collection = 's2'").select("reach", "tile_x", "tile_y").distinct().collect()}
    wanted = {tuple(r) for r in scene_table.reachable(a, table).collect()}
    assert len(folders & wanted) < len(folders) / 3  # the others are pruned


def test_states_merge_to_what_all_values_give(spark):
    rng = np.random.default_rng(6)
    rows = [(int(a), float(1e9 + rng.normal())) for a in rng.integers(0, 12, 900)] + [(3, None), (99, None)]
    df = spark.createDataFrame(rows, "aoi_id int, v double").repartition(5)
    found = rollup.states(df, ["aoi_id"], "v").withColumn("region", F.col("aoi_id") % 4)
    for r in rollup.rollup(found, ["region", "aoi_id"]).collect():
        own = np.array([v for a, v in rows if v is not None and (r["aoi_id"] is None or a == r["aoi_id"]) and (r["region"] is None or a % 4 == r["region"])])
        assert (r["n"], r["min"], r["max"]) == (len(own), own.min(), own.max())
        assert r["mean"] == pytest.approx(own.mean(), rel=1e-15) and r["std"] == pytest.approx(own.std(), rel=1e-6)
    assert rollup.rollup(found.limit(0), ["region", "aoi_id"]).count() == 0


@pytest.mark.parametrize("bucket", [0.05, 0.3, 2.0])
def test_nearest_equals_brute_force(spark, bucket):
    rng = np.random.default_rng(9)
    points = rng.uniform(0, 2, (150, 2))
    px = spark.createDataFrame([(i, i % 7, float(x), float(y), i * 10) for i, (x, y) in enumerate(points)] + [(999, 0, 1.0, 1.0, None)], "r int, c int, lon double, lat double, v int")
    targets = rasters.grid_cells(spark, -0.4, 2.4, 0.19, 15, 15)
    found = {(r["row"], r["col"]): r["v"] for r in rasters.nearest(targets, px, "v", 0.25, bucket).collect()}
    assert len(found) == 225 and None in found.values()
    for t in targets.collect():
        far = np.hypot(points[:, 0] - t["x"], points[:, 1] - t["y"])
        assert found[t["row"], t["col"]] == (int(far.argmin()) * 10 if far.min() <= 0.25 else None)


def test_a_cluster_has_to_name_the_shared_folder():
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_folder(SimpleNamespace(conf={}, sparkContext=context))
    context.getCheckpointDir = lambda: "hdfs://store/checkpoints/"
    assert staging.shared_folder(SimpleNamespace(conf={}, sparkContext=context)) == "hdfs://store/checkpoints"
