"""The cover of areas by cells, and joins on it, against brute force."""

import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terraloom.functions import geometry
from terraloom.operators import catalog, clip, cover
from terraloom.sources import geojson, staging

STAR = 100_000


def star(n, radius=4.0, x=10.0, y=5.0):
    turn = [2 * math.pi * i / n for i in range(n)]
    ring = [[x + (radius + 0.8 * math.sin(40 * t)) * math.cos(t), y + (radius + 0.8 * math.sin(40 * t)) * math.sin(t)] for t in turn]
    return [*ring, ring[0]]


HOLE = [[9.3, 4.1], [9.3, 6.2], [11.05, 6.2], [11.05, 4.1], [9.3, 4.1]]


def area(spark, *shapes):
    texts = [(i, json.dumps({"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": rings}})) for i, rings in enumerate(shapes)]
    return staging.stage(geojson.aois_of(spark.createDataFrame(texts, "aoi_id long, geojson string")))


def edges_of(rings):
    return np.array([[*a, *b] for ring in rings for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)])


def inside(rings, x, y):
    """Even-odd rule in numpy, edge by edge."""
    x1, y1, x2, y2 = edges_of(rings).T
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.array([(((y1 > b) != (y2 > b)) & (a < (x2 - x1) * (b - y1) / (y2 - y1) + x1)).sum() % 2 == 1 for a, b in zip(x, y, strict=True)])


@pytest.fixture(scope="module")
def large(spark):
    a = area(spark, [star(STAR), HOLE])
    return a, cover.cover(a, staged=True)


def test_an_outline_of_many_vertices_equals_brute_force(spark, large):
    a, cells = large
    rng = np.random.default_rng(3)
    points = rng.uniform([5.0, 0.0], [15.0, 10.0], (800, 2)).tolist()
    points += [[9.3, 5.0], [9.3 + 1e-12, 5.0], [11.05, 4.1], [10.0, 6.2], [10.0, 5.0], [8.0, 5.0]]  # on the hole's edges, and off them
    px = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id long, lon double, lat double").repartition(5)
    got = {r["id"] for r in clip.clip(px, a, cells=cells).collect()}
    x, y = np.array(points).T
    assert got == set(np.flatnonzero(inside([star(STAR), HOLE], x, y)).tolist())


def test_cells_hold_their_own_edges_only(large):
    _, cells = large
    rows = cells.cells.where(~F.col("whole")).select("level", F.size("edges").alias("n"), "cell_x", "cell_y", "edges").collect()
    assert {r["level"] for r in rows} == {0} and max(r["n"] for r in rows) < STAR / 200
    for r in rows[:40]:
        w, s = r["cell_x"] * cover.CELL - 1e-6, r["cell_y"] * cover.CELL - 1e-6
        for e in r["edges"]:
            assert min(e["x1"], e["x2"]) <= w + cover.CELL + 2e-6 and max(e["x1"], e["x2"]) >= w and min(e["y1"], e["y2"]) <= s + cover.CELL + 2e-6 and max(e["y1"], e["y2"]) >= s


def test_cells_do_not_overlap_and_grow_with_the_outline(spark):
    shapes = [[[[0.0, 0.0], [k, 0.0], [k, k], [0.0, k], [0.0, 0.0]]] for k in (2.5, 5.0, 10.0)]
    cells = cover.cover(area(spark, *(s[0:1] for s in shapes)), staged=True)
    rows = cells.cells.collect()
    n = {i: sum(r["aoi_id"] == i for r in rows) for i in range(3)}
    assert 1.6 < n[1] / n[0] < 2.6 and 1.6 < n[2] / n[1] < 2.6 and n[2] < 5_000  # 40,000 cells of one size
    fine = [(r["aoi_id"], x, y) for r in rows if r["aoi_id"] == 0 for x in range(r["cell_x"] * 4 ** r["level"], (r["cell_x"] + 1) * 4 ** r["level"]) for y in range(r["cell_y"] * 4 ** r["level"], (r["cell_y"] + 1) * 4 ** r["level"])]
    assert len(fine) == len(set(fine)) and len(fine) >= 50 * 50


@pytest.mark.parametrize("cell", [0.05, 0.3, 7.0])
def test_touched_pixels_in_all_cell_sizes(spark, cell):
    rings = [[[0.0, 0.0], [1.0, 0.0], [1.0, 0.5], [0.5, 0.5], [0.5, 1.0], [0.0, 1.0], [0.0, 0.0]]]
    px = spark.range(400).select("id", ((F.col("id") % 20 - 4) * 0.1 + 0.03).alias("lon"), (F.floor(F.col("id") / 20) * 0.1 - 0.37).alias("lat"))
    a = area(spark, rings)
    got = {r["id"] for r in clip.clip(px, a, "touched", 0.1, cell).collect()}
    plain = geometry.point_inside(F.col("edges"), F.col("lon"), F.col("lat")) | geometry.edges_meet_box(F.col("edges"), F.col("lon") - 0.05, F.col("lat") - 0.05, F.col("lon") + 0.05, F.col("lat") + 0.05)
    assert got == {r["id"] for r in px.crossJoin(a).where(plain).collect()} and got


def test_a_ring_that_is_not_closed_is_closed(spark):
    open_, closed = [[[0.0, 0.0], [1.0, 0.0], [0.0, 1.0]]], [[[0.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 0.0]]]
    rows = area(spark, open_, closed).collect()
    assert rows[0]["edges"] == rows[1]["edges"] and len(rows[0]["edges"]) == 3


def test_covers_of_nothing_and_of_too_small_margins(spark):
    none = geojson.aois_of(spark.createDataFrame([(1, "{")], "aoi_id long, geojson string"))
    px = spark.createDataFrame([(0.5, 0.5)], "lon double, lat double")
    assert clip.clip(px, none).count() == 0
    with pytest.raises(ValueError, match="margin"):
        clip.clip(px, none, "touched", 0.1, cells=cover.cover(none))


numbers = st.floats(-3, 3, allow_nan=False).map(lambda v: round(v * 4) / 4)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(numbers, numbers), min_size=3, max_size=9))
def test_grid_aligned_shapes_equal_the_plain_rule(spark, ring):
    """Vertices on the lines of the cells and on the points themselves, crossing edges included."""
    rings = [[list(p) for p in ring]]
    steps = np.arange(-3.25, 3.3, 0.25)
    points = [(float(a), float(b)) for a in steps for b in steps]
    px = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id long, lon double, lat double").coalesce(2)
    got = {r["id"] for r in clip.clip(px, area(spark, rings), cell=0.25).collect()}
    x, y = np.array(points).T
    assert got == set(np.flatnonzero(inside(rings, x, y)).tolist())


def test_boxes_of_all_sizes_meet(spark):
    rng = np.random.default_rng(2)

    def boxes(n):
        w = 10.0 ** rng.uniform(-3, 2.3, n)
        x, y = rng.uniform(-180, 180, n), rng.uniform(-90, 90, n)
        return [(i, float(x[i] - w[i]), float(y[i] - w[i] / 2), float(x[i] + w[i]), float(y[i] + w[i] / 2)) for i in range(n)]

    ours, theirs = boxes(120), [*boxes(200), (900, -180.0, -90.0, 180.0, 90.0), (901, 0.0, 0.0, 0.0, 0.0)]
    box = "minx double, miny double, maxx double, maxy double"
    a = spark.createDataFrame(ours, f"aoi_id long, {box}").select("aoi_id", F.struct("minx", "miny", "maxx", "maxy").alias("box"))
    found = [(r["aoi_id"], r["scene_id"]) for r in catalog.covering(a, spark.createDataFrame(theirs, f"scene_id long, {box}")).collect()]
    want = [(p[0], q[0]) for p in ours for q in theirs if p[1] <= q[3] and p[3] >= q[1] and p[2] <= q[4] and p[4] >= q[2]]
    assert sorted(found) == sorted(want) and len(want) > 200


def test_a_global_box_has_few_keys(spark):
    b = spark.createDataFrame([(-180.0, -90.0, 180.0, 90.0)], "minx double, miny double, maxx double, maxy double")
    own = F.col("__own")
    assert catalog._keyed(b, "", catalog.CELL, {"scene": F.array(own)}).count() <= 4
    assert catalog._keyed(b.select(F.lit(0.1).alias("minx"), F.lit(0.1).alias("miny"), F.lit(0.2).alias("maxx"), F.lit(0.2).alias("maxy")), "", catalog.CELL, {"scene": F.sequence(own, F.lit(catalog.LEVELS))}).count() == catalog.LEVELS + 1
