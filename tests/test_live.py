"""Streams that build records and streams with expiring state, with restarts."""

import json

import pytest
from pyspark.sql import functions as F

from terraloom.streaming import live, streams

SCHEMA = "aoi_id long, width double, error string"


def _text(width):
    ring = [[0.0, 0.0], [width, 0.0], [width, 1.0], [0.0, 1.0], [0.0, 0.0]]
    return json.dumps({"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [ring]}})


def _build(aois):
    return aois.select("aoi_id", (F.col("box.maxx") - F.col("box.minx")).alias("width"), "error")


def _requests(spark, *rows):
    df = spark.createDataFrame([(r, t, a, _text(float(a)) if a < 90 else "{") for r, t, a in rows], "request_id string, t string, aoi_id long, geojson string")
    return df.select("request_id", F.col("t").cast("timestamp").alias("ts"), "aoi_id", "geojson").coalesce(1)


def test_unseen_areas_are_built_once_over_restarts(spark, tmp_path):
    source, store, out, state = (str(tmp_path / n) for n in ("in", "store", "out", "state"))
    first = _requests(spark, ("a", "2024-01-01 00:00:00", 1), ("b", "2024-01-01 00:01:00", 2), ("a", "2024-01-01 00:02:00", 1))
    second = _requests(spark, ("c", "2024-01-01 00:03:00", 2), ("d", "2024-01-01 00:04:00", 3), ("e", "2024-01-01 00:05:00", 95), ("b", "2024-01-01 00:05:30", 2))
    first.write.parquet(source)
    asked = spark.readStream.schema(first.schema).parquet(source)
    live.start_answers(asked, _build, store, out, state, SCHEMA).awaitTermination()
    assert {(r["request_id"], r["width"]) for r in spark.read.parquet(out).collect()} == {("a", 1.0), ("b", 2.0)}
    built = []

    def breaks(aois):
        built.append(sorted(r["aoi_id"] for r in aois.select("aoi_id").collect()))
        if len(built) == 1:
            raise RuntimeError("lost")
        return _build(aois)

    second.write.mode("append").parquet(source)
    with pytest.raises(Exception, match="lost"):
        live.start_answers(asked, breaks, store, out, state, SCHEMA).awaitTermination()
    live.start_answers(asked, breaks, store, out, state, SCHEMA).awaitTermination()
    assert built[:2] == [[3, 95], [3, 95]] and all(not b for b in built[2:])  # only areas that no batch had met
    rows = [(r["request_id"], r["width"], r["error"]) for r in spark.read.parquet(out).collect()]
    assert sorted(rows) == [("a", 1.0, None), ("b", 2.0, None), ("c", 2.0, None), ("d", 3.0, None), ("e", None, "Invalid JSON")]
    assert sorted(r["aoi_id"] for r in spark.read.parquet(store).collect()) == [1, 2, 3, 95]
    # A batch that was written whole but not marked as done runs again: the result stays.
    again = _requests(spark, ("c", "2024-01-01 00:03:00", 2), ("d", "2024-01-01 00:04:00", 3), ("e", "2024-01-01 00:05:00", 95))
    last = spark.read.parquet(out).agg(F.max(F.when(F.col("request_id") == "d", F.col("batch")))).first()[0]
    live.answer_batch(again, last, _build, store, out, SCHEMA)
    assert sorted((r["request_id"], r["width"], r["error"]) for r in spark.read.parquet(out).collect()) == sorted(rows)


EVENTS = "session_id long, action string, ts timestamp, event_id long, north double, south double, east double, west double"


def test_expired_sessions_leave_the_state(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")

    def put(*rows):
        df = spark.createDataFrame([(s, a, t, e, n, 1.0, 2.0, 3.0) for s, a, t, e, n in rows], EVENTS.replace("timestamp", "string"))
        df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKSDB)
    seen = []

    def run():
        events = spark.readStream.schema(EVENTS).parquet(source)
        query = live.latest_shape_with_ttl(events, 600).writeStream.foreachBatch(lambda df, i: seen.extend(df.collect())).outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        return query.lastProgress

    try:
        put((1, "created", "2024-01-01 00:00:00", 1, 5.0), (1, "edited", "2024-01-01 00:01:00", 2, 9.0), (2, "created", "2024-01-01 00:00:00", 3, 6.0), (2, "deleted", "2024-01-01 00:05:00", 4, 6.0), (3, "created", "2024-01-01 00:02:00", 5, 7.0))
        run()
        put((1, "created", "2024-01-01 00:04:30", 6, 4.0), (1, "created", "2024-01-01 00:04:10", 7, 8.0), (4, "created", "2024-01-01 00:13:30", 8, 1.5))
        run()
        put((4, "created", "2024-01-01 00:20:00", 9, 2.5))
        progress = run()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    last = {}
    for r in seen:  # expiry comes after the changes
        if not r["expired"]:
            last[r["session_id"]] = r
    batch = {r["session_id"]: r for r in streams.latest_shape(spark.read.parquet(source)).collect()}
    assert {k: (r["north"], r["is_empty"]) for k, r in last.items()} == {k: (r["north"], r["is_empty"]) for k, r in batch.items()}
    assert {r["session_id"] for r in seen if r["expired"]} == {1, 2, 3}
    assert len(seen) == len({(r["session_id"], r["event_id"], r["expired"]) for r in seen})
    assert progress is not None and sum(s.numRowsTotal for s in progress.stateOperators) <= 4  # session 4's value, its timer and the timer's index
