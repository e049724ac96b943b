"""Streams that build what they need, and streams whose state goes away by itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from terraloom.sources import geojson
from terraloom.sources.staging import stage
from terraloom.streaming.streams import BOX

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _earlier(spark, path: str, schema, batch_id: int) -> DataFrame:
    """The records of batches before batch_id; none yet if nothing was written."""
    found = spark.read.schema(f"{schema}, batch long").option("ignoreMissingFiles", "true")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], f"{schema}, batch long")
    return found.parquet(path).where(F.col("batch") < batch_id)


def _put(df: DataFrame, path: str, batch_id: int) -> None:
    """Write the rows of a batch; what an earlier attempt at the same batch wrote is replaced, other batches stay."""
    df.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def answer_batch(batch: DataFrame, batch_id: int, build: Callable[[DataFrame], DataFrame], store: str, out: str, schema: str) -> None:
    """Build the records of areas that no earlier batch has built, keep them in store, and write the answers of the batch to out.

    A batch that runs again (after a failure at any point) sees the records of earlier batches only and replaces its own, so it
    neither skips an area half built nor answers a request twice.
    """
    spark = batch.sparkSession
    asked = stage(batch)
    known = _earlier(spark, store, schema, batch_id).drop("batch")
    unseen = asked.join(known.select("aoi_id"), "aoi_id", "left_anti").groupBy("aoi_id").agg(F.min_by("geojson", F.struct("ts", "request_id")).alias("geojson"))
    built = stage(build(stage(geojson.aois_of(unseen))).select(*known.columns))
    _put(built, store, batch_id)
    _put(asked.select("request_id", "ts", "aoi_id").join(known.unionByName(built), "aoi_id", "left"), out, batch_id)


def start_answers(requests: DataFrame, build: Callable[[DataFrame], DataFrame], store: str, out: str, checkpoint: str, schema: str, delay: str = "1 hour", **trigger) -> StreamingQuery:
    """Answer a stream of requests (request_id, ts, aoi_id, geojson), whose areas need not be known before.

    build makes one record (of the schema, with aoi_id) for each area; it runs for areas that no batch has met. A request that is
    sent again within the delay is answered once. store and out are folders of Parquet, a partition for each batch.
    """
    once = requests.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["request_id"])
    run = lambda batch, batch_id: answer_batch(batch, batch_id, build, store, out, schema)
    return once.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


SHAPE = "session_id long, north double, south double, east double, west double, is_empty boolean, expired boolean, ts timestamp, event_id long"


class _Latest(StatefulProcessor):
    """One state per session: the last creation or deletion, and when it was. A timer frees it when the time to live is over."""

    def __init__(self, ttl_ms: int) -> None:
        self._ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", "at long, event_id long, north double, south double, east double, west double, deleted boolean")

    def _row(self, session: int, last: tuple, expired: bool) -> pd.DataFrame:
        at, event, *box, deleted = last
        values = [session, *([0.0] * 4 if deleted else box), bool(deleted), expired, pd.Timestamp(at, unit="us"), event]
        return pd.DataFrame([values], columns=["session_id", *BOX, "is_empty", "expired", "ts", "event_id"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = None
        for frame in rows:
            for r in frame.itertuples():
                here = (int(pd.Timestamp(r.ts).value // 1000), int(r.event_id), *(float(getattr(r, k)) for k in BOX), r.action == "deleted")
                found = here if found is None or here[:2] > found[:2] else found
        old = tuple(self._last.get()) if self._last.exists() else None
        if found is None or old is not None and old[:2] >= found[:2]:
            return  # late: a newer event has been seen
        self._last.update(found)
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        self._handle.registerTimer(found[0] // 1000 + self._ttl)
        yield self._row(key[0], found, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self._last.exists():
            last = tuple(self._last.get())
            self._last.clear()
            yield self._row(key[0], last, True)

    def close(self) -> None:
        pass


def latest_shape_with_ttl(events: DataFrame, ttl_seconds: int, delay: str = "1 minute") -> DataFrame:
    """latest_shape of a stream of drawing events, with state that is freed when a session has drawn nothing for the time to live.

    A row for each change of a session's box, and one with expired set when its state goes. Events older than one that was seen
    change nothing. The session must use the RocksDB state store (ROCKSDB).
    """
    changing = events.where(F.col("action").isin("created", "deleted")).withWatermark("ts", delay)
    state = _Latest(ttl_seconds * 1000)
    return changing.groupBy("session_id").transformWithStateInPandas(statefulProcessor=state, outputStructType=SHAPE, outputMode="Update", timeMode="EventTime")
