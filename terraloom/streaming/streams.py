"""Operators over event streams; each works on a static DataFrame as well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOX = ("north", "south", "east", "west")


def enrich_requests(requests: DataFrame, contexts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Requests (request_id, ts, aoi_id) with their precomputed records; a request that is sent again within the delay counts once."""
    if requests.isStreaming:
        once = requests.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["request_id"])
    else:
        once = requests.groupBy("request_id").agg(F.min_by(F.struct(*requests.columns), F.struct("ts", "aoi_id")).alias("first")).select("first.*")
    return once.join(contexts, "aoi_id", "left")


def latest_shape(events: DataFrame) -> DataFrame:
    """The box of each session (session_id, action, ts, event_id, box columns): that of its last creation, or zeros after a deletion.

    Edits leave the box as it is. Late events do no harm, as the newest by time and id wins; the state is one row per session.
    """
    changing = events.where(F.col("action").isin("created", "deleted"))
    box = F.struct(*(F.when(F.col("action") == "created", F.col(k)).otherwise(0.0).alias(k) for k in BOX))
    latest = changing.groupBy("session_id").agg(F.max_by(F.struct(box.alias("box"), "action"), F.struct("ts", "event_id")).alias("last"))
    return latest.select("session_id", *(F.col(f"last.box.{k}").alias(k) for k in BOX), (F.col("last.action") == "deleted").alias("is_empty"))


def debounce(events: DataFrame, gap: str = "300 milliseconds", delay: str = "1 minute") -> DataFrame:
    """The last event of each burst: session_id, fired_at, event_id, n_events. A burst ends when nothing comes for the gap."""
    if events.isStreaming:
        events = events.withWatermark("ts", delay)
    burst = events.groupBy("session_id", F.session_window("ts", gap).alias("burst"))
    out = burst.agg(F.max_by(F.struct("ts", "event_id"), F.struct("ts", "event_id")).alias("last"), F.count("*").alias("n_events"))
    return out.select("session_id", F.col("burst.end").alias("fired_at"), F.col("last.event_id").alias("event_id"), "n_events")
