"""Structured Streaming: windows, watermarks, append logs and a stateful rate limiter. Functions over frames work on batch
and on streams alike."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from lexmill.session import shared_path

SPACING_SECONDS = 2.0
PER_HOUR = 40
HOUR = 3600.0


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """start, event_type, n, total per tumbling or sliding window; `late` sets a watermark."""
    if late:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def read_events(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def run_available(spark: SparkSession, path: str, schema: StructType, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """All windows that a watermark has closed once the available files are read; sink and state are in the shared folder."""
    out, state = shared_path(spark, "windows"), shared_path(spark, "windows-state")
    glob = path if path.endswith("/") else path + "*"
    stream = windowed(spark.readStream.schema(schema).parquet(glob), size, late=late)
    query = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def append_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """An append-only log of JSON lines fed by a stream; restarts go on from the checkpoint."""
    return stream.writeStream.outputMode("append").format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _admit(times: list[float], state: tuple[float, float, int]) -> tuple[list[bool], tuple[float, float, int]]:
    """Decisions for times in order. state: last admitted, start of the hour, admitted in it."""
    last, hour, n = state
    out = []
    for t in times:
        if t - last < SPACING_SECONDS:
            out.append(False)
            continue
        if t - hour > HOUR:
            hour, n = t, 0
        ok = n < PER_HOUR
        out.append(ok)
        if ok:
            last, n = t, n + 1
    return out, (last, hour, n)


def rate_limited(events: DataFrame) -> DataFrame:
    """user_id, event_id, admitted over a batch: decisions depend on those before, so a user's events are one ordered
    group."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts", "event_id"])
        ok, _ = _admit([t.timestamp() for t in rows["ts"]], (-1e18, -1e18, 0))
        return pd.DataFrame({"user_id": rows["user_id"], "event_id": rows["event_id"], "admitted": ok})

    return events.groupBy("user_id").applyInPandas(run, "user_id long, event_id long, admitted boolean")


def rate_limited_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The same over a stream, with state per user that expires two hours of event time after the user's last event."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get if state.exists else (-1e18, -1e18, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        ok, now = _admit([t.timestamp() for t in rows["ts"]], now)
        state.update(now)
        last = max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs())
        state.setTimeoutTimestamp(last + int(2 * HOUR * 1000))
        yield pd.DataFrame({"user_id": rows["user_id"], "event_id": rows["event_id"], "admitted": ok})

    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(
        run, "user_id long, event_id long, admitted boolean", "last double, hour double, n long", "append", GroupStateTimeout.EventTimeTimeout
    )
