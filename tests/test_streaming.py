"""Streams of files: windows with a watermark, the append log, and the limiter's state across batches."""

import datetime

from pyspark.sql import functions as F

from lexmill.streaming import streams

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def events(spark, first, n, step):
    begin = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, begin + datetime.timedelta(seconds=step * i), 1, "view", 1.0) for i in range(first, first + n)], SCHEMA)


def test_watermark_closes_windows(spark, tmp_path):
    events(spark, 0, 240, 60).write.parquet(str(tmp_path / "events"))
    found = streams.run_available(spark, str(tmp_path / "events") + "/", events(spark, 0, 1, 1).schema)
    assert found.count() >= 3 and {r["n"] for r in found.collect()} == {60}


def test_windows_agree_with_batch(spark):
    rows = events(spark, 0, 240, 60)
    assert {r["n"] for r in streams.windowed(rows, "1 hour").collect()} == {60}
    assert streams.windowed(rows, "1 hour", "30 minutes").agg(F.sum("n")).first()[0] == 480


def test_append_log_goes_on(spark, tmp_path):
    source, log, state = (str(tmp_path / x) for x in ("in", "log", "state"))
    for k in range(2):
        events(spark, 10 * k, 10, 1).write.mode("append").parquet(source)
        streams.append_stream(streams.read_events(spark, source, events(spark, 0, 1, 1).schema), log, state).awaitTermination()
    assert spark.read.json(log).count() == 20


def test_limiter_keeps_its_state(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for k in range(2):  # 30 events of three seconds each time: 40 in the hour pass
        events(spark, 30 * k, 30, 3).write.mode("append").parquet(source)
        stream = streams.rate_limited_stream(streams.read_events(spark, source, events(spark, 0, 1, 1).schema).select("user_id", "ts", "event_id"))
        query = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
    found = spark.read.schema("user_id long, event_id long, admitted boolean").parquet(out)
    batch = streams.rate_limited(events(spark, 0, 60, 3).select("user_id", "ts", "event_id"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, batch.collect()))
    assert found.filter("admitted").count() == 40
