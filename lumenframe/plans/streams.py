"""Queries that run a stream to its end and return what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.sources.scratch import scratch_root
from lumenframe.streaming.tracker import rolling_mean, track_stream


def drained(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run an append stream over all that is there now, into the shared scratch folder."""
    base = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("checkpointLocation", f"{base}-checkpoint").trigger(availableNow=True).start(base).awaitTermination()
    return spark.read.schema(stream.schema).parquet(base)


def _source(spark: SparkSession, d: str, table: str) -> DataFrame:
    """A table as a stream; the file source wants a folder, so single files are named by a glob."""
    return spark.readStream.schema(spark.read.parquet(f"{d}/{table}.parquet").schema).parquet(f"{d}/{table}.parque[t]")


def rolling_stream(spark, d):
    """Rolling means by a stream; equal to the batch window."""
    e = _source(spark, d, "events").select("user_id", "event_id", "value")
    out = drained(spark, rolling_mean(e, "user_id", "event_id", "value"), "rolling")
    return out.select("user_id", "event_id", F.round(F.col("mean") + 1e-9, 4).alias("mean"))


ROLLING = "SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS 9 PRECEDING) + 1e-9, 4) AS mean FROM events"


def windowed_stream(spark, d):
    """Counts by hour and type with a watermark; only closed hours are emitted, so the last is left out."""
    e = _source(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    w = e.withWatermark("ts", "10 seconds").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    out = drained(spark, w.select(F.col("w.start").cast("string").alias("start"), "event_type", "n"), "windowed")
    return out


WINDOWED = """WITH h AS (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, event_type, n FROM h WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 SECOND"""


def tracker_stream(spark, d):
    """Tracks of boxes drawn from events: a source for each type, a frame for each event."""
    e = _source(spark, d, "events")
    boxes = e.select(F.col("event_type").alias("source"), F.col("event_id").alias("frame"), ((F.col("user_id") * 3) % 50).cast("double").alias("x"), (F.col("event_id") % 30).cast("double").alias("y"), F.lit(60.0).alias("w"), F.lit(150.0).alias("h"))
    return drained(spark, track_stream(boxes), "tracks").groupBy("source", "state").agg(F.count("*").alias("n"))


QUERIES = {
    "rolling_stream": (rolling_stream, ROLLING),
    "windowed_stream": (windowed_stream, WINDOWED),
    "tracker_stream": (tracker_stream, None),
}
