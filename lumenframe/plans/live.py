"""Queries over keyed state on streams: brand states, resets, what a checkpoint holds, the newest row of each key, frames taken by a busy consumer."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumenframe.plans.brands import CALLED, OBSERVED, PASS, REGION, STATE, STATES
from lumenframe.plans.streams import _source
from lumenframe.sources.scratch import scratch_root
from lumenframe.streaming.admission import TICK_MS, admitted
from lumenframe.streaming.brands import OUTPUT, brand_states, kept_state, keyed_state
from lumenframe.streaming.latest import LatestTable


def _looks(spark, d):
    e = _source(spark, d, "events").selectExpr("event_id", "user_id AS track", "ts", f"{CALLED} AS called", "concat('B', cast(event_id * 7 % 3 AS string)) AS brand", "least(value / 100.0, 1.0) AS sim")
    return e.where("event_id % 17 <> 0").selectExpr("*", f"{REGION} AS region", f"sim >= {PASS} AS ok")


def _resets(spark, d):
    return _source(spark, d, "events").where("event_id % 23 = 5").selectExpr("event_id", "user_id AS track", "ts")


def _run(spark, stream, name):
    """Run a stream over all that is there; its folders of results and of the checkpoint."""
    base = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    with keyed_state(spark):
        stream.writeStream.format("parquet").option("checkpointLocation", f"{base}-checkpoint").trigger(availableNow=True).start(base).awaitTermination()
    return base, f"{base}-checkpoint"


def _results(spark, stream, name):
    return spark.read.schema(OUTPUT).parquet(_run(spark, stream, name)[0]).withColumn("similarity", F.round("similarity", 4))


def brand_stream(spark, d):
    """Brand states by keyed state on a stream; the rows of the batch query."""
    return _results(spark, brand_states(_looks(spark, d)), "brands")


def brand_reset_stream(spark, d):
    """The same with a control stream that resets tracks: states begin anew behind each reset."""
    return _results(spark, brand_states(_looks(spark, d), _resets(spark, d)), "brand-resets")


#: Segments between resets take the place of tracks.
SEGMENTS = OBSERVED.replace(
    "SELECT event_id, user_id AS track,", "SELECT event_id, user_id * 1000000 + count(*) FILTER (WHERE event_id % 23 = 5) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS track,"
)
RESET = f"WITH {STATES.replace(OBSERVED, SEGMENTS)} SELECT event_id, track // 1000000 AS track, region, state, brand, hits, round(similarity, 4) AS similarity FROM z"


def frozen_brands(spark, d):
    """The frozen brands as the stream's checkpoint holds them, read as a table."""
    _, checkpoint = _run(spark, brand_states(_looks(spark, d)), "frozen")
    return kept_state(spark, checkpoint).select("track", "region", "state", "brand", "hits", F.round("similarity", 4).alias("similarity"))


FROZEN = f"""WITH {STATES}, last AS (SELECT *, row_number() OVER (PARTITION BY track, region ORDER BY ts DESC, event_id DESC) AS k FROM z)
SELECT track, region, state, brand, hits, round(similarity, 4) AS similarity FROM last WHERE k = 1 AND state = 'BrandStable'"""


def latest_sink(spark, d):
    """The newest event of each user by a sink to which every batch is written twice, as after a failure."""
    table = LatestTable(spark, f"{scratch_root(spark)}/latest-{uuid.uuid4().hex}", ["user_id"], ["ts", "event_id"])

    def twice(batch, number):
        table.write(batch, number)
        table.write(batch, number)

    e = _source(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    e.writeStream.foreachBatch(twice).option("checkpointLocation", f"{table.path}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    table.compact()
    return table.read().select("user_id", "event_id", "event_type", F.round("value", 4).alias("value"))


LATEST = "SELECT user_id, event_id, event_type, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1"



def frame_admission(spark, d):
    """The frames that a busy consumer takes: a source for each user, a frame for each event, value * 1,000 seconds of work."""
    e = _source(spark, d, "events").select(F.col("user_id").alias("source"), F.col("event_id").alias("frame"), "ts", F.floor(F.col("value") * 1_000_000).alias("latency"))
    stream = admitted(e)
    return spark.read.schema(stream.schema).parquet(_run(spark, stream, "admitted")[0])


ADMITTED = f"""WITH RECURSIVE e AS (SELECT user_id AS source, event_id AS frame, epoch_ms(ts) AS ms, greatest(coalesce(CAST(floor(value * 1000000) AS BIGINT), 0), 0) AS latency,
 row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS k FROM events WHERE ts IS NOT NULL),
w AS (SELECT source, frame, k, TRUE AS taken, ms + latency AS free, ms // {TICK_MS} AS tick FROM e WHERE k = 1
 UNION ALL SELECT source, frame, k, taken, CASE WHEN taken THEN ms + latency ELSE free END, CASE WHEN taken THEN ms // {TICK_MS} ELSE tick END
 FROM (SELECT e.*, w.free, w.tick, e.ms >= w.free AND e.ms // {TICK_MS} > w.tick AS taken FROM w JOIN e ON e.source IS NOT DISTINCT FROM w.source AND e.k = w.k + 1))
SELECT source, frame, row_number() OVER (PARTITION BY source ORDER BY k) AS number, k - coalesce(lag(k) OVER (PARTITION BY source ORDER BY k), 0) - 1 AS dropped FROM w WHERE taken"""

QUERIES = {
    "brand_stream": (brand_stream, STATE),
    "brand_reset_stream": (brand_reset_stream, RESET),
    "frozen_brands": (frozen_brands, FROZEN),
    "latest_sink": (latest_sink, LATEST),
    "frame_admission": (frame_admission, ADMITTED),
}
