"""Back-pressure on a stream of frames: while a source's frame is at work, the frames that come are dropped.

A frame is taken if its source's last taken frame is done (its time plus its latency) and the tick of the clock is a later one.
So a slow consumer has one frame of a source in flight, and the frame that it takes next is the first one after it is done. The
trigger bounds how many rows of a source a micro-batch has; the state of a source is four numbers, whatever came before.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Fixed value: milliseconds between two ticks at which a frame may be taken.
TICK_MS = 100


class Admission(StatefulProcessor):
    """When a source is free again, the last tick it used, and how many frames were taken, and dropped since the last one."""

    def __init__(self, tick_ms: int):
        self.tick_ms = tick_ms

    def init(self, handle) -> None:
        self.state = handle.getValueState("flight", "free long, tick long, taken long, dropped long")

    def handleInputRows(self, key, rows, timerValues):
        free, tick, taken, dropped = (int(x) for x in self.state.get()) if self.state.exists() else (None, None, 0, 0)
        out = []
        for r in pd.concat(list(rows)).sort_values(["at", "frame"], kind="stable").itertuples(index=False):
            at = int(r.at)
            if free is not None and (at < free or at // self.tick_ms <= tick):
                dropped += 1
                continue
            taken += 1
            out.append((key[0], int(r.frame), taken, dropped))
            free, tick, dropped = at + int(r.latency), at // self.tick_ms, 0
        self.state.update((free, tick, taken, dropped))
        yield pd.DataFrame(out, columns=["source", "frame", "number", "dropped"])

    def close(self) -> None:
        pass


def admitted(frames: DataFrame, tick_ms: int = TICK_MS) -> DataFrame:
    """(source, frame, number, dropped) of the frames that are taken from a stream (source, frame, ts, latency in milliseconds).

    number counts a source's taken frames from 1; dropped is how many were passed over since the one before. Frames are taken in the
    order of ts and frame within a micro-batch. Frames without ts or number are passed over and not counted; no or a negative
    latency is none; a null source is a source of its own. Must be started inside ``keyed_state``.
    """
    kind = frames.schema["source"].dataType.simpleString()
    rows = frames.where("ts IS NOT NULL AND frame IS NOT NULL").select(
        "source", F.col("frame").cast("long").alias("frame"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.greatest(F.coalesce(F.col("latency").cast("long"), F.lit(0)), F.lit(0)).alias("latency")
    )
    return rows.groupBy("source").transformWithStateInPandas(Admission(tick_ms), f"source {kind}, frame long, number long, dropped long", "Append", "None")
