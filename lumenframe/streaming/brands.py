"""Brand states of tracks on a stream, with keyed state, a freeze, resets and an end by silence."""

from __future__ import annotations

from collections import Counter, defaultdict
from contextlib import contextmanager
from datetime import timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Observations of a pool, passes that make a brand stable.
POOL, STABLE = 3, 2
UNKNOWN = "BrandUnknown"
RESULT = "state string, brand string, hits long, similarity double"
OUTPUT = f"event_id long, track long, region string, {RESULT}"
#: What a row of a track is; each column of it is a cell that Python has to take up.
FAILED, PASSED, RESET = 0, 1, 2
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries that are started inside keep their state in RocksDB, which list and map states need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def _micros(looks: DataFrame, ts: str = "ts"):
    """Microseconds of a time with or without a zone: a number that is cheap to hand over and to sort by."""
    plain = dict(looks.dtypes)[ts] == "timestamp_ntz"
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})" if plain else f"unix_micros({ts})")


def _place(r: Row) -> tuple:
    """Order of a track's rows: by time, nulls last, then event_id; a reset is ahead of a look."""
    return (r.at is None, r.at or 0, r.event_id, -r.what)


def judged(pool: list[tuple], similarity: float) -> tuple[str, str, int, float]:
    """State, brand, hits and similarity of the last looks (brand, similarity, ok); ties go to the brand that was first."""
    hits = Counter(brand for brand, _, ok in pool if ok)
    if not hits:
        return UNKNOWN, UNKNOWN, 0, similarity
    brand, n = hits.most_common(1)[0]
    return "BrandStable" if n >= STABLE else "BrandCandidate", brand, n, max(s for b, s, ok in pool if ok and b == brand)


class BrandStates(StatefulProcessor):
    """The last looks at each region of a track in a list state, and each region's frozen result in another; each is asked for and written once for a track of a micro-batch.

    Rows of a track are taken in the order of (ts, event_id) within a micro-batch; the trigger bounds how many there are. A row
    with reset clears the track's state before the rows that follow it; so does silence for longer than silent_ms of event time.
    """

    def __init__(self, silent_ms: int | None = None):
        self.silent_ms = silent_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "region string, brand string, similarity double, ok boolean")
        self.frozen = handle.getListState("frozen", f"region string, {RESULT}")

    def handleInputRows(self, key, rows, timerValues):
        pools, frozen = defaultdict(list), {}
        for region, *look in self.recent.get():
            pools[region].append(tuple(look))
        for region, *found in self.frozen.get():
            frozen[region] = tuple(found)
        batch, kept, fresh = sorted(rows, key=_place), bool(frozen), {}
        for r in batch:
            if r.what == RESET:
                pools.clear()
                fresh, frozen = {}, {}
                if kept:
                    self.frozen.clear()
                    kept = False
                continue
            pool = pools[r.region]
            pool.append((r.brand, r.sim, r.what == PASSED))
            del pool[:-POOL]
            found = frozen.get(r.region)
            if found is None:
                found = judged(pool, r.sim)
                if found[0] == "BrandStable":
                    fresh[r.region] = frozen[r.region] = found
            yield Row(event_id=r.event_id, track=key[0], region=r.region, state=found[0], brand=found[1], hits=found[2], similarity=found[3])
        if fresh:
            self.frozen.appendList([(region, *found) for region, found in fresh.items()])
        if looks := [(region, *look) for region, pool in pools.items() for look in pool]:
            self.recent.put(looks)
        else:
            self.recent.clear()
        if self.silent_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            last = max((r.at for r in batch if r.at is not None), default=0) // 1000
            self.handle.registerTimer(max(last + self.silent_ms, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.recent.clear()
        self.frozen.clear()
        yield from ()

    def close(self) -> None:
        pass


def brand_states(looks: DataFrame, resets: DataFrame | None = None, silent_ms: int | None = None) -> DataFrame:
    """The state of a region after each look of a stream (event_id, track, ts, region, brand, sim, ok).

    resets is a control stream (event_id, track, ts): its rows clear the track's state, ahead of a look of the same ts and event_id.
    With silent_ms, ts must be under a watermark, and the state of a track ends that long after its last row.
    """
    own = ["event_id", "track"] if silent_ms is None else ["event_id", "track", "ts"]  # the watermark goes with ts
    rows = looks.select(*own, _micros(looks).alias("at"), "region", "brand", "sim", F.when(F.col("ok"), PASSED).otherwise(FAILED).alias("what"))
    if resets is not None:
        nothing = {"region": "string", "brand": "string", "sim": "double"}
        rows = rows.union(resets.select(*own, _micros(resets).alias("at"), *[F.lit(None).cast(kind).alias(c) for c, kind in nothing.items()], F.lit(RESET).alias("what")))
    return rows.groupBy("track").transformWithState(BrandStates(silent_ms), OUTPUT, "Append", "None" if silent_ms is None else "EventTime")


def _kept(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    read = spark.read.format("statestore").option("stateVarName", variable).option("flattenCollectionTypes", "true").load(checkpoint)
    return read.select("key.*", "list_element.*")


def kept_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The frozen results that a query's checkpoint holds, a row for each region of a track."""
    return _kept(spark, checkpoint, "frozen")


def kept_looks(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The last looks that a query's checkpoint holds, a row each."""
    return _kept(spark, checkpoint, "recent")
