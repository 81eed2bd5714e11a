"""Keyed state on streams over several micro-batches, resets, silence, and sinks that see a batch again."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lumenframe.streaming import brands
from lumenframe.streaming.admission import admitted
from lumenframe.streaming.latest import LatestTable, newest_frames
from lumenframe.streaming.tracker import track_stream

LOOKS = "event_id long, track long, ts timestamp, region string, brand string, sim double, ok boolean"
START = dt.datetime(2024, 1, 1)


def in_files(spark, folder, rows, schema, files):
    """rows in so many files, in order, and a stream that takes one at a time."""
    step = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * step : (i + 1) * step], schema).coalesce(1).write.parquet(f"{folder}/f{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/f*")


def run(spark, stream, folder):
    with brands.keyed_state(spark):
        stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}-checkpoint").trigger(availableNow=True).start(folder).awaitTermination()
    return spark.read.schema(stream.schema).parquet(folder)


def plain(rows, resets=()):
    """The states by a loop over rows in order."""
    pools, frozen, out = {}, {}, []
    for r in rows:
        for k in [k for k in pools if k[0] == r[1] and (r[0], r[1]) in resets]:
            pools.pop(k)
            frozen.pop(k, None)
        k = (r[1], r[3])
        pool = pools[k] = [*pools.get(k, []), r[4:]][-3:]
        good = [b for b, _, ok in pool if ok]
        if k in frozen:
            found = frozen[k]
        elif not good:
            found = ("BrandUnknown", "BrandUnknown", 0, r[5])
        else:
            best = max(good, key=lambda b: (good.count(b), -good.index(b)))
            found = ("BrandStable" if good.count(best) >= 2 else "BrandCandidate", best, good.count(best), max(s for b, s, ok in pool if ok and b == best))
            if found[0] == "BrandStable":
                frozen[k] = found
        out.append((r[0], r[1], r[3], *found))
    return sorted(out), frozen, pools


def looks(n=120):
    rng = random.Random(2)
    return [(i, rng.randrange(3), START + dt.timedelta(seconds=i), rng.choice(["Upper", "Shoes"]), rng.choice("xy"), rng.random(), rng.random() < 0.6) for i in range(n)]


def test_brands_over_batches(spark, tmp_path):
    """State outlives micro-batches, and the checkpoint holds what is frozen and the last looks."""
    rows = looks()
    stream = in_files(spark, f"{tmp_path}/in", rows, LOOKS, 4)
    got = run(spark, brands.brand_states(stream), f"{tmp_path}/out")
    want, frozen, pools = plain(rows)
    assert sorted(map(tuple, got.collect())) == want
    assert {((r.track, r.region), (r.state, r.brand, r.hits, r.similarity)) for r in brands.kept_state(spark, f"{tmp_path}/out-checkpoint").collect()} == set(frozen.items())
    kept = {}
    for r in brands.kept_looks(spark, f"{tmp_path}/out-checkpoint").collect():
        kept.setdefault((r.track, r.region), []).append((r.brand, r.similarity, r.ok))
    assert {k: sorted(v) for k, v in kept.items()} == {k: sorted(v) for k, v in pools.items()}


def test_reset_over_batches(spark, tmp_path):
    rows = looks()
    again = [(r[0], r[1], r[2]) for r in rows if r[0] % 17 == 4]
    stream = in_files(spark, f"{tmp_path}/in", rows, LOOKS, 1)
    control = in_files(spark, f"{tmp_path}/control", again, "event_id long, track long, ts timestamp", 1)
    got = run(spark, brands.brand_states(stream, control), f"{tmp_path}/out")
    assert sorted(map(tuple, got.collect())) == plain(rows, {(a, t) for a, t, _ in again})[0]


def test_silence_ends_state(spark, tmp_path):
    """A track that is silent for long starts anew, once the watermark has passed its end."""
    at = lambda i, t, s: (i, t, START + dt.timedelta(seconds=s), "Upper", "x", 0.9, True)
    rows = [at(0, 1, 0), at(1, 1, 1), at(2, 2, 500), at(3, 2, 501), at(4, 2, 900), at(5, 2, 901), at(6, 1, 1000), at(7, 2, 1001)]
    stream = in_files(spark, f"{tmp_path}/in", rows, LOOKS, 4).withWatermark("ts", "1 second")
    got = {r.event_id: r.state for r in run(spark, brands.brand_states(stream, silent_ms=60_000), f"{tmp_path}/out").collect()}
    assert got[1] == "BrandStable" and got[6] == "BrandCandidate" and set(got) == set(range(8))


def test_tracker_reset(spark, tmp_path):
    rows = [("s", f, 100.0 + f, 200.0, 80.0, 200.0, f == 6) for f in range(12)]
    stream = in_files(spark, f"{tmp_path}/in", rows, "source string, frame long, x double, y double, w double, h double, reset boolean", 3)
    got = [(r.frame, r.track_id, r.state) for r in run(spark, track_stream(stream), f"{tmp_path}/out").orderBy("frame").collect()]
    alone = [(r.frame, r.track_id, r.state) for r in run(spark, track_stream(in_files(spark, f"{tmp_path}/in2", rows[6:], "source string, frame long, x double, y double, w double, h double, reset boolean", 1)), f"{tmp_path}/out2").orderBy("frame").collect()]
    assert [x for x in got if x[0] >= 6] == alone and {x[0] for x in got} == set(range(12))


def test_sink_survives_a_failure(spark, tmp_path):
    """A batch whose first try fails behind the write is written again; the table is as if it had run once."""
    rows = [(i % 5, START + dt.timedelta(seconds=(i * 7) % 60), i, f"v{i}") for i in range(80)]
    schema = "k long, ts timestamp, id long, v string"
    stream, failed = in_files(spark, f"{tmp_path}/in", rows, schema, 4), []
    table = LatestTable(spark, f"{tmp_path}/table", ["k"], ["ts", "id"])

    def write(batch, number):
        table.write(batch, number)
        if number == 2 and not failed:
            failed.append(number)
            raise RuntimeError("lost")

    start = lambda: stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="lost"):
        start().awaitTermination()
    start().awaitTermination()
    want = sorted(max((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])) for k in range(5))
    assert failed == [2] and table.folders("batch") == [0, 1, 2, 3]
    assert sorted(map(tuple, table.read().select("k", "ts", "id", "v").collect())) == want
    table.compact()
    assert len(table.parts()) == 1 and sorted(map(tuple, table.read().select("k", "ts", "id", "v").collect())) == want
    table.write(spark.createDataFrame(rows[:20], schema), 0)  # a late replay of a folded batch changes nothing
    table.write(spark.createDataFrame([(0, START + dt.timedelta(hours=1), 99, "new")], schema), 4)
    assert table.read().where("k = 0").first().v == "new" and len(table.parts()) == 2


def test_newest_frames(spark, tmp_path):
    """Of each batch only the newest frame of a source is taken."""
    rows = [(f"s{i % 2}", i) for i in range(24)]
    stream = in_files(spark, f"{tmp_path}/in", rows, "source string, frame long", 3)
    table = LatestTable(spark, f"{tmp_path}/table", ["source"], ["frame"])
    stream.writeStream.foreachBatch(newest_frames(table, "source", ["frame"])).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.frame for r in table.read().collect()) == [22, 23]
    taken = spark.read.parquet(f"{tmp_path}/table/taken").groupBy("batch", "source").agg(F.max("frame").alias("f"), F.count("*").alias("n")).collect()
    assert len(taken) == 6 and all(r.n == 1 for r in taken) and sorted(r.f for r in taken) == [6, 7, 14, 15, 22, 23]


FRAMES = "source string, frame long, ts timestamp, latency double, number string"


def taken(rows, tick=100):
    """The frames that are taken, by a loop over rows in order."""
    flight, out = {}, []
    for source, frame, ts, latency, _ in rows:
        at = round((ts - START).total_seconds() * 1000)
        free, last, n, lost = flight.get(source, (at, -1, 0, 0))
        if at >= free and at // tick > last:
            out.append((source, frame, n + 1, lost))
            flight[source] = (at + max(int(latency or 0), 0), at // tick, n + 1, 0)
        else:
            flight[source] = (free, last, n, lost + 1)
    return sorted(out, key=str)


@pytest.mark.parametrize("files", [1, 5])
def test_busy_consumer(spark, tmp_path, files):
    """A frame in flight, or one of the same tick, keeps others out, also over micro-batches."""
    rng, at = random.Random(4), 0
    rows = []
    for i in range(200):
        at += rng.choice([0, 10, 40, 100, 250])
        rows.append((rng.choice(["a", "b", None]), i, START + dt.timedelta(milliseconds=at), rng.choice([None, -5.0, 0.0, 90.0, 400.0]), "n"))
    rows += [("c", i, START + dt.timedelta(milliseconds=at + 1), 0.0, "n") for i in (300, 301)]
    odd = [("a", 900, None, 1.0, "n"), ("b", None, START, 1.0, "n")]
    stream = in_files(spark, f"{tmp_path}/in", odd[:1] + rows + odd[1:], FRAMES, files)
    got = run(spark, admitted(stream), f"{tmp_path}/out")
    assert got.columns == ["source", "frame", "number", "dropped"]
    want = taken(rows)
    assert sorted(map(tuple, got.collect()), key=str) == want and 20 < len(want) < 150 and want[-1][1] != 301


def test_no_frames(spark, tmp_path):
    spark.createDataFrame([], FRAMES).write.parquet(f"{tmp_path}/in/f0")
    stream = spark.readStream.schema(FRAMES).parquet(f"{tmp_path}/in/f*")
    assert run(spark, admitted(stream), f"{tmp_path}/out").count() == 0
