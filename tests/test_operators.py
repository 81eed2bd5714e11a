"""Operators on small literal inputs, and against brute force."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import geometry as G
from lumenframe.functions import text as T
from lumenframe.functions import vector as V
from lumenframe.operators import assign, metrics, votes
from lumenframe.sources import tables
from lumenframe.streaming.tracker import Motion, Options, Tracker, latest_state, track_stream


def box(*v):
    return G.box(*map(F.lit, v))


@pytest.mark.parametrize("a,b,want", [((0, 0, 10, 10), (5, 0, 10, 10), 1 / 3), ((0, 0, 1, 1), (5, 5, 1, 1), 0.0), ((0, 0, 0, 0), (0, 0, 0, 0), 0.0)])
def test_iou(spark, a, b, want):
    assert spark.range(1).select(G.iou(box(*a), box(*b))).first()[0] == pytest.approx(want)


def test_vector_functions(spark):
    v = F.array(F.lit(3.0), F.lit(4.0))
    row = spark.range(1).select(V.l2_normalize(v).alias("n"), V.softmax(v).alias("s"), V.cosine(v, v).alias("c"), V.l2_normalize(F.array(F.lit(0.0))).alias("z")).first()
    assert row.n == pytest.approx([0.6, 0.8]) and sum(row.s) == pytest.approx(1) and row.c == pytest.approx(1) and row.z == [0.0]


def test_text_functions(spark):
    row = spark.range(1).select(T.clean_prediction(F.lit("Male (92%)")).alias("a"), T.clean_prediction(F.lit(None).cast("string")).alias("b"), T.clock(F.lit(3725.99)).alias("c")).first()
    assert tuple(row) == ("Male", "Unknown", "02:05.9")


def brute_nms(boxes, scores, t):
    keep = []
    for i in sorted(range(len(scores)), key=lambda i: (-scores[i], i)):
        if all(assign.iou_matrix(boxes[i : i + 1], boxes[k : k + 1])[0, 0] <= t for k in keep):
            keep.append(i)
    return sorted(keep)


@pytest.mark.parametrize("seed", range(5))
def test_suppression_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    boxes, scores = rng.integers(1, 60, (30, 4)).astype(float), rng.integers(0, 8, 30) / 8
    assert np.flatnonzero(assign.suppressed(boxes, scores, 0.3)).tolist() == brute_nms(boxes, scores, 0.3)


def test_greedy_assignment(spark):
    rows = spark.createDataFrame([(1, 1, 1, 0.9), (1, 1, 2, 0.8), (1, 2, 1, 0.85), (1, 2, 2, 0.1), (2, 1, 1, 0.5)], "frame int, track int, det int, score double")
    got = {tuple(r) for r in assign.greedy_assign(rows, ["frame"], "track", "det", "score").collect()}
    assert got == {(1, 1, 1, 0.9), (1, 2, 2, 0.1), (2, 1, 1, 0.5)}


def follow(frames, options=Options(video=True), **more):
    tracker, seen = Tracker(options), []
    for i, boxes in enumerate(frames):
        seen.append(tracker.advance(i, np.array(boxes, float).reshape(-1, 4), **more))
    follow.last = tracker
    return seen


def ids(seen, *states):
    return {p or -t for rows in seen for t, p, s, _ in rows if s in states}


def test_tracker_stay():
    assert ids(follow([[(100 + 2 * f, 200, 80, 200)] for f in range(30)]), "Confirmed") == {1}


def test_tracker_crossing():
    seen = follow([[(100 + 10 * f, 200, 60, 180), (300 - 10 * f, 200, 60, 180)] for f in range(20)])
    assert len(ids(seen, "Confirmed")) == 2


GONE = [[(150, 200, 80, 200)]] * 5 + [[]] * 15 + [[(155, 205, 80, 200)]] * 2


def test_tracker_leaves_and_returns():
    assert ids(follow(GONE), "Confirmed") == {1, 2}
    assert ids(follow(GONE, Options(video=True, reuse_ids=True)), "Confirmed") == {1}


def test_tracker_occluded():
    assert ids(follow([[(100 + 5 * f, 200, 70, 190)] for f in range(3)] + [[], [], [(120, 200, 70, 190)]]), "Confirmed") == {1}


def test_tracker_ends_a_track_that_left():
    seen = follow([[(100, 200, 70, 190)]] * 3 + [[]] * 6)
    assert ids(seen, "Retired") == {1} and len(follow.last.finalised) == 1 and not follow.last.active()


def test_tracker_new_person_at_the_exit():
    assert ids(follow([[(500, 200, 70, 190)]] * 3 + [[]] * 6 + [[(500, 200, 70, 190)]] * 2), "Confirmed") == {1, 2}


def test_tracker_two_apart():
    follow([[(100, 200, 60, 180), (400, 200, 60, 180)]] * 10)
    assert {t.person_id for t in follow.last.active()} == {1, 2}


def test_tracker_noise_is_never_confirmed():
    seen = follow([[(100, 100, 80, 200)]] + [[]] * 5)
    assert not ids(seen, "Confirmed") and ids(seen, "Discarded") == {-1}


def test_tracker_growth():
    frames = []
    for f in range(15):
        h = 150 + 16 * f
        frames.append([(200 - 0.2 * h, 400 - h / 2, 0.4 * h, h)])
    assert ids(follow(frames), "Confirmed") == {1}


def test_tracker_first_frame_confirms_at_once_when_live():
    still = [[(100, 200, 80, 200)]] * 2
    assert [r[0][2] for r in follow(still, Options())] == ["Confirmed", "Confirmed"]
    assert [r[0][2] for r in follow(still)] == ["Tentative", "Confirmed"]


def test_tracker_follows_the_camera():
    """A jump of 120 pixels loses the track unless the camera's motion is known."""
    frames = [np.array([[100, 200, 80, 200]], float)] * 3 + [np.array([[220, 200, 80, 200]], float)] * 2
    for motion, people in ((Motion(), 2), (Motion(120, 0, reliable=True), 1)):
        tracker = Tracker(Options(video=True))
        for i, boxes in enumerate(frames):
            tracker.advance(i, boxes, motion=motion if i == 3 else Motion())
        assert tracker.next_person == people + 1


def test_tracker_is_patient_in_motion():
    frames = [[(100, 200, 70, 190)]] * 3 + [[]] * 6
    assert "Retired" in {s for rows in follow(frames) for *_, s, _ in rows}
    seen = follow(frames, motion=Motion(high=True))
    assert {s for rows in seen[3:] for *_, s, _ in rows} == {"TemporarilyLost"}


def test_tracker_skips_risky_matches():
    """Low overlap and a far move may be another person: a new track begins."""
    seen = follow([[(100, 200, 50, 200)]] * 3 + [[(163, 200, 50, 200)]])
    assert len({t for t, *_ in seen[3]}) == 2


def test_tracker_timeout_and_reset():
    tracker = Tracker(Options())
    for i, s in enumerate((0.0, 1.0, 2.0)):
        tracker.advance(i, np.array([[100, 200, 80, 200]], float), s)
    rows = tracker.advance(3, np.zeros((0, 4)), 7.5)
    assert [(p, s) for _, p, s, _ in rows] == [(1, "Retired")] and not tracker.tracks
    tracker.reset()
    assert (tracker.next_id, tracker.next_person, tracker.finalised) == (1, 1, [])


def test_silent_source_ends_its_tracks(spark, tmp_path):
    """With event time, a source that falls silent gives its closing rows once the stream has moved on."""
    schema = "source string, frame long, ts timestamp, x double, y double, w double, h double"
    make = lambda rows, name: spark.createDataFrame([(s, f, datetime(2024, 1, 1) + timedelta(seconds=t), 100.0, 200.0, 80.0, 200.0) for s, f, t in rows], schema).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    make([("a", i, i) for i in range(3)] + [("b", i, i) for i in range(3)], "1")

    def run():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withWatermark("ts", "1 second")
        track_stream(stream, event_time="ts").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()

    run()
    make([("b", i, 10 * i) for i in range(3, 8)], "2")
    run()
    ended = spark.read.parquet(str(tmp_path / "out")).where("state = 'Retired'").collect()
    assert ("a", 1) in {(r.source, r.person_id) for r in ended}


def test_majority_ties_and_weights(spark):
    rows = spark.createDataFrame([(1, "b", 1.0), (1, "a", 1.0), (2, "x", 5.0), (2, "y", 1.0), (2, "y", 1.0)], "g int, v string, w double")
    assert {tuple(r) for r in votes.majority(rows, ["g"], "v").collect()} == {(1, "a", 1), (2, "y", 2)}
    assert {tuple(r) for r in votes.majority(rows, ["g"], "v", F.col("w")).collect()} == {(1, "a", 1.0), (2, "x", 5.0)}


def test_lifecycle(spark):
    rows = spark.createDataFrame([(3, 0.5, 1.0), (5, 0.5, 1.0), (5, 0.01, 1.0), (5, 0.5, 0.5)], "n int, m double, c double")
    got = [r[0] for r in rows.select(votes.lifecycle(F.col("n"), F.col("m"), F.col("c"))).collect()]
    assert got == ["Analyzing", "Stable", "Uncertain", "Uncertain"]


def test_accuracy_skips(spark):
    rows = spark.createDataFrame([("a", "Yes", "yes"), ("a", "Skip", "x"), ("a", " ", "x"), ("a", "No", "Unknown"), ("b", "Skip", "x")], "k string, e string, p string")
    got = {r.k: r for r in metrics.accuracy(rows, ["k"], "e", "p").collect()}
    assert (got["a"].evaluated, got["a"].correct, got["a"].skipped, got["a"].unknown, got["a"].accuracy) == (2, 1, 2, 1, 50.0)
    assert got["b"].evaluated == 0 and got["b"].accuracy == 0.0


def test_quantiles_by_rank(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 200), "v": rng.integers(0, 20, 200).astype(float)})
    got = {r.g: (r.a, r.b) for r in metrics.quantiles_by_rank(spark.createDataFrame(pdf), ["g"], "v", {"a": 0.5, "b": 0.95}).collect()}
    for g, part in pdf.groupby("g"):
        s = sorted(part.v)
        assert got[g] == (s[int(len(s) * 0.5)], s[int(len(s) * 0.95)])


def test_bank_cache_guards(spark, tmp_path):
    bank = spark.createDataFrame([("colour", "red", [0.6, 0.8])], "bank string, label string, vec array<double>")
    tables.save_bank(bank, str(tmp_path / "b"), "m", "c")
    found, why = tables.load_bank(spark, str(tmp_path / "b"), "m", "c", 2)
    assert why == "ok" and found.count() == 1
    assert tables.load_bank(spark, str(tmp_path / "b"), "other", "c", 2) == (None, "model differs")
    assert tables.load_bank(spark, str(tmp_path / "none"), "m", "c", 2)[0] is None


def test_latest_state(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, t int, v string")
    assert {tuple(r) for r in latest_state(rows, ["k"], ["t"]).collect()} == {(1, 2, "b"), (2, 1, "c")}


def test_kmeans_equals_numpy(spark, small):
    from lumenframe.plans import colours

    pixels = colours._pixels(spark, small).select("sample", "L", "a", "b").toPandas()
    got = {(r["sample"], r["k"]): r["n"] for r in colours.kmeans(spark, small, turns=3).collect()}
    for sample, part in pixels.groupby("sample"):
        x, c = part[["L", "a", "b"]].to_numpy(), np.array(colours.CENTRES)
        for _ in range(3):
            k = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            c = np.array([x[k == i].mean(axis=0) if (k == i).any() else c[i] for i in range(3)])
        k = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert {i: n for (s, i), n in got.items() if s == sample} == {i: int((k == i).sum()) for i in range(3) if (k == i).mean() >= 0.08}
