"""Queries over boxes: overlap joins, candidate gates, matching, suppression, anchors.

Boxes come from lineitem by the fixed formula of ``sources.tables.detections``: a frame for each order.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.functions import geometry as G
from lumenframe.functions import rules
from lumenframe.operators import assign
from lumenframe.operators.votes import halves_up
from lumenframe.sources.tables import DETECTIONS_SQL, dealt, detections
from lumenframe.streaming.tracker import Options

IOU_SQL = """CASE WHEN iw > 0 AND ih > 0 THEN iw * ih / (a.w * a.h + b.w * b.h - iw * ih) ELSE 0 END"""
PAIRS_SQL = f"""{DETECTIONS_SQL}, pr AS (SELECT a.frame, a.det AS a_det, b.det AS b_det, a.w AS aw, a.h AS ah, b.w AS bw, b.h AS bh,
 a.x + a.w / 2 - b.x - b.w / 2 AS dx, a.y + a.h / 2 - b.y - b.h / 2 AS dy,
 least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) AS iw, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) AS ih
 FROM det a JOIN det b ON a.frame = b.frame AND a.det < b.det),
io AS (SELECT *, CASE WHEN iw > 0 AND ih > 0 THEN iw * ih / (aw * ah + bw * bh - iw * ih) ELSE 0 END AS iou, sqrt(dx * dx + dy * dy) AS dist FROM pr)"""


def _round(c):
    """Four places; the nudge keeps exact halves from falling either way."""
    return F.round(c + 1e-9, 4)


def _pairs(spark, d):
    """Pairs of one frame: an equi-join on the frame, bounded by the boxes of a frame; frames are dealt out once, so many rows to a task."""
    x = dealt(detections(spark, d), "frame")
    a, b = x.select("frame", F.col("det").alias("a_det"), F.col("box").alias("a")), x.select("frame", F.col("det").alias("b_det"), F.col("box").alias("b"))
    return a.join(b, "frame").where("a_det < b_det").withColumn("iou", G.iou(F.col("a"), F.col("b")))


def iou_theta_join(spark, d):
    return _pairs(spark, d).where("iou >= 0.15").select("frame", "a_det", "b_det", halves_up(F.col("iou"), 4).alias("iou"))


def best_match_argmax(spark, d):
    """The best partner of each box, or none."""
    x = dealt(detections(spark, d).select("frame", F.col("det").alias("a_det")), "frame")
    best = _pairs(spark, d).where("iou >= 0.15").groupBy("frame", "a_det").agg(F.max(F.struct("iou", (-F.col("b_det")).alias("neg"))).alias("m"))
    return x.join(best, ["frame", "a_det"], "left").groupBy("frame", "a_det").agg(F.coalesce(F.max(-F.col("m.neg")), F.lit(-1)).alias("b_det"), halves_up(F.max(F.coalesce("m.iou", F.lit(0.0))), 4).alias("iou"))


BEST = f"""WITH {PAIRS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY frame, a_det ORDER BY iou DESC, b_det) AS k FROM io WHERE iou >= 0.15)
SELECT det.frame, det.det AS a_det, coalesce(max(r.b_det), -1) AS b_det, round(max(coalesce(r.iou, 0)), 4) AS iou FROM det LEFT JOIN r ON r.frame = det.frame AND r.a_det = det.det AND r.k = 1 GROUP BY 1, 2"""


#: The tracker's gates; how long the first box was missed and whether the camera's motion is known follow from its number and the frame.
TRACK = Options()
MISSED, KNOWN = "CAST(a_det % 4 AS INT)", "frame % 2 = 0"


def box_metrics(spark, d):
    """How two boxes of a frame would match as a track and a detection: the tracker's formulas and gates as columns."""
    a, b = F.col("a"), F.col("b")
    m = _pairs(spark, d).select("*", G.displacement(a, b).alias("moved"), G.area_ratio(a, b).alias("ratio"), F.abs(G.aspect(a) - G.aspect(b)).alias("gap"), F.expr(MISSED).alias("missed"), F.expr(KNOWN).alias("known"))
    alike = (F.col("ratio") <= TRACK.area) & (F.col("gap") <= TRACK.aspect)
    score = G.match_score(F.col("iou"), F.col("moved"), alike, F.col("missed"), G.moved_limit(TRACK.displacement, F.col("missed")), TRACK.iou, TRACK.proximity)
    risky = score.isNotNull() & G.may_switch(F.col("iou"), F.col("moved"), F.col("ratio"), F.col("missed"), F.col("known"))
    return m.select("frame", "a_det", "b_det", _round(F.col("moved")).alias("moved"), _round(F.col("ratio")).alias("ratio"), _round(F.col("gap")).alias("aspect_gap"), _round(score).alias("score"), risky.alias("risky"))


METRICS = f"""WITH {PAIRS_SQL}, m AS (SELECT *, dist / greatest(ah, 1) AS moved, greatest(aw * ah, bw * bh) / least(aw * ah, bw * bh) AS ratio, abs(aw / ah - bw / bh) AS gap, {MISSED} AS missed, {KNOWN} AS known FROM io),
g AS (SELECT *, {TRACK.displacement} * CASE WHEN missed > 0 THEN greatest(0.5, 1 - 0.2 * missed) ELSE 1 END AS lim, ratio <= {TRACK.area} AND gap <= {TRACK.aspect} AS alike FROM m),
s AS (SELECT *, CASE WHEN iou >= {TRACK.iou} THEN CASE WHEN alike AND moved <= 1.5 * lim THEN 0.7 * iou + 0.3 * greatest(0, 1 - moved) END
 WHEN alike AND missed <= {TRACK.proximity} AND moved <= lim THEN 0.6 * greatest(0, 1 - moved / lim) + 0.4 * iou END AS score FROM g)
SELECT frame, a_det, b_det, round(moved + 1e-9, 4) AS moved, round(ratio + 1e-9, 4) AS ratio, round(gap + 1e-9, 4) AS aspect_gap, round(score + 1e-9, 4) AS score, score IS NOT NULL AND
 ((iou < {G.SWITCH_IOU} AND moved > {G.SWITCH_MOVED}) OR (ratio > {G.SWITCH_AREA} AND iou < {G.SWITCH_AREA_IOU}) OR (missed >= {G.SWITCH_MISSED} AND moved > {G.SWITCH_LOST_MOVED} AND NOT known)) AS risky FROM s"""


def clamp_box(spark, d):
    b = G.clamp_to_frame(G.shifted(F.col("box"), F.lit(-20.0), F.lit(15.0)), F.lit(160.0), F.lit(200.0))
    return detections(spark, d).select("frame", "det", b.alias("b")).select("frame", "det", "b.*")


CLAMP = f"""WITH {DETECTIONS_SQL}, c AS (SELECT frame, det, least(greatest(x - 20, 0), 160) AS x, least(greatest(y + 15, 0), 200) AS y, least(greatest(x - 20 + w, 0), 160) AS x1, least(greatest(y + 15 + h, 0), 200) AS y1 FROM det)
SELECT frame, det, x, y, x1 - x AS w, y1 - y AS h FROM c"""


def letterbox_roundtrip(spark, d):
    """Into whole pixels of a 640 square and back: boxes and their centres (as a keypoint) come out within half a pixel."""
    x = detections(spark, d).select("frame", "det", "box", (F.col("box.w") * 8).alias("fw"), (F.col("box.h") * 8).alias("fh"))
    scale, px, py = G.letterbox(F.col("fw"), F.col("fh"), 640.0)
    x = x.select("*", scale.alias("s"), px.alias("px"), py.alias("py"))
    back = lambda v, pad: (F.bround(F.col(v) * F.col("s") + F.col(pad)) - F.col(pad)) / F.col("s")
    x = x.withColumns({"kx": F.col("box.x") + F.col("box.w") / 2, "ky": F.col("box.y") + F.col("box.h") / 2}).withColumns({"bx": back("box.x", "px"), "by": back("box.y", "py"), "cx": back("kx", "px"), "cy": back("ky", "py")})
    near = (F.abs(F.col("cx") - F.col("kx")) <= 0.5 / F.col("s") + 1e-9) & (F.abs(F.col("cy") - F.col("ky")) <= 0.5 / F.col("s") + 1e-9)
    return x.select("frame", "det", F.round("s", 4).alias("scale"), F.col("px").cast("long").alias("px"), F.col("py").cast("long").alias("py"), *[_round(F.col(c)).alias(c) for c in ("bx", "by", "cx", "cy")], near.alias("near"))


LETTERBOX = f"""WITH {DETECTIONS_SQL}, s AS (SELECT *, least(640.0::DOUBLE / (w * 8), 640.0::DOUBLE / (h * 8)) AS s FROM det),
p AS (SELECT *, floor((640 - round_even(w * 8 * s, 0)) / 2) AS px, floor((640 - round_even(h * 8 * s, 0)) / 2) AS py, x + w / 2 AS kx, y + h / 2 AS ky FROM s),
b AS (SELECT *, (round_even(x * s + px, 0) - px) / s AS bx, (round_even(y * s + py, 0) - py) / s AS by_, (round_even(kx * s + px, 0) - px) / s AS cx, (round_even(ky * s + py, 0) - py) / s AS cy FROM p)
SELECT frame, det, round(s, 4) AS scale, CAST(px AS BIGINT) AS px, CAST(py AS BIGINT) AS py, round(bx + 1e-9, 4) AS bx, round(by_ + 1e-9, 4) AS "by", round(cx + 1e-9, 4) AS cx, round(cy + 1e-9, 4) AS cy,
 abs(cx - kx) <= 0.5::DOUBLE / s + 1e-9 AND abs(cy - ky) <= 0.5::DOUBLE / s + 1e-9 AS near FROM b"""


def candidate_rules(spark, d):
    """Ordered rejection rules over shape, size and evidence, then tiers; evidence is quantity % 6 keypoints."""
    x = detections(spark, d).select("frame", "det", "confidence", F.col("box.w").alias("w"), F.col("box.h").alias("h"), (F.col("quantity") % 6).cast("int").alias("points"))
    return x.select("frame", "det", rules.first_match(CANDIDATES, "Weak").alias("verdict"))


#: Verdicts by width, height, confidence and visible keypoints in a 1920 x 1080 frame.
CANDIDATES = [
    ("ExtremeHorizontal", "w / h > 1.85"),
    ("HorizontalWithoutBody", "w / h > 1.25 AND points < 2 AND confidence < 0.65 AND w * h < 10000"),
    ("ExtremeVertical", "w / h < 0.08"),
    ("BelowMinimumSize", "(h < 37.8 OR w * h < 1200) AND points < 3 AND confidence < 0.65"),
    ("NoPoseEvidence", "points = 0 AND w * h < 10000 AND (confidence < 0.58 OR h < 80 OR w * h < 3000)"),
    ("Strong", "(confidence >= 0.45 AND (points >= 2 OR w * h >= 10000)) OR confidence >= 0.70"),
    ("Probable", "(confidence >= 0.38 OR w * h >= 10000) AND (points >= 1 OR h >= 70)"),
]
CANDIDATE = f"WITH {DETECTIONS_SQL}, c AS (SELECT *, CAST(quantity % 6 AS INT) AS points FROM det) SELECT frame, det, {rules.first_match_sql(CANDIDATES, 'Weak')} AS verdict FROM c"

#: Crop thresholds, in the order in which they are tested.
CROP = [("LowConfidence", "confidence < 0.40"), ("Narrow", "w < 40"), ("Short", "h < 80"), ("Small", "w * h < 3200"), ("Blurry", "sharp < 35")]


def quality_gate(spark, d):
    """Reject reason, or a weighted score of confidence, size and sharpness, and its weight (fixed values)."""
    x = detections(spark, d).select("frame", "det", "confidence", F.col("box.w").alias("w"), F.col("box.h").alias("h"), (F.col("quantity") * 4).alias("sharp"))
    conf, size, sharp = G.clamp(F.col("confidence"), 0.4, 1.0), G.clamp(F.col("w") * F.col("h") / 40000, 0.2, 1.0), G.clamp(F.col("sharp") / 150, 0.2, 1.0)
    score = conf * 0.45 + size * 0.30 + sharp * 0.25
    x = x.select("*", rules.first_match(CROP, "Accepted").alias("verdict"), score.alias("score"), conf.alias("c"))
    ok = F.col("verdict") == "Accepted"
    return x.select("frame", "det", "verdict", _round(F.when(ok, F.col("score"))).alias("score"), _round(F.when(ok, G.clamp(F.col("score") * F.col("c"), 0.1, 1.0))).alias("weight"))


QUALITY = f"""WITH {DETECTIONS_SQL}, q AS (SELECT *, quantity * 4 AS sharp, least(greatest(confidence, 0.4), 1.0) AS c FROM det),
s AS (SELECT *, {rules.first_match_sql(CROP, 'Accepted')} AS verdict, c * 0.45 + least(greatest(w * h / 40000, 0.2), 1.0) * 0.30 + least(greatest(sharp / 150, 0.2), 1.0) * 0.25 AS sc FROM q)
SELECT frame, det, verdict, round(CASE WHEN verdict = 'Accepted' THEN sc END + 1e-9, 4) AS score, round(CASE WHEN verdict = 'Accepted' THEN least(greatest(sc * c, 0.1), 1.0) END + 1e-9, 4) AS weight FROM s"""


def evidence_gate(spark, d):
    """Evidence of head, upper, lower and feet from keypoint confidence, sharpness, area and clipping (fixed values)."""
    x = detections(spark, d).select("frame", "det", F.col("confidence").alias("kp"), G.clamp(F.col("quantity") * 4 / 120, 0.3, 1.0).alias("sharp"), G.clamp(F.col("box.w") * F.col("box.h") / 5000, 0.4, 1.0).alias("area"),
                                    (F.col("box.x") <= 3).alias("clipped"), F.when(F.col("part") % 4 == 0, 1.0).when(F.col("part") % 4 == 1, 0.9).when(F.col("part") % 4 == 2, 0.55).otherwise(0.45).alias("facing"))
    cut = lambda f: F.when(F.col("clipped"), f).otherwise(1.0)
    kp, sharp, area = F.col("kp"), F.col("sharp"), F.col("area")
    scores = {
        "head": G.clamp((F.col("facing") * 0.40 + G.clamp(kp, 0.2, 1.0) * 0.25 + sharp * 0.20 + area * 0.15) * cut(0.65), 0.05, 1.0),
        "upper": (kp * 0.40 + sharp * 0.35 + area * 0.25) * cut(0.70), "lower": (kp * 0.45 + sharp * 0.30 + area * 0.25) * cut(0.65), "feet": (kp * 0.55 + sharp * 0.45) * cut(0.0),
    }
    return x.select("frame", "det", *[_round(v).alias(k) for k, v in scores.items()], (scores["head"] >= 0.30).alias("has_head"))


EVIDENCE = f"""WITH {DETECTIONS_SQL}, e AS (SELECT *, confidence AS kp, least(greatest(quantity * 4 / 120, 0.3), 1.0) AS sharp, least(greatest(w * h / 5000, 0.4), 1.0) AS area, x <= 3 AS clipped, CASE part % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.55 ELSE 0.45 END AS facing FROM det),
h AS (SELECT *, least(greatest((facing * 0.40 + least(greatest(kp, 0.2), 1.0) * 0.25 + sharp * 0.20 + area * 0.15) * CASE WHEN clipped THEN 0.65 ELSE 1 END, 0.05), 1.0) AS hd FROM e)
SELECT frame, det, round(hd + 1e-9, 4) AS head, round((kp * 0.40 + sharp * 0.35 + area * 0.25) * CASE WHEN clipped THEN 0.70 ELSE 1 END + 1e-9, 4) AS upper, round((kp * 0.45 + sharp * 0.30 + area * 0.25) * CASE WHEN clipped THEN 0.65 ELSE 1 END + 1e-9, 4) AS lower,
 round((kp * 0.55 + sharp * 0.45) * CASE WHEN clipped THEN 0 ELSE 1 END + 1e-9, 4) AS feet, hd >= 0.30 AS has_head FROM h"""


def greedy_assignment(spark, d):
    """One-to-one pairs of odd and even boxes of a frame, best overlap first."""
    pairs = _pairs(spark, d).where("iou >= 0.15 AND a_det % 2 <> b_det % 2")
    odd = F.col("a_det") % 2 == 1
    pairs = pairs.select("frame", F.when(odd, F.col("a_det")).otherwise(F.col("b_det")).alias("track"), F.when(odd, F.col("b_det")).otherwise(F.col("a_det")).alias("det"), F.col("iou").alias("score"))
    return assign.greedy_assign(pairs, ["frame"], "track", "det", "score").select("frame", "track", "det", halves_up(F.col("score"), 4).alias("score"))


def unmatched_detections(spark, d):
    """Boxes that no earlier box of their frame overlaps: each begins a track of its own."""
    x = dealt(detections(spark, d).select("frame", "det"), "frame")
    taken = _pairs(spark, d).where("iou >= 0.15").select("frame", F.col("b_det").alias("det"))
    return x.join(taken, ["frame", "det"], "left_anti").groupBy("frame").agg(F.countDistinct("det").alias("new_tracks"))


UNMATCHED = f"WITH {PAIRS_SQL} SELECT frame, count(DISTINCT det) AS new_tracks FROM det WHERE NOT EXISTS (SELECT 1 FROM io WHERE io.frame = det.frame AND io.b_det = det.det AND iou >= 0.15) GROUP BY 1"


def nms(spark, d):
    x = detections(spark, d).select("frame", "det", "confidence", "box.*")
    return assign.nms(x, ["frame"], "confidence", 0.3).select("frame", "det", "confidence")


def _recursive_nms(source: str) -> str:
    """Boxes one after the other, best first, each against the list of those kept."""
    overlap = "greatest(0, least(p.x + p.w, o.x + o.w) - greatest(p.x, o.x)) * greatest(0, least(p.y + p.h, o.y + o.h) - greatest(p.y, o.y))"
    hit = f"len(list_filter(r.kept, lambda p: {overlap} / (p.w * p.h + o.w * o.h - {overlap}) > 0.3)) > 0"
    box = "{'x': o.x, 'y': o.y, 'w': o.w, 'h': o.h}"
    return f"""{source}, o AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY confidence DESC, x, y, w, h) AS k FROM det),
r AS (SELECT o.frame, o.k, o.det, o.confidence, true AS keep, [{box}] AS kept FROM o WHERE k = 1
 UNION ALL SELECT o.frame, o.k, o.det, o.confidence, NOT ({hit}), CASE WHEN {hit} THEN r.kept ELSE list_append(r.kept, {box}) END FROM r JOIN o ON o.frame = r.frame AND o.k = r.k + 1)
SELECT frame, det, confidence FROM r WHERE keep"""


NMS = f"WITH RECURSIVE {_recursive_nms(DETECTIONS_SQL)}"


def nms_whole_pixels(spark, d):
    """Suppression of marks on boxes whose sides are cut down to whole pixels first."""
    x = detections(spark, d).select("frame", "det", "confidence", *[F.floor(F.col(f"box.{c}") * 0.37).cast("double").alias(c) for c in "xywh"])
    return assign.nms(x, ["frame"], "confidence", 0.3).select("frame", "det", "confidence")


WHOLE = "WITH RECURSIVE " + _recursive_nms(DETECTIONS_SQL.replace("det AS (", "det0 AS (") + ", det AS (SELECT frame, det, confidence, " + ", ".join(f"floor({c} * 0.37::DOUBLE) AS {c}" for c in "xywh") + " FROM det0)")
GREEDY = f"""WITH RECURSIVE {PAIRS_SQL}, c AS (SELECT frame, CASE WHEN a_det % 2 = 1 THEN a_det ELSE b_det END AS track, CASE WHEN a_det % 2 = 1 THEN b_det ELSE a_det END AS det, iou AS score FROM io WHERE iou >= 0.15 AND a_det % 2 <> b_det % 2),
o AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, track, det) AS k FROM c),
r AS (SELECT frame, k, track, det, score, true AS taken, [track] AS tracks, [det] AS dets FROM o WHERE k = 1
 UNION ALL SELECT o.frame, o.k, o.track, o.det, o.score, NOT (list_contains(r.tracks, o.track) OR list_contains(r.dets, o.det)),
 CASE WHEN list_contains(r.tracks, o.track) OR list_contains(r.dets, o.det) THEN r.tracks ELSE list_append(r.tracks, o.track) END, CASE WHEN list_contains(r.tracks, o.track) OR list_contains(r.dets, o.det) THEN r.dets ELSE list_append(r.dets, o.det) END
 FROM r JOIN o ON o.frame = r.frame AND o.k = r.k + 1)
SELECT frame, track, det, round(score, 4) AS score FROM r WHERE taken"""


def anchor_grid(spark, d):
    """Anchors of five levels with nine shapes each, summed up by level and shape."""
    levels = spark.range(5).select((F.col("id") + 3).alias("level"), F.pow(F.lit(2.0), F.col("id") + 3).alias("stride"))
    grid = levels.withColumn("n", F.ceil(F.lit(384) / F.col("stride")).cast("int"))
    grid = grid.select("level", "stride", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("gx"), "n").select("level", "stride", "gx", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("gy"))
    grid = grid.withColumn("shape", F.explode(F.sequence(F.lit(0), F.lit(8))))
    size = F.col("stride") * 4 * F.pow(F.lit(2.0), (F.col("shape") % 3) / 3.0)
    ratio = F.pow(F.lit(2.0), F.floor(F.col("shape") / 3) - 1)
    return grid.groupBy("level", F.col("shape").cast("long").alias("shape")).agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("gx") + 0.5) * F.col("stride")), 4).alias("cx"), F.round(F.max(size / F.sqrt(ratio)), 4).alias("w"), F.round(F.max(size * F.sqrt(ratio)), 4).alias("h")
    )


ANCHORS = """WITH l AS (SELECT id + 3 AS level, 2.0::DOUBLE ** (id + 3) AS stride FROM range(5) t(id)), g AS (SELECT level, stride, gx, shape FROM l, LATERAL range(CAST(ceil(384 / stride) AS BIGINT)) a(gx), LATERAL range(CAST(ceil(384 / stride) AS BIGINT)) b(gy), range(9) s(shape))
SELECT level, shape, count(*) AS n, round(avg((gx + 0.5) * stride), 4) AS cx, round(max(stride * 4 * 2.0::DOUBLE ** ((shape % 3) / 3.0::DOUBLE) / sqrt(2.0::DOUBLE ** (shape // 3 - 1))), 4) AS w,
 round(max(stride * 4 * 2.0::DOUBLE ** ((shape % 3) / 3.0::DOUBLE) * sqrt(2.0::DOUBLE ** (shape // 3 - 1))), 4) AS h FROM g GROUP BY 1, 2"""


def anchor_decode(spark, d):
    """Deltas to boxes, exponents clamped at 10; boxes of up to 2 a side are dropped."""
    b = F.col("box")
    x = detections(spark, d).select("frame", "det", b.x.alias("x"), (b.w * F.exp(G.clamp((F.col("quantity") - 25) / 5, -10, 10))).alias("w"), (b.h * F.exp(G.clamp((10 - F.col("quantity")) / 4, -10, 10))).alias("h"))
    return x.where("w > 2 AND h > 2").select("frame", "det", F.round(F.col("x") - F.col("w") / 2, 3).alias("x"), F.round("w", 3).alias("w"), F.round("h", 3).alias("h"))


DECODE = f"""WITH {DETECTIONS_SQL}, z AS (SELECT frame, det, x, w * exp(least(greatest((quantity - 25) / 5, -10), 10)) AS w, h * exp(least(greatest((10 - quantity) / 4, -10), 10)) AS h FROM det)
SELECT frame, det, round(x - w / 2, 3) AS x, round(w, 3) AS w, round(h, 3) AS h FROM z WHERE w > 2 AND h > 2"""

QUERIES = {
    "iou_theta_join": (iou_theta_join, f"WITH {PAIRS_SQL} SELECT frame, a_det, b_det, round(iou, 4) AS iou FROM io WHERE iou >= 0.15"),
    "best_match_argmax": (best_match_argmax, BEST),
    "box_metrics": (box_metrics, METRICS),
    "clamp_box": (clamp_box, CLAMP),
    "letterbox_roundtrip": (letterbox_roundtrip, LETTERBOX),
    "candidate_rules": (candidate_rules, CANDIDATE),
    "quality_gate": (quality_gate, QUALITY),
    "evidence_gate": (evidence_gate, EVIDENCE),
    "unmatched_detections": (unmatched_detections, UNMATCHED),
    "greedy_assignment": (greedy_assignment, GREEDY),
    "nms": (nms, NMS),
    "nms_whole_pixels": (nms_whole_pixels, WHOLE),
    "anchor_grid": (anchor_grid, ANCHORS),
    "anchor_decode": (anchor_decode, DECODE),
}
