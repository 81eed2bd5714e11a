"""Queries over body regions, crops and their evidence gates.

Boxes are those of the detections, four times as large, and keypoints come from them by a fixed formula. Region formulas are SQL text over a box (x, y, w, h) and keypoints
(x5, y5, c5 and so on), in an image of WIDTH x HEIGHT.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenframe.functions import geometry as G
from lumenframe.functions import rules
from lumenframe.sources.tables import DETECTIONS_SQL, detections, table

WIDTH, HEIGHT = 1000, 1000
#: Keypoints that regions need: shoulders, elbows, wrists, hips, ankles (and the nose).
POINTS = (0, 5, 6, 7, 8, 9, 10, 11, 12, 15, 16)
POINT_SQL = [
    text
    for i in POINTS
    for text in (
        f"x + w * ((part * 3 + det * 7 + {i} * 29) % 100) / 100.0 AS x{i}",
        f"y + h * ((part * 5 + det * 11 + {i} * 17) % 100) / 100.0 AS y{i}",
        f"((part * 7 + det * 3 + {i} * 13) % 100) / 100.0 AS c{i}",
    )
]


def clamp(value: str, low: str, high: str) -> str:
    return f"least(greatest({value}, {low}), {high})"


def seen(*points: int, how: str = "OR") -> str:
    """Whether any (or all) of the points is visible enough to measure from."""
    return "(" + f" {how} ".join(f"c{i} >= 0.2" for i in points) + ")"


def wrist(i: int, elbow: int) -> tuple[str, str, str, str]:
    """A square around a wrist, moved a quarter of its radius towards a visible elbow."""
    r = clamp("w * 0.20", "25", "75")
    length = f"sqrt((x{elbow} - x{i}) * (x{elbow} - x{i}) + (y{elbow} - y{i}) * (y{elbow} - y{i}))"
    moved = lambda a: f"({a}{i} + CASE WHEN c{elbow} >= 0.2 AND {length} > 5 THEN ({a}{elbow} - {a}{i}) / {length} * ({r} * 0.25) ELSE 0 END)"
    return f"{moved('x')} - {r}", f"{moved('y')} - {r}", f"{r} * 2", f"{r} * 2"


_SPAN = "(greatest(x11, x12) - least(x11, x12))"
_THIGH = clamp("w * 0.60", "35", "150")
_LEG = f"CASE WHEN {seen(11, 12, how='AND')} AND {_SPAN} > 25 THEN {_SPAN} * 1.5 ELSE {_THIGH} END"
_MID = f"CASE WHEN {seen(11, 12, how='AND')} THEN (least(x11, x12) + greatest(x11, x12)) * 0.5 WHEN c11 >= 0.2 THEN x11 ELSE x12 END"
_LEFT = f"CASE WHEN {seen(11, 12)} THEN greatest(x, ({_MID}) - ({_LEG}) * 0.5) ELSE x END"
_TOP = f"CASE WHEN {seen(5, 6)} THEN least(y5, y6) - 15 ELSE y + h * 0.12 END"
_BOTTOM = f"CASE WHEN {seen(11, 12)} THEN greatest(y11, y12) + 15 ELSE y + h * 0.60 END"
_HIP = f"CASE WHEN {seen(11, 12, how='AND')} THEN greatest(y11, y12) WHEN c11 >= 0.2 THEN y11 WHEN c12 >= 0.2 THEN y12 ELSE y + h * 0.48 END"
_FEET = f"CASE WHEN {seen(15, 16)} THEN greatest(y15, y16) ELSE y + h * 0.95 END"
_ANKLE = f"CASE WHEN {seen(15, 16)} THEN least(y15, y16) - 10 ELSE y + h * 0.85 END"
_SHOULDER = f"CASE WHEN {seen(5, 6)} THEN greatest(y5, y6) ELSE y + h * 0.25 END"
_SHOULDERS = seen(5, 6, how="AND")
#: Each region's condition and unclamped x, y, width and height.
REGIONS = {
    "head": ("c0 >= 0.3", "x + w * 0.15", "y", "w * 0.70", f"greatest(20, ({_SHOULDER}) - y)"),
    "upper": (
        "c5 >= 0.3 OR c6 >= 0.3", f"CASE WHEN {_SHOULDERS} THEN least(x5, x6) - (greatest(x5, x6) - least(x5, x6)) * 0.12 ELSE x END", _TOP,
        f"CASE WHEN {_SHOULDERS} THEN (greatest(x5, x6) - least(x5, x6)) * 1.24 ELSE w END", f"greatest(30, ({_BOTTOM}) - ({_TOP}))",
    ),
    "left_wrist": ("c9 >= 0.3", *wrist(9, 7)),
    "right_wrist": ("c10 >= 0.3", *wrist(10, 8)),
    "lower": ("c11 >= 0.3 OR c12 >= 0.3", _LEFT, _HIP, f"CASE WHEN {seen(11, 12)} THEN least(w - (({_LEFT}) - x), {_LEG}) ELSE w END", f"greatest(30, ({_FEET}) - ({_HIP}))"),
    "feet": ("c15 >= 0.3 OR c16 >= 0.3", "x", _ANKLE, "w", f"greatest(20, y + h - ({_ANKLE}))"),
}
_FULL = "(h / greatest(1, w) >= 1.6 AND h > 180)"
#: Regions from a box alone.
FALLBACK = {
    "head": ("true", "x + w * 0.15", "y", "w * 0.70", "h * 0.25"),
    "upper": ("true", "x", "y + h * 0.18", "w", f"CASE WHEN {_FULL} THEN h * 0.35 ELSE h * 0.70 END"),
    "lower": (_FULL, "x", "y + h * 0.48", "w", "h * 0.40"),
    "feet": (f"{_FULL} AND (y + h >= {HEIGHT} * 0.80 OR h / greatest(1, w) >= 2.0)", "x", "y + h * 0.85", "w", "h * 0.15"),
}


def clamped(x: str, y: str, w: str, h: str) -> list[str]:
    """A region inside the image, at least one pixel wide and high."""
    cx, cy = clamp(f"({x})", "0", f"{WIDTH - 1}"), clamp(f"({y})", "0", f"{HEIGHT - 1}")
    return [cx, cy, clamp(f"({w})", "1", f"{WIDTH} - {cx}"), clamp(f"({h})", "1", f"{HEIGHT} - {cy}")]


CLIPPED = f"(rx <= 3 OR ry <= 3 OR rx + rw >= {WIDTH - 3} OR ry + rh >= {HEIGHT - 3})"


def _boxes(spark, d):
    return detections(spark, d).selectExpr("frame", "det", "part", "quantity", *[f"cast(box.{c} * 4 AS double) AS {c}" for c in "xywh"], "confidence")


def _points(spark, d):
    return _boxes(spark, d).selectExpr("*", *POINT_SQL)


BOXES_SQL = f"{DETECTIONS_SQL}, big AS (SELECT frame, det, part, quantity, confidence, x * 4 AS x, y * 4 AS y, w * 4 AS w, h * 4 AS h FROM det)"
POINTS_SQL = f"{BOXES_SQL}, k AS (SELECT *, {', '.join(POINT_SQL)} FROM big)"


def _regions(rows, regions: dict):
    parts = [f"CASE WHEN {ok} THEN named_struct('region', '{name}', " + ", ".join(f"'{c}', cast({v} AS double)" for c, v in zip(("rx", "ry", "rw", "rh"), clamped(*box), strict=True)) + ") END" for name, (ok, *box) in regions.items()]
    return rows.withColumn("r", F.explode(F.array_compact(F.expr(f"array({', '.join(parts)})")))).select("*", "r.*").drop("r")


def _regions_sql(source: str, regions: dict) -> str:
    return " UNION ALL ".join(f"SELECT *, '{name}' AS region, " + ", ".join(f"CAST({v} AS DOUBLE) AS {c}" for c, v in zip(("rx", "ry", "rw", "rh"), clamped(*box), strict=True)) + f" FROM {source} WHERE {ok}" for name, (ok, *box) in regions.items())


def _shown(*names: str) -> list[str]:
    return [f"round({n} + 1e-9, 4) AS {n}" for n in names]


def _doubles(text: str) -> str:
    """Numbers with a point as doubles, as the SQL's divisions give them; Spark's would go by decimals."""
    return re.sub(r"(?<![\w.])(\d+\.\d+)", r"\1D", text)


def _shown_as_sql(n: str) -> str:
    """n_, ten thousand times a value of zero or more, to the nearest whole number and back, as SQL rounds it: no decimal text is made of each value."""
    return f"(floor({n}_) + CASE WHEN {n}_ - floor({n}_) >= 0.5D THEN 1 ELSE 0 END) / 10000.0D AS {n}"


#: Parts of the formulas that are worked out once for a row, in the order in which they need each other.
HELD = {"leg": _LEG, "mid": _MID, "hip": _HIP, "left_side": _LEFT}


def _one_region(rows, name: str, ok: str, *box: str):
    """The rows (frame, det, region, rx, ry, rw, rh) of one region. Each step's formulas are columns of the step before, so that they stay small enough to be compiled."""
    rows, held = rows.where(ok), {}
    for column, text in HELD.items():
        if any(text in v for v in box):
            rows = rows.selectExpr("*", f"{reduce(lambda t, h: t.replace(f'({h[1]})', h[0]), held.items(), text)} AS {column}")
            held[column] = text
    box = [reduce(lambda t, h: t.replace(h[1], h[0]), reversed(held.items()), v) for v in box]
    rows = rows.selectExpr("frame", "det", *[f"cast({v} AS double) AS {c}" for c, v in zip(("x0", "y0", "w0", "h0"), map(_doubles, box), strict=True)])
    rows = rows.selectExpr("frame", "det", "w0", "h0", f"{clamp('x0', '0', f'{WIDTH - 1}')} AS rx", f"{clamp('y0', '0', f'{HEIGHT - 1}')} AS ry")
    return rows.selectExpr("frame", "det", f"'{name}' AS region", "rx", "ry", f"{clamp('w0', '1', f'{WIDTH} - rx')} AS rw", f"{clamp('h0', '1', f'{HEIGHT} - ry')} AS rh")


def body_regions(spark, d):
    """Six regions of each person from keypoints, kept inside the image, and whether its border cuts them: a branch for each region, with the keypoints that it needs."""
    points = _boxes(spark, d).selectExpr("*", *map(_doubles, POINT_SQL))
    sides = ("rx", "ry", "rw", "rh")

    def shown(r):
        r = r.selectExpr("*", *[f"({n} + 1e-9D) * 10000.0D AS {n}_" for n in sides])
        return r.selectExpr("frame", "det", "region", *map(_shown_as_sql, sides), f"{CLIPPED} AS clipped")

    return reduce(lambda a, b: a.union(b), [shown(_one_region(points, name, *v)) for name, v in REGIONS.items()])


BODY = f"WITH {POINTS_SQL}, r AS ({_regions_sql('k', REGIONS)}) SELECT frame, det, region, {', '.join(_shown('rx', 'ry', 'rw', 'rh'))}, {CLIPPED} AS clipped FROM r"


def fallback_regions(spark, d):
    """Regions from the box alone, where no pose is known."""
    return _regions(_boxes(spark, d), FALLBACK).selectExpr("frame", "det", "region", *_shown("rx", "ry", "rw", "rh"))


FALL = f"WITH {BOXES_SQL}, r AS ({_regions_sql('big', FALLBACK)}) SELECT frame, det, region, {', '.join(_shown('rx', 'ry', 'rw', 'rh'))} FROM r"

_CX, _CY = clamp("x * 1.37 - 9", "0", f"{WIDTH - 1}"), clamp("y * 1.21 - 7", "0", f"{HEIGHT - 1}")
_FX, _FY = f"floor({_CX})", f"floor({_CY})"
_RX, _RY = (clamp(f"ROUND_EVEN({v})", "0", f"{n - 1}") for v, n in (("x * 1.25", WIDTH), ("y * 1.25", HEIGHT)))
#: A crop is floored at its corner and ceiled in size; a part of a crop is rounded half to even; a relative crop is truncated.
CROPS = {
    "cx": _FX, "cy": _FY,
    "cw": f"least(ceil({clamp('w * 1.13', '1', f'greatest(1, {WIDTH} - {_FX})')}), {WIDTH} - {_FX})", "ch": f"least(ceil({clamp('h * 1.07', '1', f'greatest(1, {HEIGHT} - {_FY})')}), {HEIGHT} - {_FY})",
    "sx": _RX, "sy": _RY, "sw": clamp("ROUND_EVEN(w * 0.75)", "1", f"{WIDTH} - {_RX}"), "sh": clamp("ROUND_EVEN(h * 0.75)", "1", f"{HEIGHT} - {_RY}"),
    "px": "floor(0.25 * w)", "py": "floor(0.1 * h)", "pw": "floor(0.55 * w)", "ph": "floor(0.42 * h)",
}


def crop_rects(spark, d):
    """Whole-pixel rectangles of a crop, of a part of it, and of a relative crop."""
    return _boxes(spark, d).selectExpr("frame", "det", *[f"cast({v.replace('ROUND_EVEN', 'bround')} AS bigint) AS {k}" for k, v in CROPS.items()])


CROP = f"WITH {BOXES_SQL} SELECT frame, det, " + ", ".join(f"CAST({v.replace('ROUND_EVEN(x * 1.25)', 'round_even(x * 1.25, 0)').replace('ROUND_EVEN(y * 1.25)', 'round_even(y * 1.25, 0)').replace('ROUND_EVEN(w * 0.75)', 'round_even(w * 0.75, 0)').replace('ROUND_EVEN(h * 0.75)', 'round_even(h * 0.75, 0)')} AS BIGINT) AS {k}" for k, v in CROPS.items()) + " FROM big"

#: Sharpness of a region, and the facing, by fixed formulas.
MEASURES = ["quantity * 3.0 AS sharp", "part % 5 AS facing"]
#: Least sizes, sharpness and keypoint confidence of each gate; weights of the scores.
HEAD_GATE = [("NotVisible", "c0 < 0.3"), ("Small", "w * 0.70 < 40 OR h * 0.25 < 40"), ("Rear", "facing = 3")]
FEET_GATE = [("NotVisible", "c15 < 0.3 AND c16 < 0.3"), ("Small", "w < 40 OR h * 0.15 < 25"), ("Clipped", f"y + h >= {HEIGHT - 3}"), ("Blurry", "sharp < 15"), ("Unsure", "greatest(c15, c16) < 0.30")]
_HEAD = clamp(
    f"((CASE facing WHEN 0 THEN 1.0 WHEN 1 THEN 0.90 WHEN 2 THEN 0.55 ELSE 0.45 END) * 0.40 + {clamp('c0 * 0.4 + (c5 + c6) / 2 * 0.35 + (c7 + c8) / 2 * 0.25', '0.2', '1.0')} * 0.25 + {clamp('sharp / 120.0', '0.3', '1.0')} * 0.20 + {clamp('w * 0.70 * h * 0.25 / 5000.0', '0.4', '1.0')} * 0.15) * CASE WHEN y <= 3 THEN 0.65 ELSE 1.0 END",
    "0.05", "1.0",
)
_SHOES = clamp(f"{clamp('greatest(c15, c16)', '0.2', '1.0')} * 0.55 + {clamp('sharp / 100.0', '0.3', '1.0')} * 0.45", "0.05", "1.0")


def appearance_gate(spark, d):
    """Whether a head shows enough: visible, large, not from behind, and a weighted quality of 0.30."""
    x = _points(spark, d).selectExpr("*", *MEASURES).selectExpr("*", f"{_HEAD} AS q").withColumn("gate", rules.first_match(HEAD_GATE, "Measured"))
    return x.selectExpr("frame", "det", "CASE WHEN gate = 'Measured' AND q < 0.30 THEN 'Poor' WHEN gate = 'Measured' THEN 'Evidence' ELSE gate END AS verdict", "CASE WHEN gate = 'Measured' THEN round(q + 1e-9, 4) END AS quality")


APPEARANCE = f"""WITH {POINTS_SQL}, m AS (SELECT *, {', '.join(MEASURES)} FROM k), q AS (SELECT *, {_HEAD} AS q, {rules.first_match_sql(HEAD_GATE, 'Measured')} AS gate FROM m)
SELECT frame, det, CASE WHEN gate = 'Measured' AND q < 0.30 THEN 'Poor' WHEN gate = 'Measured' THEN 'Evidence' ELSE gate END AS verdict, CASE WHEN gate = 'Measured' THEN round(q + 1e-9, 4) END AS quality FROM q"""


def feet_gate(spark, d):
    x = _points(spark, d).selectExpr("*", *MEASURES).selectExpr("*", f"{_SHOES} AS q").withColumn("gate", rules.first_match(FEET_GATE, "Measured"))
    return x.selectExpr("frame", "det", "CASE WHEN gate = 'Measured' AND q < 0.30 THEN 'Poor' WHEN gate = 'Measured' THEN 'Evidence' ELSE gate END AS verdict", "CASE WHEN gate = 'Measured' THEN round(q + 1e-9, 4) END AS quality")


FEET = f"""WITH {POINTS_SQL}, m AS (SELECT *, {', '.join(MEASURES)} FROM k), q AS (SELECT *, {_SHOES} AS q, {rules.first_match_sql(FEET_GATE, 'Measured')} AS gate FROM m)
SELECT frame, det, CASE WHEN gate = 'Measured' AND q < 0.30 THEN 'Poor' WHEN gate = 'Measured' THEN 'Evidence' ELSE gate END AS verdict, CASE WHEN gate = 'Measured' THEN round(q + 1e-9, 4) END AS quality FROM q"""

#: A wrist counts if its region is 35 pixels, its sharpness 20 and its confidence 0.35 at least.
WRISTS = {"left": ("left_wrist", 9, 7), "right": ("right_wrist", 10, 8)}
_WRIST_OK = "rw >= 35 AND rh >= 35 AND sharp >= 20 AND cw >= 0.35 AND NOT " + CLIPPED
_WRIST_Q = clamp("(cw * 0.70 + ce * 0.30) * 0.6 + sharp / 100.0 * 0.4", "0.1", "1.0")


def wrist_gate(spark, d):
    """Each wrist's quality, and whether either passes."""
    only = {k: v for k, v in REGIONS.items() if k.endswith("wrist")}
    r = _regions(_points(spark, d).selectExpr("*", *MEASURES), only)
    left = "region = 'left_wrist'"
    r = r.selectExpr("*", f"CASE WHEN {left} THEN c9 ELSE c10 END AS cw", f"CASE WHEN {left} THEN c7 ELSE c8 END AS ce").selectExpr("frame", "det", "region", f"CASE WHEN {_WRIST_OK} THEN {_WRIST_Q} END AS q")
    return r.groupBy("frame", "det").agg(*[F.round(F.max(F.when(F.col("region") == f"{s}_wrist", F.col("q"))) + 1e-9, 4).alias(s) for s in WRISTS], F.max(F.col("q").isNotNull()).alias("evidence"))


WRIST = f"""WITH {POINTS_SQL}, m AS (SELECT *, {', '.join(MEASURES)} FROM k), r AS ({_regions_sql('m', {k: v for k, v in REGIONS.items() if k.endswith('wrist')})}),
s AS (SELECT *, CASE WHEN region = 'left_wrist' THEN c9 ELSE c10 END AS cw, CASE WHEN region = 'left_wrist' THEN c7 ELSE c8 END AS ce FROM r),
q AS (SELECT frame, det, region, CASE WHEN {_WRIST_OK} THEN {_WRIST_Q} END AS q FROM s)
SELECT frame, det, round(max(q) FILTER (WHERE region = 'left_wrist') + 1e-9, 4) AS "left", round(max(q) FILTER (WHERE region = 'right_wrist') + 1e-9, 4) AS "right", max(q) IS NOT NULL AS evidence FROM q GROUP BY 1, 2"""

#: Tiers of what a wrist or feet region can show.
WRIST_TIERS = [("Impossible", "rw < 15 OR rh < 15"), ("Marginal", "rw < 30 OR rh < 30")]
FEET_TIERS = [("NotVisible", "rh < 20 OR rw < 20 OR rw * rh < 600"), ("Insufficient", "sharp < 15 OR (rh < 40 AND rw < 40)")]
_SMALL = ["w * 0.12 AS rw", "h * 0.07 AS rh", "quantity * 1.0 AS sharp"]


def roi_feasibility(spark, d):
    x = _boxes(spark, d).selectExpr("frame", "det", *_SMALL)
    return x.select("frame", "det", rules.first_match(WRIST_TIERS, "Feasible").alias("wrist"), rules.first_match(FEET_TIERS, "Visible").alias("feet"))


ROI = f"WITH {BOXES_SQL}, s AS (SELECT frame, det, {', '.join(_SMALL)} FROM big) SELECT frame, det, {rules.first_match_sql(WRIST_TIERS, 'Feasible')} AS wrist, {rules.first_match_sql(FEET_TIERS, 'Visible')} AS feet FROM s"


def displacement_limit(spark, d):
    """The displacement that a track may show shrinks by a fifth for each missed frame, to a half at most."""
    limit = "0.35 * CASE WHEN missed > 0 THEN greatest(0.5, 1.0 - missed * 0.2) ELSE 1.0 END"
    return _boxes(spark, d).selectExpr("det % 8 AS missed").groupBy("missed").agg(F.count("*").alias("n")).selectExpr("cast(missed AS bigint) AS missed", "n", f"round(cast({limit} AS double), 4) AS max_moved")


LIMIT = f"WITH {DETECTIONS_SQL} SELECT CAST(det % 8 AS BIGINT) AS missed, count(*) AS n, round(CAST(0.35 * CASE WHEN det % 8 > 0 THEN greatest(0.5, 1.0 - (det % 8) * 0.2) ELSE 1.0 END AS DOUBLE), 4) AS max_moved FROM det GROUP BY det % 8"


def largest_detection(spark, d):
    """The largest box of each frame (the first of equal ones), and its place in the frame's order by index."""
    x = _boxes(spark, d).withColumn("place", F.rank().over(Window.partitionBy("frame").orderBy("det")))
    return x.groupBy("frame").agg(F.max(F.struct((F.col("w") * F.col("h")).alias("area"), (-F.col("det")).alias("neg"), "place")).alias("m"), F.count("*").alias("n")).select("frame", (-F.col("m.neg")).cast("long").alias("det"), F.col("m.place").cast("long").alias("place"), "m.area", "n")


LARGEST = f"""WITH {BOXES_SQL}, p AS (SELECT *, rank() OVER (PARTITION BY frame ORDER BY det) AS place, count(*) OVER (PARTITION BY frame) AS n, row_number() OVER (PARTITION BY frame ORDER BY w * h DESC, det) AS k FROM big)
SELECT frame, CAST(det AS BIGINT) AS det, place, w * h AS area, n FROM p WHERE k = 1"""


def unmatched_tracks(spark, d):
    """Tracks (odd boxes) that no detection (even box) of their frame overlaps age by one frame."""
    x = detections(spark, d).select("frame", "det", "box")
    tracks, found = x.where("det % 2 = 1").select("frame", F.col("det").alias("track"), F.col("box").alias("t")), x.where("det % 2 = 0").select(F.col("frame").alias("f"), F.col("box").alias("b"))
    lost = tracks.join(found, (F.col("frame") == F.col("f")) & (G.iou(F.col("t"), F.col("b")) >= 0.15), "left_anti")
    return lost.select("frame", F.col("track").cast("long").alias("track"), (F.col("track") % 4 + 1).cast("long").alias("missed"))


UNMATCHED = f"""WITH {DETECTIONS_SQL}, o AS (SELECT a.frame, a.det, a.part, a.x, a.y, a.w, a.h, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) AS iw, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) AS ih, a.w * a.h + b.w * b.h AS whole
 FROM det a JOIN det b ON a.frame = b.frame AND a.det % 2 = 1 AND b.det % 2 = 0),
m AS (SELECT DISTINCT frame, det, part, x, y, w, h FROM o WHERE iw > 0 AND ih > 0 AND iw * ih / (whole - iw * ih) >= 0.15)
SELECT frame, CAST(det AS BIGINT) AS track, CAST(det % 4 + 1 AS BIGINT) AS missed FROM det WHERE det % 2 = 1 AND NOT EXISTS (SELECT 1 FROM m WHERE m.frame = det.frame AND m.det = det.det AND m.x = det.x AND m.y = det.y AND m.w = det.w AND m.h = det.h)"""

#: The shape of an output tells its layout.
LAYOUTS = [("rows", "dim2 >= 80"), ("columns", "dim1 <= 90 AND dim2 > 500")]


def layout_dispatch(spark, d):
    x = table(spark, d, "embeddings").selectExpr("vec_id * 13 % 120 AS dim1", "CASE WHEN vec_id % 3 = 0 THEN vec_id % 79 ELSE vec_id * 7 % 900 END AS dim2")
    return x.select(rules.first_match(LAYOUTS, "none").alias("layout")).groupBy("layout").agg(F.count("*").alias("n"))


LAYOUT = f"SELECT {rules.first_match_sql(LAYOUTS, 'none')} AS layout, count(*) AS n FROM (SELECT vec_id * 13 % 120 AS dim1, CASE WHEN vec_id % 3 = 0 THEN vec_id % 79 ELSE vec_id * 7 % 900 END AS dim2 FROM embeddings) GROUP BY 1"

QUERIES = {
    "body_regions": (body_regions, BODY),
    "fallback_regions": (fallback_regions, FALL),
    "crop_rects": (crop_rects, CROP),
    "appearance_gate": (appearance_gate, APPEARANCE),
    "feet_gate": (feet_gate, FEET),
    "wrist_gate": (wrist_gate, WRIST),
    "roi_feasibility": (roi_feasibility, ROI),
    "displacement_limit": (displacement_limit, LIMIT),
    "largest_detection": (largest_detection, LARGEST),
    "unmatched_tracks": (unmatched_tracks, UNMATCHED),
    "layout_dispatch": (layout_dispatch, LAYOUT),
}
