"""Boxes as structs of x, y, w, h in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A match may switch ids if it moved far with little overlap, changed its size with little overlap, or
#: was missed for some frames and moved while the camera's motion is not known.
SWITCH_IOU, SWITCH_MOVED, SWITCH_AREA, SWITCH_AREA_IOU, SWITCH_MISSED, SWITCH_LOST_MOVED = 0.15, 0.28, 1.90, 0.20, 2, 0.20

#: Fixed value: places of a limit of movement, a product of numbers with few places (0.35 * 0.8 is 0.28, but a little less in doubles).
LIMIT_PLACES = 9


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), w.cast("double").alias("w"), h.cast("double").alias("h"))


def clamp(v: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(v, F.lit(lo)), F.lit(hi))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 without overlap or area."""
    w = F.least(a.x + a.w, b.x + b.w) - F.greatest(a.x, b.x)
    h = F.least(a.y + a.h, b.y + b.h) - F.greatest(a.y, b.y)
    both = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    union = a.w * a.h + b.w * b.h - both
    return F.when((both > 0) & (union > 0), both / union).otherwise(F.lit(0.0))


def centre_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(a.x + a.w / 2 - b.x - b.w / 2, 2) + F.pow(a.y + a.h / 2 - b.y - b.h / 2, 2))


def displacement(a: Column, b: Column) -> Column:
    """Distance of the centres in heights of the first box."""
    return centre_distance(a, b) / F.greatest(a.h, F.lit(1.0))


def area_ratio(a: Column, b: Column) -> Column:
    """The larger area over the smaller, at least 1."""
    x, y = F.greatest(a.w * a.h, F.lit(1.0)), F.greatest(b.w * b.h, F.lit(1.0))
    return F.greatest(x, y) / F.least(x, y)


def aspect(a: Column) -> Column:
    return a.w / F.greatest(a.h, F.lit(1.0))


def clamp_to_frame(a: Column, width: Column, height: Column) -> Column:
    """The part of a box that lies in the frame."""
    x0, y0 = F.least(F.greatest(a.x, F.lit(0.0)), width), F.least(F.greatest(a.y, F.lit(0.0)), height)
    x1, y1 = F.least(F.greatest(a.x + a.w, F.lit(0.0)), width), F.least(F.greatest(a.y + a.h, F.lit(0.0)), height)
    return box(x0, y0, x1 - x0, y1 - y0)


def letterbox(width: Column, height: Column, size: float) -> tuple[Column, Column, Column]:
    """Scale and paddings that fit a frame into a square, half to even."""
    scale = F.least(F.lit(size) / width, F.lit(size) / height)
    return scale, F.floor((size - F.bround(width * scale)) / 2), F.floor((size - F.bround(height * scale)) / 2)


def shifted(a: Column, dx: Column, dy: Column) -> Column:
    """A box moved by the camera's motion."""
    return box(a.x + dx, a.y + dy, a.w, a.h)


def moved_limit(limit: float, missed: Column) -> Column:
    """How far a track may move: less for each frame that it was missed, down to half; rounded, so that a box on the limit passes it."""
    return F.round(limit * F.when(missed > 0, F.greatest(F.lit(0.5), 1 - 0.2 * missed)).otherwise(1.0), LIMIT_PLACES)


def match_score(overlap: Column, moved: Column, alike: Column, missed: Column, limit: Column, least_iou: float, proximity: int) -> Column:
    """Overlap path: .7 overlap, .3 nearness; else, for what was not missed for long, .6 nearness within the limit and .4 overlap; else null."""
    by_overlap, near = alike & (moved <= F.round(1.5 * limit, LIMIT_PLACES)), alike & (missed <= proximity) & (moved <= limit)
    score = F.when(by_overlap, 0.7 * overlap + 0.3 * F.greatest(F.lit(0.0), 1 - moved))
    return F.when(overlap >= least_iou, score).when(near, 0.6 * F.greatest(F.lit(0.0), 1 - moved / limit) + 0.4 * overlap)


def may_switch(overlap: Column, moved: Column, ratio: Column, missed: Column, known_motion: Column) -> Column:
    far = (overlap < SWITCH_IOU) & (moved > SWITCH_MOVED)
    return far | ((ratio > SWITCH_AREA) & (overlap < SWITCH_AREA_IOU)) | ((missed >= SWITCH_MISSED) & (moved > SWITCH_LOST_MOVED) & ~known_motion)
