"""Greedy one-to-one matching and non-maximum suppression, one frame at a time.

Both are sequential within a frame and independent between frames: frames are dealt out by
source and frame, and a frame's boxes are bounded by what a detector emits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lumenframe.sources.tables import dealt


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Overlaps of boxes given as rows of x, y, w, h."""
    x0, y0 = np.maximum(a[:, None, :2], b[None, :, :2]).transpose(2, 0, 1)
    x1, y1 = np.minimum((a[:, :2] + a[:, 2:])[:, None], (b[:, :2] + b[:, 2:])[None]).transpose(2, 0, 1)
    both = np.clip(x1 - x0, 0, None) * np.clip(y1 - y0, 0, None)
    union = a[:, 2:].prod(axis=1)[:, None] + b[:, 2:].prod(axis=1)[None] - both
    return np.where(union > 0, both / np.where(union > 0, union, 1), 0.0)


def suppressed(boxes: np.ndarray, scores: np.ndarray, threshold: float) -> np.ndarray:
    """Which boxes stay: the best first, without those that overlap a kept one by more than the threshold."""
    keep = np.zeros(len(scores), bool)
    for i in np.lexsort((np.arange(len(scores)), -scores)):
        keep[i] = not (iou_matrix(boxes[i : i + 1], boxes[keep]) > threshold).any()
    return keep


#: Boxes of a frame up to which frames of one size are worked through together.
ALIKE_BOXES = 64


def suppressed_by_frame(boxes: np.ndarray, scores: np.ndarray, starts: np.ndarray, ends: np.ndarray, threshold: float) -> np.ndarray:
    """Which boxes stay in their frames, which are runs of rows; ties go to the box that sorts first. Frames of one size take a step together."""
    sizes, keep = ends - starts, np.zeros(len(scores), bool)
    order = np.lexsort((*boxes.T[::-1], -scores, np.repeat(np.arange(len(sizes)), sizes)))
    boxes, scores = boxes[order], scores[order]
    for size in np.unique(sizes):
        first = starts[sizes == size]
        if size > ALIKE_BOXES:
            for a in first:
                keep[order[a : a + size]] = suppressed(boxes[a : a + size], scores[a : a + size], threshold)
            continue
        x, y, w, h = boxes[first[:, None] + np.arange(size)].transpose(2, 0, 1)
        kept = np.ones((len(first), size), bool)
        for i in range(1, size):
            at, others = (slice(None), slice(i, i + 1)), (slice(None), slice(0, i))
            both = np.clip(np.minimum(x[at] + w[at], x[others] + w[others]) - np.maximum(x[at], x[others]), 0, None) * np.clip(np.minimum(y[at] + h[at], y[others] + h[others]) - np.maximum(y[at], y[others]), 0, None)
            union = w[at] * h[at] + w[others] * h[others] - both
            overlap = np.where(union > 0, both / np.where(union > 0, union, 1), 0.0)
            kept[:, i] = ~((overlap > threshold) & kept[others]).any(axis=1)
        keep[order[first[:, None] + np.arange(size)]] = kept
    return keep


def keep_by_frame(rows: DataFrame, by: list[str], keep) -> DataFrame:
    """The rows that keep(columns, starts, ends) marks in whole frames, which are runs of rows.

    Frames are dealt out and sorted, and read as consecutive runs of Arrow batches, so a task
    holds one batch and one frame, and small frames cost no call of their own.
    """
    names = rows.columns

    def run(batches):
        rest = None
        for batch in batches:
            pdf = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            change = np.flatnonzero((pdf[by] != pdf[by].shift()).any(axis=1).to_numpy())
            rest = pdf.iloc[change[-1] :]
            if change[-1]:
                yield marked(pdf.iloc[: change[-1]], change[:-1])
        if rest is not None:
            yield marked(rest, np.array([0]))

    def marked(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        return pdf[keep({c: pdf[c].to_numpy() for c in names}, starts, np.r_[starts[1:], len(pdf)])]

    return dealt(rows, *by).sortWithinPartitions(*by).mapInPandas(run, rows.schema)


def nms(detections: DataFrame, by: list[str], score: str, threshold: float) -> DataFrame:
    """Detections (x, y, w, h and score) that survive in their frame; ties go to the box that sorts first."""

    def keep(c: dict, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return suppressed_by_frame(np.stack([c[k] for k in "xywh"], axis=1).astype(float), c[score], starts, ends, threshold)

    return keep_by_frame(detections, by, keep)


def greedy_pairs(left: np.ndarray, right: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Which pairs are taken by falling score, each side once; ties by left and right."""
    used_left, used_right, keep = set(), set(), np.zeros(len(score), bool)
    for i in np.lexsort((right, left, -score)):
        if left[i] not in used_left and right[i] not in used_right:
            used_left.add(left[i])
            used_right.add(right[i])
            keep[i] = True
    return keep


def greedy_assign(candidates: DataFrame, by: list[str], left: str, right: str, score: str) -> DataFrame:
    """A one-to-one assignment of candidates in each frame."""
    return keep_by_frame(candidates, by, lambda c, starts, ends: np.concatenate([greedy_pairs(c[left][a:b], c[right][a:b], c[score][a:b]) for a, b in zip(starts, ends, strict=True)]))
