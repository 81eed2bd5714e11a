"""Stateful streams: rolling aggregates of a track, and a multi-object tracker for each source.

The tracker couples all boxes of a frame, so its state is keyed by source. Frames come in event-time
order within a source; frames older than the last seen are dropped. Every track has an id of its own that only grows;
a confirmed one also has a public id, which grows too, or is the smallest free one with ``reuse_ids``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenframe.functions import geometry as G


@dataclass(frozen=True)
class Options:
    """Gates of a match, frames that a track may miss, hits that confirm it, seconds of silence that end it."""

    iou: float = 0.25
    displacement: float = 0.35
    area: float = 2.2
    aspect: float = 0.40
    missed: int = 10
    video_missed: int = 4
    proximity: int = 2
    confirm: int = 2
    timeout_s: float = 5.0
    more_in_motion: int = 3
    video: bool = False
    reuse_ids: bool = False


@dataclass(frozen=True)
class Motion:
    """How the camera moved since the frame before."""

    dx: float = 0.0
    dy: float = 0.0
    reliable: bool = False
    high: bool = False


STILL = Motion()
#: Rows of a source that a task holds before it hands them on.
OUT_ROWS = 50_000
TRACK_SCHEMA = "source string, frame long, track_id long, person_id long, state string, x double, y double, w double, h double"


def rolling_mean(events: DataFrame, key: str, order: str, value: str, last: int = 10) -> DataFrame:
    """(key, order, mean) of the last values of each key, in the order given; state holds `last` values."""
    kinds = {c: events.schema[c].dataType.simpleString() for c in (key, order)}

    def run(k, batches, state: GroupState):
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        means = []
        for v in rows[value]:
            held = [*held, float(v)][-last:]
            means.append(sum(held) / len(held))
        state.update((held,))
        yield pd.DataFrame({key: rows[key], order: rows[order], "mean": means})

    return events.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {order} {kinds[order]}, mean double", "held array<double>", "append", GroupStateTimeout.NoTimeout)


@dataclass
class Track:
    track_id: int
    person_id: int
    hits: int
    misses: int
    box: list
    seen_s: float

    @property
    def confirmed(self) -> bool:
        return self.person_id > 0


class Tracker:
    """Tracks of one source: matches each frame's boxes, ages the rest."""

    def __init__(self, options: Options = Options(), tracks: list[Track] | None = None, next_id: int = 1, next_person: int = 1, last_frame: int = -1):
        self.options, self.tracks = options, tracks or []
        self.next_id, self.next_person, self.last_frame = next_id, next_person, last_frame
        self.finalised: list[Track] = []

    def active(self) -> list[Track]:
        """Confirmed tracks that have not ended."""
        return [t for t in self.tracks if t.confirmed]

    def reset(self) -> None:
        self.__init__(self.options)

    def person(self) -> int:
        """The next public id."""
        if self.options.reuse_ids:
            used = {t.person_id for t in self.tracks}
            return next(i for i in range(1, len(used) + 2) if i not in used)
        self.next_person += 1
        return self.next_person - 1

    def scores(self, boxes: list[list[float]], motion: Motion) -> list[tuple[float, int, int]]:
        """(score, track, box) of the pairs that may be matched and would not switch ids, by their places.

        A frame has few tracks and boxes, for which plain numbers take a fraction of the time that arrays do.
        """
        o, out = self.options, []
        new = [(x, y, w, h, max(w, 1.0), max(h, 1.0)) for x, y, w, h in boxes]
        for i, t in enumerate(self.tracks):
            x, y, w, h = t.box
            if motion.reliable:
                x, y = x + motion.dx, y + motion.dy
            wide, high = max(w, 1.0), max(h, 1.0)
            mid_x, mid_y, area, missed = x + wide / 2, y + high / 2, wide * high, t.misses
            limit = round(o.displacement * (max(0.5, 1 - 0.2 * missed) if missed > 0 else 1.0), G.LIMIT_PLACES)
            reach = round(1.5 * limit, G.LIMIT_PLACES)
            lost, close = missed >= G.SWITCH_MISSED and not motion.reliable, missed <= o.proximity + (2 if motion.high else 0)
            for j, (u, v, p, q, b_wide, b_high) in enumerate(new):
                moved = math.hypot(mid_x - u - b_wide / 2, mid_y - v - b_high / 2) / high
                if not moved <= reach or (lost and moved > G.SWITCH_LOST_MOVED):
                    continue
                b_area = b_wide * b_high
                ratio = max(area, b_area) / min(area, b_area)
                if not ratio <= o.area or not abs(wide / high - b_wide / b_high) <= o.aspect:
                    continue
                both = max(min(x + w, u + p) - max(x, u), 0.0) * max(min(y + h, v + q) - max(y, v), 0.0)
                union = w * h + p * q - both
                overlap = both / union if union > 0 else 0.0
                if (overlap < G.SWITCH_IOU and moved > G.SWITCH_MOVED) or (ratio > G.SWITCH_AREA and overlap < G.SWITCH_AREA_IOU):
                    continue
                if overlap >= o.iou:
                    out.append((0.7 * overlap + 0.3 * max(1 - moved, 0.0), i, j))
                elif close and moved <= limit:
                    out.append((0.6 * max(1 - moved / limit, 0.0) + 0.4 * overlap, i, j))
        return out

    def advance(self, frame: int, boxes: np.ndarray | list[list[float]], seen_s: float | None = None, motion: Motion = STILL) -> list[tuple]:
        """Rows (track_id, person_id, state, box) of the frame; an empty frame ages tracks.

        seen_s is the frame's time in seconds; without it, silence ends no track.
        """
        if frame <= self.last_frame:
            return []
        o, self.last_frame = self.options, frame
        boxes = boxes.tolist() if isinstance(boxes, np.ndarray) else boxes
        out, taken, matched = self.expire(seen_s), set(), {}
        for _, i, j in sorted(self.scores(boxes, motion), key=lambda p: (-p[0], p[1], p[2])):
            if i not in matched and j not in taken:
                matched[i] = j
                taken.add(j)
        most = (o.video_missed if o.video else o.missed) + (o.more_in_motion if motion.high else 0)
        kept = []
        for k, t in enumerate(self.tracks):
            if k in matched:
                t.hits, t.misses, t.box, t.seen_s = t.hits + 1, 0, boxes[matched[k]], seen_s or 0.0
                if not t.confirmed and t.hits >= o.confirm:
                    t.person_id = self.person()
                state = "Confirmed" if t.confirmed else "Tentative"
            else:
                t.misses += 1
                if t.confirmed:
                    state = "Retired" if t.misses > most else "TemporarilyLost" if motion.high else "Missed"
                else:
                    state = "Discarded" if t.misses >= 2 else "Tentative"
            if state == "Retired":
                self.finalised.append(t)
            if state not in ("Retired", "Discarded"):
                kept.append(t)
            out.append((t.track_id, t.person_id, state, t.box))
        self.tracks = kept
        for box in (b for j, b in enumerate(boxes) if j not in taken):
            at_once = frame == 0 and not o.video
            t = Track(self.next_id, self.person() if at_once else 0, 1, 0, box, seen_s or 0.0)
            self.next_id += 1
            self.tracks.append(t)
            out.append((t.track_id, t.person_id, "Confirmed" if at_once else "Tentative", box))
        return out

    def expire(self, now_s: float | None) -> list[tuple]:
        """Rows of the tracks that have not been seen for longer than the timeout (not in video)."""
        if now_s is None or self.options.video:
            return []
        gone = [t for t in self.tracks if now_s - t.seen_s > self.options.timeout_s]
        if not gone:
            return []
        self.tracks = [t for t in self.tracks if now_s - t.seen_s <= self.options.timeout_s]
        self.finalised += [t for t in gone if t.confirmed]
        return [(t.track_id, t.person_id, "Retired" if t.confirmed else "Discarded", t.box) for t in gone]


def track_stream(detections: DataFrame, options: Options = Options(), event_time: str | None = None) -> DataFrame:
    """Track rows of a stream (source, frame, x, y, w, h); a frame without boxes has one row with null x.

    Columns dx, dy, reliable and high may tell how the camera moved. Where a boolean column reset is true, the source's tracks and
    ids are forgotten before that frame. With event_time, a timestamp column under a watermark,
    tracks of a source that falls silent end after the timeout, when the watermark of the whole stream has passed it.
    """
    boxes, moves = ["x", "y", "w", "h"], [c for c in ("dx", "dy", "reliable", "high") if c in detections.columns]
    used = [c for c in detections.columns if c in ("frame", *boxes, *moves, event_time, "reset")]

    def run(key, batches, state: GroupState):
        tracker = Tracker(options)
        if state.exists:
            packed, next_id, next_person, last = state.get
            tracker = Tracker(options, [Track(int(p[0]), int(p[1]), int(p[2]), int(p[3]), list(p[4:8]), float(p[8])) for p in packed], next_id, next_person, last)
        if state.hasTimedOut:
            yield table(key[0], [(tracker.last_frame, t, p, s, *b) for t, p, s, b in tracker.expire(float("inf"))])
            state.remove()
            return
        out, last_s = [], 0.0
        rows = pd.concat([batch[used] for batch in batches]).sort_values(["frame", *boxes], kind="stable")
        frames = rows["frame"].to_numpy()
        starts = np.flatnonzero(np.r_[True, frames[1:] != frames[:-1]])
        ends, frames = np.r_[starts[1:], len(rows)].tolist(), frames[starts].tolist()
        held = [rows[c].to_numpy(float) for c in boxes]
        shown, held = ~np.isnan(held).any(axis=0), np.stack(held, axis=1)
        times = rows.groupby("frame", sort=True)[event_time].max().tolist() if event_time else None
        motions = rows[moves].iloc[starts].to_dict("records") if moves else None
        resets = np.logical_or.reduceat(rows["reset"].to_numpy(bool), starts) if "reset" in rows else None
        for k, (a, b, frame) in enumerate(zip(starts.tolist(), ends, frames, strict=True)):
            seen_s = pd.Timestamp(times[k]).timestamp() if event_time else None
            last_s = max(last_s, seen_s or 0.0)
            if resets is not None and resets[k]:
                tracker = Tracker(options, last_frame=int(frame) - 1)
            found = tracker.advance(int(frame), held[a:b][shown[a:b]].tolist(), seen_s, Motion(**motions[k]) if moves else STILL)
            out += [(int(frame), t, p, s, *box) for t, p, s, box in found]
            if len(out) >= OUT_ROWS:
                yield table(key[0], out)
                out = []
            tracker.finalised.clear()
        packed = [[float(t.track_id), float(t.person_id), float(t.hits), float(t.misses), *map(float, t.box), t.seen_s] for t in tracker.tracks]
        state.update((packed, tracker.next_id, tracker.next_person, tracker.last_frame))
        if event_time:
            silent_ms = int((max([last_s, *(t.seen_s for t in tracker.tracks)]) + options.timeout_s) * 1000)
            state.setTimeoutTimestamp(max(silent_ms, state.getCurrentWatermarkMs() + 1))
        yield table(key[0], out)

    def table(source, out):
        found = pd.DataFrame(out, columns=["frame", "track_id", "person_id", "state", *boxes])
        found.insert(0, "source", source)
        return found

    timeout = GroupStateTimeout.EventTimeTimeout if event_time else GroupStateTimeout.NoTimeout
    return detections.groupBy("source").applyInPandasWithState(run, TRACK_SCHEMA, "tracks array<array<double>>, next_id long, next_person long, last_frame long", "append", timeout)


def latest_state(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, for sinks that keep only the newest."""
    from pyspark.sql import functions as F

    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")
