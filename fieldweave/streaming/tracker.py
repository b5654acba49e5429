"""The tracker on a stream: the state of a clip is its tracks, and frames wait there until they are complete.

Event time holds frames back: a frame is taken when the watermark has passed it, in order of time, whatever micro-batches
its rows came in. A clip that has been silent for long gives its state back.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..kernels.tracker import FieldTracker, Track, TrackerOptions
from ..operators.tracking import frames

OUT = "video_timestamp double, field_x double, field_y double, track_id string, team string, vx double, vy double, crowd_burst boolean"
_WAITING = "at long, video_timestamp double, field_x double, field_y double, confidence double, team string, appearance array<double>, width double, height double"
_COLUMNS = [x.split()[0] for x in _WAITING.split(", ")]
_TRACK = "id long, x double, y double, vx double, vy double, at double, confidence double, team string, appearance array<double>, box array<double>, missed int"
_HEAD = "next_id long, last long, counts array<int>"


class _ClipTracker(StatefulProcessor):
    """Rows wait in one list, tracks are another; the head has the next id, the last frame taken and the counts of the frames before."""

    def __init__(self, clip: str, options: TrackerOptions, silence_ms: int) -> None:
        self.clip, self.options, self.silence_ms = clip, options, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.tracks = handle.getListState("tracks", _TRACK)
        self.head = handle.getValueState("head", _HEAD)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new, known = [], set(self.handle.listTimers())
        for part in rows:
            new += [tuple(None if v is None or isinstance(v, float) and np.isnan(v) else v for v in r) for r in part[_COLUMNS].itertuples(index=False, name=None)]
        for at in sorted({r[0] for r in new} - known):
            self.handle.registerTimer(at)
        self.waiting.appendList(new)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = list(self.waiting.get())
        due = [r for r in rows if r[0] <= now]
        head = self.head.get() if self.head.exists() else None
        if due:
            left = [r for r in rows if r[0] > now]
            self.waiting.put(left) if left else self.waiting.clear()
            tracker = self._tracker(head)
            yield self._taken(key, tracker, pd.DataFrame(due, columns=_COLUMNS))
            self._kept(tracker, max(r[0] for r in due))
            self.handle.registerTimer(max(r[0] for r in due) + self.silence_ms)
        elif not rows and head is not None and head[1] + self.silence_ms <= now:
            for state in (self.waiting, self.tracks, self.head):
                state.clear()

    def _tracker(self, head: tuple | None) -> FieldTracker:
        if head is None:
            return FieldTracker(self.options)
        array = lambda v: None if v is None else np.array(v, float)
        tracks = [Track(r[0], np.array(r[1:3]), np.array(r[3:5]), r[5], r[6], r[7], array(r[8]), array(r[9]), r[10]) for r in self.tracks.get()]
        return FieldTracker(self.options, tracks, list(head[2]), head[0])

    def _kept(self, tracker: FieldTracker, last: int) -> None:
        listed = lambda v: None if v is None else [float(x) for x in v]
        rows = [(t.id, *map(float, (*t.place, *t.velocity, t.at, t.confidence)), t.team, listed(t.appearance), listed(t.box), t.missed) for t in tracker.tracks]
        self.tracks.put(rows) if rows else self.tracks.clear()
        self.head.update((tracker.next_id, last, [int(c) for c in tracker.counts]))

    def _taken(self, key: tuple, tracker: FieldTracker, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["video_timestamp", "field_x", "field_y"], kind="stable").reset_index(drop=True)
        if rows["width"].notna().any():
            rows = rows.assign(x1=0.0, y1=0.0, x2=rows["width"].fillna(0.0), y2=rows["height"].fillna(0.0))
        out = []
        for at, detections in frames(rows):
            ids = tracker.update(detections)
            now = {t.id: t for t in tracker.tracks}
            for i, track in zip(range(at.start, at.stop), ids.tolist()):
                if track > 0:
                    t = now[track]
                    out.append((key[0], *rows.loc[i, ["video_timestamp", "field_x", "field_y"]], f"{key[0]}:t{track}", t.team, *map(float, t.velocity), bool(tracker.burst)))
        return pd.DataFrame(out, columns=[self.clip, *(x.split()[0] for x in OUT.split(", "))])

    def close(self) -> None:
        pass


def tracked_stream(stream: DataFrame, clip: str, at: str, late: str = "2 seconds", silence_s: float = 60.0, options: TrackerOptions = TrackerOptions()) -> DataFrame:
    """Rows of a stream of detections with the ids of their tracks, as `operators.tracking.tracked` gives them for complete clips.

    stream has clip, video_timestamp, field_x, field_y, the time `at` (a timestamp, the same for all rows of a frame, in whole
    milliseconds) and, if it likes, confidence, team, appearance, and a box (x1, y1, x2, y2). Rows may come in any order and frames in parts, at
    most `late` behind; what comes later is left out. A clip of which nothing came for `silence_s` begins anew.
    The session's state store must be one that has timers: spark.sql.streaming.stateStore.providerClass for RocksDB.
    """
    from pyspark.sql import functions as F

    has = lambda name, kind, default=None: (F.col(name).cast(kind) if name in stream.columns else F.lit(default).cast(kind)).alias(name)
    boxed = {"x1", "y1", "x2", "y2"} <= set(stream.columns)
    size = [((F.col(b) - F.col(a)).cast("double") if boxed else F.lit(None).cast("double")).alias(c) for a, b, c in (("x1", "x2", "width"), ("y1", "y2", "height"))]
    marked = stream.withWatermark(at, late)
    places = [F.col(c).cast("double").alias(c) for c in ("video_timestamp", "field_x", "field_y")]
    rows = marked.select(F.col(clip), F.unix_millis(at).alias("at"), *places, has("confidence", "double", 1.0), has("team", "string", "unknown"), has("appearance", "array<double>"), *size, F.col(at).alias("_time"))
    kept = rows.select(clip, "at", "video_timestamp", "field_x", "field_y", "confidence", "team", "appearance", "width", "height", "_time")
    return kept.groupBy(clip).transformWithStateInPandas(_ClipTracker(clip, options, round(1000 * silence_s)), f"`{clip}` string, {OUT}", "append", "EventTime")
