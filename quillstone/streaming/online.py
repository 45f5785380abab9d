"""Online operators: frame segmentation, latest snapshots, liveness and stalls.

The segmentation's state machine is one pure class; batch tables run it per video in grouped pandas, streams with typed state (``streaming.stateful``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Segmenter:
    """Anchor hysteresis over frames (t, phash, gray, sharpness) that are pushed in time order.

    A frame differs from the anchor by Hamming distance or mean pixel difference. ``confirm`` differing samples in a row confirm a change, whose
    boundary is the first of them: it becomes the new anchor, and the confirming frame is judged against it. A run that falls back to the anchor
    leaves no trace. Of each segment the sharpest frame is kept. A segment under ``least`` seconds only lengthens the one before. ``wild_run``
    frames in a row that differ greatly from the frame before them cut the track off where that run began. Many segments of short mean
    length, or more than ``pages`` unlike pages, withdraw all segments. The last segment ends at the video's duration.
    """

    bits: int = 10
    pixels: float = 0.06
    confirm: int = 2
    least: float = 1.0
    wild: float = 0.5
    wild_run: int = 3
    flicker: int = 8
    flicker_mean: float = 5.0
    near: int = 5
    pages: int = 500
    anchor: tuple | None = None
    sharpest: tuple | None = None
    pending: tuple | None = None
    waiting: int = 0
    last: tuple | None = None
    wild_seen: int = 0
    wild_from: float = 0.0
    cut_at: float | None = None
    flooded: bool = False
    first_t: float | None = None
    frames: int = 0
    done: list = field(default_factory=list)
    hashes: list = field(default_factory=list)

    @staticmethod
    def bits_apart(a: tuple, b: tuple) -> int:
        return ((int(a[1]) ^ int(b[1])) & (1 << 64) - 1).bit_count()

    @staticmethod
    def pixels_apart(a: tuple, b: tuple) -> float:
        return sum(abs(float(x) - float(y)) for x, y in zip(a[2], b[2])) / len(a[2]) / 255 if a[2] and b[2] else 0.0

    def _differs(self, frame: tuple) -> bool:
        return self.bits_apart(self.anchor, frame) >= self.bits or self.pixels_apart(self.anchor, frame) >= self.pixels

    def _begin(self, frame: tuple) -> None:
        self.anchor = self.sharpest = frame

    def _offer(self, frame: tuple) -> None:
        if frame[3] > self.sharpest[3]:
            self.sharpest = frame

    def _close(self, end: float) -> None:
        if self.anchor is None or end <= self.anchor[0]:
            return
        shown = self.sharpest if self.sharpest[0] < end else self.anchor
        if self.done and end - self.anchor[0] < self.least:
            self.done[-1]["end"] = end
            return
        if all(self.bits_apart(shown, (0, h)) > self.near for h in self.hashes):
            if len(self.hashes) >= self.pages:
                self.flooded = True
                return
            self.hashes.append(int(shown[1]))
        self.done.append({"start": self.anchor[0], "end": end, "best_t": shown[0], "phash": int(shown[1])})

    def push(self, frame: tuple) -> bool:
        """Take the next frame; false once no later frame counts."""
        if self.flooded or self.cut_at is not None:
            return False
        self.frames += 1
        self.first_t = frame[0] if self.first_t is None else self.first_t
        leap = self.last is not None and self.pixels_apart(self.last, frame) >= self.wild
        self.wild_seen = self.wild_seen + 1 if leap else 0
        if self.wild_seen == 1:
            self.wild_from = frame[0]
        self.last = frame
        if self.wild_seen >= self.wild_run:
            self.cut_at, self.pending = self.wild_from, None
            self._close(self.cut_at)
            return False
        if self.anchor is None:
            self._begin(frame)
        elif not self._differs(frame):
            self.pending = None
            self._offer(frame)
        elif self.pending is None:
            self.pending, self.waiting = frame, 1
        else:
            self.waiting += 1
            if self.waiting >= self.confirm:
                first, self.pending = self.pending, None
                self._close(first[0])
                if not self.flooded:
                    self._begin(first)
                    if self._differs(frame):
                        self.pending, self.waiting = frame, 1
                    else:
                        self._offer(frame)
        return not self.flooded

    def length(self) -> float:
        """The duration that the frames' spacing tells: as many mean steps as frames."""
        return 0.0 if self.last is None else self.last[0] + (self.last[0] - self.first_t) / max(1, self.frames - 1)

    def finish(self, duration: float | None = None) -> list[dict]:
        """The segments, the last one up to ``duration`` (without it, to ``length()``)."""
        self.pending = None
        if self.last is not None and self.cut_at is None and not self.flooded:
            self._close(self.length() if duration is None else duration)
        if self.withdrawn():
            self.done = []
        return self.done

    def withdrawn(self) -> bool:
        """Whether the track is no slides at all: too many pages, or segments that change too fast."""
        spans = [x["end"] - x["start"] for x in self.done]
        return self.flooded or self.cut_at is None and len(spans) >= self.flicker and sum(spans) / len(spans) < self.flicker_mean


_SEGMENT = "start double, end double, best_t double, phash bigint"


def frame_of(row) -> tuple:
    return float(row[0]), int(row[1]), [float(x) for x in row[2]] if row[2] is not None else [], float(row[3])


def segment_frames(frames: DataFrame, video: str = "video", duration: str | None = None, **settings) -> DataFrame:
    """(video, start, end, best_t, phash) of a batch table of frames (video, t, phash, gray64, lap).

    ``duration`` names a column with the video's length; without it the frames' spacing tells. A video's frames meet in one task, where the machine's
    state holds three frames.
    """
    columns = ["t", "phash", "gray64", "lap"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = Segmenter(**settings)
        for row in pdf.sort_values("t", kind="stable")[columns].itertuples(index=False):
            if not s.push(frame_of(row)):
                break
        v = pdf[video].iloc[0]
        got = s.finish(None if duration is None else float(pdf[duration].max()))
        return pd.DataFrame([(v, x["start"], x["end"], x["best_t"], x["phash"]) for x in got], columns=[video, "start", "end", "best_t", "phash"])

    return frames.groupBy(video).applyInPandas(run, f"`{video}` {frames.schema[video].dataType.simpleString()}, {_SEGMENT}")


def millis(span: str) -> int:
    n, unit = span.split()
    return int(float(n) * {"second": 1000, "minute": 60_000, "hour": 3_600_000}[unit.rstrip("s")])


def frame_shortfall(seen: DataFrame, expected: Column) -> DataFrame:
    """Adds short: fewer frames than expected by more than 2 and more than a tenth."""
    return seen.withColumn("short", F.col("frames") < expected - F.greatest(F.lit(2.0), expected * 0.1))


def latest_snapshot(log: DataFrame, key: str = "event", delay: str | None = None) -> DataFrame:
    """The newest progress row per event, for batch tables and streams (update mode).

    ``delay`` sets a watermark on ts, an addition for logs that are replayed out of order.
    """
    rows = log.withWatermark("ts", delay) if delay else log
    last = F.max_by(F.struct(*[c for c in log.columns if c != key]), "ts")
    return rows.groupBy(key).agg(last.alias("s"), F.count(F.lit(1)).alias("n_rows")).select(key, "s.*", "n_rows")


def upsert_snapshot(batch: DataFrame, epoch: int, path: str, key: str = "event", order: str = "ts") -> None:
    """A ``foreachBatch`` sink: keeps the batch's rows as a log of epochs and merges them into the snapshot, one row a key, the newest by ``order``.

    An epoch that runs again replaces its log and leaves the snapshot as it is. ``KeyedSnapshot(spark, f"{path}/snapshot", key, order).read()`` reads the snapshot.
    """
    from quillstone.streaming.snapshots import KeyedSnapshot

    batch.write.mode("overwrite").json(f"{path}/log/epoch={epoch}")
    KeyedSnapshot(batch.sparkSession, f"{path}/snapshot", key, order).upsert(batch, epoch)


def current_state(snapshots: DataFrame, live: DataFrame, key: str = "event") -> DataFrame:
    """Snapshots where ``running`` without a live process reads as ``stopped``."""
    a = live.select(F.col(key).alias("__k")).distinct()
    out = snapshots.join(a, F.col(key) == F.col("__k"), "left")
    return out.withColumn("status", F.when((F.col("status") == "running") & F.col("__k").isNull(), "stopped").otherwise(F.col("status"))).drop("__k")


def next_stage(stages: DataFrame, run: str = "run") -> DataFrame:
    """Per run the first stage that hasn't passed."""
    return stages.where(F.col("status") != "passed").groupBy(run).agg(F.min_by("stage", "ordinal").alias("next_stage"))


def ready_tasks(tasks: DataFrame, needs: DataFrame, done: DataFrame, many: int = 1_000_000) -> DataFrame:
    """Tasks not done whose needs (task, needs) all are.

    A need of more than ``many`` rows would fill one task of a join; such needs are few, one for each ``many`` rows at most, so they are told to all tasks.
    """
    d = done.select(F.col("task").alias("__d")).distinct()
    often = needs.groupBy(F.col("needs").alias("__n")).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > many)
    often = often.join(d, F.col("__n") == F.col("__d"), "left").select("__n", F.col("__d").isNotNull().alias("__met"), F.lit(True).alias("__often"))
    told = needs.join(F.broadcast(often), F.col("needs").eqNullSafe(F.col("__n")), "left")
    rest = told.where("__often IS NULL").select("task", "needs").join(d, F.col("needs") == F.col("__d"), "left_anti")
    unmet = told.where("NOT __met").select("task").unionAll(rest.select("task")).select(F.col("task").alias("__u")).distinct()
    return tasks.join(d, F.col("task") == F.col("__d"), "left_anti").join(unmet, F.col("task") == F.col("__u"), "left_anti")
