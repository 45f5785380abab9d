"""Streams with typed state and timers: frame segments, stalls, zones.

Each is a ``StatefulProcessor`` over pandas batches of a key. State is typed values and lists, read and written by field; a timer of processing time ends what no
row ends. Spark keeps such state in RocksDB only, so the session names
``org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider`` as ``spark.sql.streaming.stateStore.providerClass``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillstone.streaming.online import Segmenter, frame_of, millis

_FRAME = "t double, phash bigint, gray array<double>, sharpness double"
_SEGMENT = "start double, end double, best_t double, phash bigint"


def _rest(timer, handle: StatefulProcessorHandle, idle: int) -> None:
    """One timer a key: the key is idle once nothing has come for ``idle`` milliseconds."""
    for at in list(handle.listTimers()):
        handle.deleteTimer(at)
    handle.registerTimer(timer.getCurrentProcessingTimeInMs() + idle)


class _Segments(StatefulProcessor):
    """The segmentation's machine: three frames and some numbers as values, closed segments as a list that is only added to; of the segments the last is a value, as it may still lengthen."""

    NUMBERS = ("waiting", "wild_seen", "wild_from", "cut_at", "flooded", "first_t", "frames")

    def __init__(self, idle: int, settings: dict):
        self.idle, self.settings = idle, settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = {n: handle.getValueState(n, _FRAME) for n in ("anchor", "sharpest", "pending", "last")}
        self.numbers = handle.getValueState("numbers", "waiting int, wild_seen int, wild_from double, cut_at double, flooded boolean, first_t double, frames bigint")
        self.newest = handle.getValueState("newest", _SEGMENT)
        self.closed = handle.getListState("closed", _SEGMENT)
        self.pages = handle.getListState("pages", "phash bigint")

    def _load(self) -> Segmenter:
        s = Segmenter(**self.settings)
        for n, state in self.held.items():
            if state.exists():
                t, h, gray, sharp = state.get()
                setattr(s, n, (t, h, list(gray), sharp))
        if self.numbers.exists():
            for n, v in zip(self.NUMBERS, self.numbers.get()):
                setattr(s, n, v)
        if self.newest.exists():
            s.done = [dict(zip(("start", "end", "best_t", "phash"), self.newest.get()))]
        s.hashes = [r[0] for r in self.pages.get()]
        return s

    def _store(self, s: Segmenter, pages: int) -> None:
        for n, state in self.held.items():
            frame = getattr(s, n)
            if frame is None:
                state.clear()
            else:
                state.update(frame)
        self.numbers.update(tuple(getattr(s, n) for n in self.NUMBERS))
        row = lambda d: (d["start"], d["end"], d["best_t"], d["phash"])
        if len(s.done) > 1:
            self.closed.appendList([row(d) for d in s.done[:-1]])
        if s.done:
            self.newest.update(row(s.done[-1]))
        if len(s.hashes) > pages:
            self.pages.appendList([(h,) for h in s.hashes[pages:]])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s = self._load()
        pages = len(s.hashes)
        for pdf in rows:
            for row in pdf.sort_values("t", kind="stable")[["t", "phash", "gray64", "lap"]].itertuples(index=False):
                s.push(frame_of(row))
        self._store(s, pages)
        _rest(timerValues, self.handle, self.idle)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self._load()
        s.done = [dict(zip(("start", "end", "best_t", "phash"), r)) for r in self.closed.get()] + s.done
        found = s.finish()
        for state in (*self.held.values(), self.numbers, self.newest, self.closed, self.pages):
            state.clear()
        yield pd.DataFrame([(key[0], x["start"], x["end"], x["best_t"], x["phash"]) for x in found], columns=["video", "start", "end", "best_t", "phash"])

    def close(self) -> None:
        pass


def segment_stream(frames: DataFrame, idle: str = "1 minute", **settings) -> DataFrame:
    """Segments (video, start, end, best_t, phash) of a stream of frames (video, t, phash, gray64, lap), once none of a video has come for ``idle``; frames arrive in time order."""
    return frames.groupBy("video").transformWithStateInPandas(_Segments(millis(idle), settings), f"video string, {_SEGMENT}", "Append", "ProcessingTime")


class _Stalls(StatefulProcessor):
    def __init__(self, idle: int, key: str):
        self.idle, self.key = idle, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.seen = handle, handle.getValueState("seen", "n bigint, last double")

    def _row(self, key, state: str, n: int, last) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]], "state": [state], "n_rows": [n], "last_ts": [last]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, last = self.seen.get() if self.seen.exists() else (0, None)
        for pdf in rows:
            n += len(pdf)
            top = pdf["ts"].max()
            last = top if last is None else max(last, top)
        self.seen.update((n, float(last)))
        _rest(timerValues, self.handle, self.idle)
        yield self._row(key, "running", n, last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, last = self.seen.get()
        self.seen.clear()
        yield self._row(key, "stalled", n, last)

    def close(self) -> None:
        pass


def stall_stream(log: DataFrame, idle: str = "10 minutes", key: str = "event") -> DataFrame:
    """(event, state, n_rows, last_ts) of a progress stream (event, ts): ``running`` after each batch of an event's rows, ``stalled`` once none has come for ``idle``; it then runs anew."""
    kind = log.schema[key].dataType.simpleString()
    return log.groupBy(key).transformWithStateInPandas(_Stalls(millis(idle), key), f"`{key}` {kind}, state string, n_rows bigint, last_ts double", "Append", "ProcessingTime")


class _Zones(StatefulProcessor):
    def __init__(self, key: str, order: list[str], value: str, limit: float, ttl: int | None):
        self.key, self.order, self.value, self.limit, self.ttl = key, order, value, limit, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "side string, zone string", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before, zone = self.now.get() if self.now.exists() else (None, None)
        pdf = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        zones = []
        for x in pdf[self.value]:
            side = "high" if x >= self.limit else "low"
            zone = side if before in (None, side) else zone
            zones.append(zone)
            before = side
        self.now.update((before, zone))
        yield pdf[[self.key, *self.order, self.value]].assign(zone=zones)

    def close(self) -> None:
        pass


def zone_stream(samples: DataFrame, key: str, order: list[str], value: str, limit: float, forget: str | None = None) -> DataFrame:
    """The streaming twin of ``windows.zone_hysteresis``: each sample with its zone, high or low, which switches only after two readings in a row on the other side.

    A key's samples arrive in order from batch to batch; within one they are sorted by ``order``. State is two words a key, forgotten after ``forget`` without a sample; a query with such a limit runs batches without rows, as timers do.
    """
    kind = ", ".join(f"`{c}` {samples.schema[c].dataType.simpleString()}" for c in (key, *order, value))
    processor = _Zones(key, order, value, limit, None if forget is None else millis(forget))
    return samples.groupBy(key).transformWithStateInPandas(processor, f"{kind}, zone string", "Append", "None" if forget is None else "ProcessingTime")
