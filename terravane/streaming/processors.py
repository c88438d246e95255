"""Stateful processors of the streams: what one key remembers between micro-batches, in the state store.

Inside a micro-batch a key's rows go in order of arrival; what is held of them is the micro-batch's part of one key. Time that
decides anything is the events' own, so a stream's result doesn't depend on how it was cut in micro-batches.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import chain, groupby, islice
from operator import attrgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from terravane.operators import tracks

#: Rows of a frame that a processor hands on.
FRAME_ROWS = 10_000
#: Rows of a task that are packed together.
PACK_ROWS = 100_000
# Fixed values of the filters and of the back-off.
JITTER_DEG, RECOUNT_M = 1.5, 30.0
BACKOFF_BASE_MS, BACKOFF_MOST_MS = 2_000, 300_000
_FIX = ", ".join(f"{n}_ts long, {n}_lat double, {n}_lon double, {n}_accuracy double" for n in ("last", "stored", "candidate", "anchor"))
TRACK = f"{_FIX}, distance_m double, vertices long, idle boolean, started long"


def in_order(pdfs: Iterator[pd.DataFrame], order: str | list[str]) -> Iterator:
    """A micro-batch's rows of one key, in order of arrival."""
    frames = [p for p in pdfs if len(p)]
    if frames:
        frame = frames[0] if len(frames) == 1 else pd.concat(frames)
        if isinstance(order, list) or not frame[order].is_monotonic_increasing:  # most keys have a few rows, for which a sort is dear
            frame = frame.sort_values(order, kind="stable")
        yield from frame.itertuples(index=False)


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of PACK_ROWS as one for each ``bucket``, with the other columns as arrays: a row costs more in a state operator's worker than its work."""

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        table = table.take(np.argsort(table["bucket"].to_numpy(), kind="stable")).combine_chunks()
        bucket = table["bucket"].to_numpy()
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        ends = pa.array(np.r_[starts, len(bucket)], pa.int32())
        arrays = {c: pa.ListArray.from_arrays(ends, pa.concat_arrays(table[c].chunks)) for c in table.column_names if c != "bucket"}
        return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[starts], pa.int32())} | arrays)

    held: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        if batch is not None and batch.num_rows:
            held.append(batch)
        if held and (batch is None or sum(b.num_rows for b in held) >= PACK_ROWS):
            yield pack(held)
            held = []


def unpacked(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of ``packed``, as one frame."""
    frames = [p for p in pdfs if len(p)]
    if frames:
        columns = [c for c in frames[0].columns if c != "bucket"]
        yield pd.DataFrame({c: np.concatenate([a for p in frames for a in p[c]]) for c in columns})


def in_frames(rows: Iterator[tuple], columns: Sequence[str], types: dict[str, str] | None = None) -> Iterator[pd.DataFrame]:
    """``rows`` in frames of FRAME_ROWS; one empty frame if there are none."""
    frame = list(islice(rows, FRAME_ROWS))
    while True:
        out = pd.DataFrame(frame, columns=columns)
        yield out.astype(types) if types else out
        if not (frame := list(islice(rows, FRAME_ROWS))):
            return


def _missing(x) -> bool:
    return x is None or x != x


class OfKey(StatefulProcessor):
    """A processor of one key's rows, which come in the order ``order``. It runs by itself, or for many keys at once by ``InBuckets``."""

    order: str | list[str] = "arrival"
    columns: Sequence[str] = ()
    types: dict[str, str] | None = None

    def answers(self, key: tuple, rows: Iterator, timerValues) -> Iterator[tuple]:
        raise NotImplementedError

    def timed_out(self, key: tuple) -> Iterator[tuple]:
        yield from ()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from in_frames(self.answers(key, in_order(rows, self.order), timerValues), self.columns, self.types)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from in_frames(self.timed_out(key), self.columns, self.types)


class _Value:
    """One state of the key that is worked on: a place in the key's entry."""

    def __init__(self, of: _KeyHandle, place: int):
        self.of, self.place = of, place

    def exists(self) -> bool:
        return self.of.entry[self.place] is not None

    def get(self) -> tuple | None:
        return self.of.entry[self.place]

    def update(self, value: tuple | list | None) -> None:
        self.of.entry[self.place], self.of.changed = value, True

    def clear(self) -> None:
        if self.exists():
            self.update(None)


class _Items(_Value):
    """As ``_Value``, for a list."""

    def get(self) -> Iterator:
        return iter(self.of.entry[self.place] or ())

    def put(self, items: list[tuple]) -> None:
        self.update(items)


class _KeyHandle:
    """The handle of a processor whose keys share a group: an entry of one map holds all states of a key, and the time of its timer, so it is read once and written once.

    Of the keys' timers, one each at most, the group has one, at the earliest or before it.
    """

    def __init__(self, handle: StatefulProcessorHandle):
        self.handle, self.fields, self.ttl_ms = handle, ["key_timer long"], None
        self.entry, self.changed, self.known, self.least = [], False, False, None

    def _state(self, kind: type, field: str):
        self.fields.append(field)
        return kind(self, len(self.fields) - 1)

    def getValueState(self, name: str, schema: str, ttl_ms: int | None = None) -> _Value:
        self.ttl_ms = ttl_ms or self.ttl_ms
        return self._state(_Value, f"{name} struct<{schema}>")

    def getListState(self, name: str, schema: str) -> _Items:
        return self._state(_Items, f"{name} array<struct<{schema}>>")

    def open(self, kind: str) -> None:
        """After the processor has asked for its states."""
        self.entries = self.handle.getMapState("entries", f"key {kind}", ", ".join(self.fields), self.ttl_ms)

    def begin(self, key) -> None:
        self.key, entry = (key,), self.entries.getValue((key,))
        self.known, self.changed = entry is not None, False
        self.entry = list(entry) if self.known else [None] * len(self.fields)

    def listTimers(self) -> Iterator[int]:
        return iter(() if self.entry[0] is None else (self.entry[0],))

    def deleteTimer(self, at: int) -> None:
        self.entry[0], self.changed = None, True

    def registerTimer(self, at: int) -> None:
        self.entry[0], self.changed = at, True

    def end(self) -> None:
        if self.changed and any(x is not None for x in self.entry):
            self.entries.updateValue(self.key, tuple(self.entry))
        elif self.changed and self.known:
            self.entries.removeKey(self.key)
        self._soonest(self.entry[0])

    def _soonest(self, at: int | None) -> None:
        if at is not None:
            self.least = at if self.least is None else min(self.least, at)

    def set_timer(self, over: int | None = None) -> None:
        """Moves the group's timer to the earliest of the keys since the last call, if it isn't before that. ``over``: a timer that has run out."""
        if self.least is not None:
            now_at = [at for at in self.handle.listTimers() if at != over]
            if not now_at or self.least < min(now_at):
                for at in now_at:
                    self.handle.deleteTimer(at)
                self.handle.registerTimer(self.least)
        self.least = None

    def due(self, up_to: int) -> list:
        """The keys whose time is at or before ``up_to``; the others count for ``set_timer``."""
        out = []
        for key, entry in self.entries.iterator():
            if entry[0] is not None and entry[0] <= up_to:
                out.append(key[0])
            else:
                self._soonest(entry[0])
        return out


class InBuckets(StatefulProcessor):
    """Runs a processor of one key for all keys of a bucket, with its states in a map by key.

    A group costs a few milliseconds in every micro-batch for its frames, a key of a bucket only the two calls that read and write its entry.
    """

    #: The bucket of rows without a key.
    NO_KEY = -1

    def __init__(self, processor: OfKey, key: str, kind: str, time: str, is_packed: bool = False):
        self.processor, self.key, self.kind, self.time, self.is_packed = processor, key, kind, time, is_packed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.of_key = _KeyHandle(handle)
        self.processor.init(self.of_key)
        self.of_key.open(self.kind)

    def _frames(self, rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        return in_frames(rows, self.processor.columns, self.processor.types)

    def _called(self, bucket: tuple, key) -> tuple:
        return (None,) if bucket[0] == self.NO_KEY else (key,)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        order = self.processor.order

        def answers() -> Iterator[tuple]:
            for own, its in groupby(in_order(unpacked(rows) if self.is_packed else rows, [self.key, *([order] if isinstance(order, str) else order)]), attrgetter(self.key)):
                self.of_key.begin(own)
                yield from self.processor.answers(self._called(key, own), its, timerValues)
                self.of_key.end()
            self.of_key.set_timer()

        yield from self._frames(answers())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() if self.time == "EventTime" else timerValues.getCurrentProcessingTimeInMs()

        def rows() -> Iterator[tuple]:
            for own in self.of_key.due(max(now - 1, expiredTimerInfo.getExpiryTimeInMs())):
                self.of_key.begin(own)
                self.of_key.deleteTimer(0)  # its time has come
                yield from self.processor.timed_out(self._called(key, own))
                self.of_key.end()
            self.of_key.set_timer(expiredTimerInfo.getExpiryTimeInMs())

        yield from self._frames(rows())


class Recorder(OfKey):
    """The track recorder: a track's ``tracks.State``, and a timer that closes it after a silence, if one is asked for.

    ``silence``: None, or (milliseconds, "processing"), with a timer of the clock that runs on.
    """

    columns = [c.split()[0] for c in tracks.DECISIONS.split(", ")]
    types = {"arrival": "Int64", "v_ts": "Int64"}

    def __init__(self, silent_ms: int | None = None):
        self.silent_ms = silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.track = handle.getValueState("track", TRACK)

    def _tail(self, key: tuple, s: tracks.State) -> Iterator[tuple]:
        if vertex := tracks.tail(s):
            yield (key[0], None, "TAIL", s.idle, s.distance_m, s.vertices, *vertex[:3])

    def _set_timer(self, at: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if at is not None:
            self.handle.registerTimer(at)

    def answers(self, key, rows, timerValues) -> Iterator[tuple]:
        known = self.track.get()
        s = tracks.State.of(tuple(known)) if known else tracks.State()
        open_ = True
        for row in rows:
            if row.stop is True or row.stop == 1:
                yield from self._tail(key, s)
                s, open_ = tracks.State(), False
            else:
                open_ = True
                yield from tracks.decide(key[0], s, iter([row]), finish=False)
        if open_:
            self.track.update(s.flat())
        elif known:
            self.track.clear()
        if self.silent_ms:
            self._set_timer(timerValues.getCurrentProcessingTimeInMs() + self.silent_ms if open_ else None)

    def timed_out(self, key) -> Iterator[tuple]:
        if self.track.exists():
            yield from self._tail(key, tracks.State.of(tuple(self.track.get())))
        self.track.clear()


class Closer(OfKey):
    """Closes tracks after a silence in event time: when a fix comes too long after the last one, or when the watermark is that far."""

    columns = ["track_id", "started_at", "ended_at", "fixes"]

    def __init__(self, silent_ms: int):
        self.silent_ms = silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "started_at long, ended_at long, fixes long")

    def answers(self, key, rows, timerValues) -> Iterator[tuple]:
        known = self.open.get()
        started, ended, n = known or (None, None, 0)
        for row in rows:
            ts = int(row.ts)
            if n and ts - ended > self.silent_ms:
                yield key[0], started, ended, n
                n = 0
            started, ended, n = (min(started, ts), max(ended, ts), n + 1) if n else (ts, ts, 1)
        if known and n:  # an open track has one timer, at the end that it had
            self.handle.deleteTimer(known[1] + self.silent_ms)
        if n:
            self.open.update((started, ended, n))
            self.handle.registerTimer(ended + self.silent_ms)

    def timed_out(self, key) -> Iterator[tuple]:
        if self.open.exists():
            yield key[0], *self.open.get()
        self.open.clear()


class Steady(OfKey):
    """Headings that differ from the last one passed on by more than JITTER_DEG."""

    columns = ["device", "arrival", "heading"]

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "heading double", self.ttl_ms)

    def answers(self, key, rows, timerValues) -> Iterator[tuple]:
        known = self.last.get()
        last = known[0] if known else None
        for row in rows:
            d = None if last is None else abs(row.heading - last) % 360.0
            if d is None or min(d, 360.0 - d) > JITTER_DEG:
                last = float(row.heading)
                yield key[0], int(row.arrival), last
        if last is not None:
            self.last.update((last,))


class Recount(OfKey):
    """Fixes at which a nearby count is due: the first, and each that is RECOUNT_M from the last one passed on."""

    columns = ["track_id", "arrival", "lat", "lon"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "lat double, lon double")

    def answers(self, key, rows, timerValues) -> Iterator[tuple]:
        known = self.last.get()
        last = tuple(known) if known else None
        for row in rows:
            here = (0, float(row.lat), float(row.lon), None)
            if last is None or tracks.metres((0, *last, None), here) >= RECOUNT_M:
                last = here[1:3]
                yield key[0], int(row.arrival), *last
        if last is not None:
            self.last.update(last)


class Streaks(OfKey):
    """A host's running streak of refusals and until when it is blocked."""

    order = ["at_ms", "id"]
    columns = ["host", "id", "streak", "blocked_until"]
    types = {"blocked_until": "Int64"}

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.streak = handle.getValueState("streak", "streak long", self.ttl_ms)

    def answers(self, key, rows, timerValues) -> Iterator[tuple]:
        known = self.streak.get()
        streak = int(known[0]) if known else 0
        for row in rows:
            until = None
            if not _missing(row.status) and int(row.status) in (429, 503):
                streak += 1
                asked = 0 if _missing(row.retry_after_s) else int(row.retry_after_s) * 1000
                until = int(row.at_ms) + max(min(BACKOFF_MOST_MS, BACKOFF_BASE_MS * 2 ** min(streak - 1, 20)), min(BACKOFF_MOST_MS, asked))
            else:
                streak = 0
            yield key[0], int(row.id), streak, until
        self.streak.update((streak,))


class MarksAtFixes(OfKey):
    """As-of join of two streams: a mark gets the last fix at or before it.

    A track's clock is its latest fix, less ``late_ms``: fixes before it have all come. A mark up to the clock is answered at once,
    a later one waits for the clock, or for the track's stop row, which answers all and drops the state. Fixes are held ``hold_ms`` behind the
    clock, and the last one before that; a mark that is older than all of these gets no fix.
    """

    order = "at"
    columns = ["track_id", "mark_id", "ts", "lat", "lon", "fix_ts"]
    types = {"fix_ts": "Int64"}

    def __init__(self, late_ms: int, hold_ms: int):
        self.late_ms, self.hold_ms = late_ms, hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fixes = handle.getListState("fixes", "ts long, arrival long, lat double, lon double")
        self.marks = handle.getListState("marks", "ts long, mark_id long")

    def answers(self, key, rows, timerValues) -> Iterator[tuple]:
        fixes = [tuple(r) for r in self.fixes.get()] if self.fixes.exists() else []
        waiting = [tuple(r) for r in self.marks.get()] if self.marks.exists() else []
        for row in rows:
            if row.kind == 0:
                fixes.append((int(row.ts), int(row.arrival), float(row.lat), float(row.lon)))
            elif row.kind == 1:
                waiting.append((int(row.ts), int(row.mark_id)))
            else:
                yield from self._answered(key, sorted(fixes), waiting)
                fixes, waiting = [], []
        fixes.sort()
        clock = fixes[-1][0] - self.late_ms if fixes else None
        if clock is not None:
            yield from self._answered(key, fixes, [m for m in waiting if m[0] <= clock])
            waiting = [m for m in waiting if m[0] > clock]
            fixes = fixes[max(bisect_right(fixes, (clock - self.hold_ms, float("inf"))) - 1, 0) :]
        for state, held in ((self.fixes, fixes), (self.marks, waiting)):
            if held:
                state.put(held)
            elif state.exists():
                state.clear()

    def _answered(self, key: tuple, fixes: list[tuple], marks: list[tuple]) -> Iterator[tuple]:
        for ts, mark_id in marks:
            at = bisect_right(fixes, (ts, float("inf"))) - 1
            yield (key[0], mark_id, ts, *((fixes[at][2], fixes[at][3], fixes[at][0]) if at >= 0 else (None, None, None)))
