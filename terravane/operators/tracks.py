"""Cleaning, thinning and measuring of GPS tracks: one step function, used by the batch operator and by the stream."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.functions import geo
from terravane.operators import scan

# Fixed values of the recorder.
WORST_ACCURACY_M = 50.0
FASTEST_M_S = 15.0
IDLE_RADIUS_M, IDLE_AFTER_MS = 10.0, 60_000
LEAST_STEP_M, LEAST_STORED_M = 3.0, 10.0
MOVING_EVERY_S, IDLE_EVERY_S = 5, 30

Fix = tuple[int, float, float, float | None]  # ts, lat, lon, accuracy


def metres(a: Fix, b: Fix) -> float:
    half_lat, half_lon = math.radians(b[1] - a[1]) / 2, math.radians(b[2] - a[2]) / 2
    h = math.sin(half_lat) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(half_lon) ** 2
    return 2 * geo.EARTH_RADIUS_M * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@dataclass
class State:
    """All that a track's past leaves behind."""

    last: Fix | None = None
    stored: Fix | None = None
    candidate: Fix | None = None
    anchor: Fix | None = None
    distance_m: float = 0.0
    vertices: int = 0
    idle: bool = False
    started: int | None = None

    def flat(self) -> tuple:
        """As plain values, for a state store."""
        out: list = []
        for name in ("last", "stored", "candidate", "anchor"):
            out += list(getattr(self, name) or (None,) * 4)
        return (*out, self.distance_m, self.vertices, self.idle, self.started)

    @classmethod
    def of(cls, flat: tuple) -> State:
        known = [tuple(flat[k : k + 4]) if flat[k] is not None else None for k in (0, 4, 8, 12)]
        return cls(*known, *flat[16:])


def step(s: State, fix: Fix) -> tuple[str, Fix | None]:
    """Takes one fix, in order of arrival. Returns ACCEPTED or why it was rejected, and the vertex that it adds to the trail."""
    accuracy = fix[3]
    if accuracy is not None and accuracy > WORST_ACCURACY_M:
        return "ACCURACY", None
    if s.last is None:
        s.started, s.anchor = fix[0], fix
    else:
        elapsed, moved = fix[0] - s.last[0], metres(s.last, fix)
        if elapsed < 0:
            return "OUT_OF_ORDER", None
        if elapsed == 0:
            return ("DUPLICATE" if moved <= 0 else "JUMP"), None
        if moved / (elapsed / 1000.0) > FASTEST_M_S:
            return "JUMP", None
        if moved > max(LEAST_STEP_M, accuracy or 0.0):
            s.distance_m += moved
    s.last = fix
    if metres(s.anchor, fix) >= IDLE_RADIUS_M:
        s.anchor, s.idle = fix, False
    elif fix[0] - s.anchor[0] >= IDLE_AFTER_MS:
        s.idle = True
    return "ACCEPTED", _trail(s, fix)


def _trail(s: State, fix: Fix) -> Fix | None:
    """A vertex waits until a later fix confirms that the track really left the last one."""
    vertex = None
    if s.stored is None:
        vertex = fix
    else:
        least = max(LEAST_STORED_M, fix[3] or 0.0)
        if metres(s.stored, fix) < least:
            s.candidate = None
        elif s.candidate is None:
            s.candidate = fix
        else:
            vertex, s.candidate = s.candidate, None
            if metres(vertex, fix) >= least:
                s.candidate = fix
    if vertex is not None:
        s.stored, s.vertices = vertex, s.vertices + 1
    return vertex


def tail(s: State) -> Fix | None:
    """The vertex that ends a track: the one that waits, else the last fix, unless the last vertex stands there."""
    end = s.candidate or s.last
    if end is None or (s.stored is not None and s.stored[1:3] == end[1:3]):
        return None
    s.stored, s.candidate, s.vertices = end, None, s.vertices + 1
    return end


DECISIONS = "track_id long, arrival long, decision string, idle boolean, distance_m double, vertices long, v_ts long, v_lat double, v_lon double"


def _fix(row) -> Fix:
    accuracy = None if row.accuracy_m is None or row.accuracy_m != row.accuracy_m else float(row.accuracy_m)
    return int(row.ts), float(row.lat), float(row.lon), accuracy


def decide(track_id: int, s: State, rows: Iterator, finish: bool) -> list[tuple]:
    out = []
    for row in rows:
        decision, vertex = step(s, _fix(row))
        out.append((track_id, int(row.arrival), decision, s.idle, s.distance_m, s.vertices, *(vertex[:3] if vertex else (None, None, None))))
    if finish and (vertex := tail(s)):
        out.append((track_id, None, "TAIL", s.idle, s.distance_m, s.vertices, *vertex[:3]))
    return out


def _of_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (track_id, arrival): the state of one track is all that is held."""
    columns = [c.split()[0] for c in DECISIONS.split(", ")]
    track, s = None, State()
    for batch in batches:
        out: list[tuple] = []
        for row in batch.itertuples(index=False):
            if row.track_id != track:
                if track is not None and (vertex := tail(s)):
                    out.append((track, None, "TAIL", s.idle, s.distance_m, s.vertices, *vertex[:3]))
                track, s = row.track_id, State()
            out += decide(track, s, iter([row]), finish=False)
        yield pd.DataFrame(out, columns=columns).astype({"arrival": "Int64", "v_ts": "Int64"})
    if track is not None and (vertex := tail(s)):
        yield pd.DataFrame([(track, None, "TAIL", s.idle, s.distance_m, s.vertices, *vertex[:3])], columns=columns).astype({"arrival": "Int64", "v_ts": "Int64"})


def record(fixes: DataFrame) -> DataFrame:
    """The recorder's decision on every fix (track_id, arrival, ts, lat, lon, accuracy_m), and a TAIL row that ends each trail.

    A track is replayed in order of arrival inside one sorted partition, fix by fix: a long track needs no more memory than a short one.
    """
    n = int(fixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = fixes.select("track_id", "arrival", "ts", "lat", "lon", F.col("accuracy_m").cast("double").alias("accuracy_m"))
    return rows.repartition(n, "track_id").sortWithinPartitions("track_id", "arrival").mapInPandas(_of_partition, DECISIONS)


def steps(points: DataFrame) -> DataFrame:
    """``points`` with ``step_m`` to each from the one before, by (ts, id); the first of a track: null."""
    led = scan.steps_from(points, ["track_id"], ["ts", "id"], ["lat", "lon"], "__")
    return led.withColumn("step_m", geo.distance_m(F.col("__lat"), F.col("__lon"), F.col("lat"), F.col("lon"))).drop("__lat", "__lon", "has___")


def lengths(points: DataFrame) -> DataFrame:
    """(track_id, distance_m, points, box): the sum of all steps, and the bounds, of at least 0.001 degrees."""
    box = geo.box_at_least(geo.box_struct(F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat")), 0.001)
    return steps(points).groupBy("track_id").agg(F.coalesce(F.sum("step_m"), F.lit(0.0)).alias("distance_m"), F.count("*").alias("points"), box.alias("box"))


def finish(tracks: DataFrame, points: DataFrame) -> DataFrame:
    """Tracks (id, started_at) closed at their last point: ended_at, duration_ms, distance_m, point_count."""
    ends = points.groupBy("track_id").agg(F.max("ts").alias("last_ts"))
    measured = lengths(points).join(ends, "track_id")
    joined = tracks.join(measured, tracks["id"] == measured["track_id"], "left")
    ended = F.greatest("started_at", F.coalesce("last_ts", "started_at"))
    return joined.select("id", "started_at", ended.alias("ended_at"), (ended - F.col("started_at")).alias("duration_ms"), F.coalesce("distance_m", F.lit(0.0)).alias("distance_m"), F.coalesce("points", F.lit(0)).alias("point_count"))


def without_repeats(fixes: DataFrame) -> DataFrame:
    """Fixes that differ from the one before them, in order of arrival."""
    led = scan.steps_from(fixes, ["track_id"], ["arrival"], ["ts", "lat", "lon"], "__")
    same = F.col("has___")
    for c in ("ts", "lat", "lon"):
        same = same & F.col(f"__{c}").eqNullSafe(F.col(c))
    return led.where(~same).select(*fixes.columns)


def close_stale(tracks: DataFrame, points: DataFrame, now_ms: int, resume_within_ms: int) -> DataFrame:
    """Open tracks with ``resume`` true if their last point is recent enough, else an ended_at at it (or at their start)."""
    last = points.groupBy("track_id").agg(F.max("ts").alias("last_ts"))
    joined = tracks.where("ended_at IS NULL").join(last, F.col("id") == F.col("track_id"), "left")
    end = F.coalesce("last_ts", "started_at")
    resume = end >= now_ms - resume_within_ms
    return joined.select("id", "started_at", resume.alias("resume"), F.when(~resume, end).alias("ended_at"))


def marks_at_fixes(marks: DataFrame, fixes: DataFrame) -> DataFrame:
    """Marks (track_id, mark_id, ts) with the last fix at or before each: an as-of join by one union and an ordered scan."""
    both = marks.select("track_id", "ts", "mark_id", F.lit(1).alias("kind"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.lit(None).cast("long").alias("arrival")).unionByName(
        fixes.select("track_id", "ts", F.lit(None).cast("long").alias("mark_id"), F.lit(0).alias("kind"), "lat", "lon", "arrival")
    )
    fix = F.when(F.col("kind") == 0, F.struct("lat", "lon", F.col("ts").alias("fix_ts")))
    found = scan.last_known(both.select("track_id", "ts", "kind", "arrival", "mark_id", "lat", "lon"), ["track_id"], ["ts", "kind", "arrival", "mark_id"], {"fix": fix})
    return found.where("kind = 1").select("track_id", "mark_id", "ts", "fix.lat", "fix.lon", "fix.fix_ts")
