"""Streams of a table in several micro-batches and frames: as in one, and not through the driver's memory."""

import random

import pytest
from pyspark.sql import functions as F

from terravane.operators import tracks
from terravane.streaming import processors, recorder


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(recorder, "BATCH_ROWS", 120)
    monkeypatch.setattr(processors, "FRAME_ROWS", 7)


def test_a_stream_goes_through_files(spark, small):
    rng = random.Random(5)
    rows = [("hot" if k % 3 else f"h{k % 4}", k, 1000 * (k // 2), rng.choice([200, 429, 503]), None) for k in range(600)]  # equal times
    table = spark.createDataFrame(rows, "host string, id long, at_ms long, status int, retry_after_s int").repartition(5)
    stream = recorder.blocked_stream(recorder.replay(table, "at_ms", "id"))
    out = recorder.drain(stream, "streaks")
    assert out.inputFiles()  # on disk
    streak, wanted = {}, {}
    for host, k, _, status, _ in rows:
        streak[host] = streak.get(host, 0) + 1 if status != 200 else 0
        wanted[k] = streak[host]
    found = out.collect()
    assert len(found) == len(rows) and {r["id"]: r["streak"] for r in found} == wanted


def test_a_replay_is_in_order_and_in_bounds(spark, small):
    table = spark.range(1000).select(F.col("id").alias("device"), (999 - F.col("id")).alias("arrival")).repartition(6)
    sizes = []
    seen = []

    def batch(df, _):
        got = [r["arrival"] for r in df.collect()]
        sizes.append(len(got))
        seen.append((min(got), max(got)))

    recorder.replay(table, "arrival").writeStream.trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()
    assert sum(sizes) == 1000 and max(sizes) < 3 * recorder.BATCH_ROWS and len(sizes) > 4
    assert all(a[1] < b[0] for a, b in zip(seen, seen[1:]))


def test_headings_in_batches(spark, small):
    rng = random.Random(6)
    rows = [(k % 3, k, rng.uniform(0, 8)) for k in range(600)]
    table = spark.createDataFrame(rows, "device long, arrival long, heading double").repartition(4)
    last, wanted = {}, set()
    for d, k, h in rows:
        if d not in last or min(abs(h - last[d]), 360 - abs(h - last[d])) > processors.JITTER_DEG:
            last[d] = h
            wanted.add(k)
    found = [r["arrival"] for r in recorder.drain(recorder.steady_headings(recorder.replay(table, "arrival")), "steady").collect()]
    assert len(found) == len(wanted) and set(found) == wanted


def test_frames_are_small(small):
    assert [len(f) for f in processors.in_frames(iter([(k,) for k in range(20)]), ["x"])] == [7, 7, 6]
    assert [len(f) for f in processors.in_frames(iter([]), ["x"])] == [0]


def _walks(rng, n=700):
    """Fixes (FIXES) of a hot track and others, with late, bad and repeated ones, and stop rows in the middle of tracks."""
    rows, at = [], {}
    for k in range(n):
        track = 1 if k % 3 else 2 + k % 4
        t = at[track] = at.get(track, 0) + rng.choice([0, 5_000, 5_000, 30_000])
        late = 60_000 if k % 29 == 0 else 0
        rows.append((track, k, t - late, 50 + k * 0.0001 + rng.choice([0, 0, 0.05]), 15.0, rng.choice([None, 4.0, 12.0, 80.0]), k % 97 == 96))
    return rows


def test_a_restart_goes_on_in_the_middle_of_tracks(spark, small, tmp_path):
    rows = _walks(random.Random(7))
    whole = spark.createDataFrame(rows, recorder.FIXES)
    once = recorder.drain(recorder.record_stream(recorder.replay(whole.repartition(3), "arrival"), close_silent=False), "once")
    source, sink = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for part in (whole.where("arrival < 333"), whole.where("arrival >= 333")):  # two runs of one checkpoint
        stream = recorder.record_stream(recorder.replay(part, "arrival", since=source), close_silent=False)
        twice = recorder.drain(stream, "twice", path=sink)
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert key(once) == key(twice)
    open_ = whole.where("track_id = 3 AND NOT stop")
    own = [r for r in key(once) if r[0] == 3 and r[2] != "TAIL"]
    assert len(own) == open_.count()


def test_the_stream_decides_like_the_batch(spark, small):
    rows = [r[:6] + (False,) for r in _walks(random.Random(8))]
    table = spark.createDataFrame(rows, recorder.FIXES)
    live = recorder.drain(recorder.record_stream(recorder.replay(table, "arrival"), close_silent=False), "live").where("decision <> 'TAIL'")
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, tracks.record(table).where("decision <> 'TAIL'").collect()))


def test_silence_closes_tracks(spark, small):
    rng = random.Random(9)
    rows, clock = [], 0
    for k in range(600):
        clock += rng.choice([1_000, 2_000, 40_000])
        rows.append((1 if k % 3 else 2 + k % 5, k, clock))
    gap, late = 90_001, 200_000
    wanted, now = [], {}
    for track, _, ts in rows:
        if track in now and ts - now[track][1] > gap:
            wanted.append((track, *now.pop(track)))
        a, _, n = now.get(track, (ts, ts, 0))
        now[track] = (a, ts, n + 1)
    wanted += [(track, *v) for track, v in now.items() if v[1] + gap < clock - late]
    table = spark.createDataFrame(rows, "track_id long, arrival long, ts long").repartition(3)
    found = recorder.drain(recorder.close_silent(recorder.replay(table, "arrival"), gap, f"{late} milliseconds"), "silent")
    assert sorted(map(tuple, found.collect())) == sorted(wanted) and len(wanted) > 5


def test_marks_before_and_behind_their_fixes(spark, small):
    rng = random.Random(10)
    late, rows = 30_000, []
    for k in range(700):
        track, ts = (1 if k % 3 else 2 + k % 3), 1_000 * k
        rows.append((track, k, None, ts - rng.choice([0, 0, late - 1]), float(k), 15.0, False, ts))
        if k % 4 == 0:
            rows.append((track, None, k, ts + rng.randint(-60_000, 20_000), None, None, None, ts + rng.randint(-5_000, 5_000)))
    rows += [(track, None, None, 0, None, None, True, 10**9) for track in (1, 2, 3, 4)]
    schema = "track_id long, arrival long, mark_id long, ts long, lat double, lon double, stop boolean, at long"
    both = recorder.replay(spark.createDataFrame(rows, schema).repartition(4), "at", "track_id")
    stream = recorder.marks_stream(both.where("mark_id IS NOT NULL"), both.where("mark_id IS NULL"), late)
    found = {r["mark_id"]: (r["fix_ts"], r["lat"]) for r in recorder.drain(stream, "marks").collect()}
    fixes = [(r[0], r[3], r[1], r[4]) for r in rows if r[1] is not None]
    for r in rows:
        if r[2] is not None:
            own = max(((ts, k, lat) for track, ts, k, lat in fixes if track == r[0] and ts <= r[3]), default=(None, None, None))
            assert found[r[2]] == (own[0], own[2])
    assert len(found) == sum(r[2] is not None for r in rows)


class _Handle:
    def __init__(self):
        self.lists = {}

    def getListState(self, name, schema):
        out = self.lists[name] = _List()
        return out


class _List:
    rows: list = []

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = rows

    def clear(self):
        self.rows = []


def test_the_state_of_marks_is_bounded_and_dropped():
    import pandas as pd

    own, handle = processors.MarksAtFixes(10, 50), _Handle()
    own.init(handle)
    columns = ["kind", "ts", "arrival", "mark_id", "lat", "lon", "at"]
    for k in range(0, 1000, 10):
        list(own.handleInputRows((1,), iter([pd.DataFrame([(0, k, k, None, 1.0, 2.0, k), (1, k + 500, None, k, None, None, k)], columns=columns)]), None))
        assert len(handle.lists["fixes"].rows) <= 9 and len(handle.lists["marks"].rows) <= 52
    late = pd.concat(list(own.handleInputRows((1,), iter([pd.DataFrame([(1, 960, None, 7, None, None, 2000), (1, 3, None, 8, None, None, 2001)], columns=columns)]), None)))
    assert late[["mark_id", "fix_ts"]].values.tolist()[0] == [7, 960] and late["fix_ts"].isna().tolist() == [False, True]  # at once; too old
    rest = pd.concat(list(own.handleInputRows((1,), iter([pd.DataFrame([(2, 0, None, None, None, None, 3000)], columns=columns)]), None)))
    assert len(rest) and not handle.lists["fixes"].rows and not handle.lists["marks"].rows


def test_state_has_no_more_partitions_than_tasks_at_once(spark, small, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        table = spark.range(300).select((F.col("id") % 40).alias("device"), F.col("id").alias("arrival"), (F.col("id") % 300).cast("double").alias("heading"))
        out = recorder.drain(recorder.steady_headings(recorder.replay(table, "arrival")), "steady", path=f"file://{tmp_path}/out")
        assert out.count() == 300 and spark.conf.get("spark.sql.shuffle.partitions") == "32"
        assert 1 <= sum(p.name.isdigit() for p in (tmp_path / "out-log" / "state" / "0").iterdir()) <= spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_replay_in_a_bounded_number_of_batches(spark, small):
    table = spark.range(3000).select(F.col("id").alias("arrival")).repartition(6)
    seen = []
    recorder.replay(table, "arrival", most=4).writeStream.trigger(availableNow=True).foreachBatch(lambda df, _: seen.append(df.count())).start().awaitTermination()
    assert sum(seen) == 3000 and 1 < len([n for n in seen if n]) <= 4  # not the 25 of its BATCH_ROWS


class _Map:
    def __init__(self):
        self.rows, self.calls = {}, 0

    def getValue(self, key):
        self.calls += 1
        return self.rows.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.rows[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self.rows[key]

    def iterator(self):
        return iter(list(self.rows.items()))


class _GroupHandle:
    """The handle of one group, with its map and its timers."""

    def __init__(self):
        self.timers = set()

    def getMapState(self, name, key, value, ttl_ms=None):
        self.entries = _Map()
        return self.entries

    def listTimers(self):
        return iter(sorted(self.timers))

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class _Now:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_t1_a_group_of_keys_reads_and_writes_each_once(spark):
    import pandas as pd

    own, handle = processors.InBuckets(processors.Recorder(), "track_id", "bigint", "None"), _GroupHandle()
    own.init(handle)
    rows = [(7, track, k, 1000 * k, 50.0 + k * 0.0001, 15.0, None, False) for k in range(6) for track in range(40)]
    frame = pd.DataFrame(rows, columns=["bucket", "track_id", "arrival", "ts", "lat", "lon", "accuracy_m", "stop"])
    out = pd.concat(list(own.handleInputRows((7,), iter([frame[:120], frame[120:]]), None)))
    assert len(out) == 240 and out.groupby("track_id").size().tolist() == [6] * 40
    assert handle.entries.calls == 80 and len(handle.entries.rows) == 40  # not a group for each of 40 tracks
    stop = pd.DataFrame([(7, 3, 6, 0, 0.0, 0.0, None, True)], columns=frame.columns)
    tail = pd.concat(list(own.handleInputRows((7,), iter([stop]), None)))
    assert tail["decision"].tolist() == ["TAIL"] and len(handle.entries.rows) == 39


def test_t1_batches_do_not_grow_with_the_table(spark, small):
    table = spark.range(3000).select(F.col("id").alias("arrival")).repartition(6)
    seen = []
    recorder.replay(table, "arrival").writeStream.trigger(availableNow=True).foreachBatch(lambda df, _: seen.append(df.count())).start().awaitTermination()
    assert sum(seen) == 3000 and 1 < len([n for n in seen if n]) <= recorder.BATCHES  # not the 25 of its BATCH_ROWS


def test_t1_a_large_batch_has_several_files(spark, small, monkeypatch):
    monkeypatch.setattr(recorder, "LARGE_ROWS", 100)
    monkeypatch.setattr(recorder, "FILES", 3)
    table = spark.range(600).select((599 - F.col("id")).alias("arrival")).repartition(6)
    seen = []

    def batch(df, _):
        got = df.withColumn("file", F.input_file_name()).collect()
        seen.append((min(r["arrival"] for r in got), max(r["arrival"] for r in got), len({r["file"] for r in got})))

    recorder.replay(table, "arrival").writeStream.trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()
    assert len(seen) > 3 and max(n for _, _, n in seen) == 3
    assert all(a[1] < b[0] for a, b in zip(seen, seen[1:]))


def test_t5_tracks_of_one_group_share_a_timer(spark, small, monkeypatch):
    monkeypatch.setattr(recorder, "BUCKETS", 1)
    rng = random.Random(12)
    rows, clock = [], 0
    for k in range(600):
        clock += rng.choice([1_000, 2_000, 40_000])
        rows.append((rng.randrange(k // 20, k // 20 + 8), k, clock))  # tracks that end all along
    gap, late = 90_001, 200_000
    wanted, now = [], {}
    for track, _, ts in rows:
        if track in now and ts - now[track][1] > gap:
            wanted.append((track, *now.pop(track)))
        a, _, n = now.get(track, (ts, ts, 0))
        now[track] = (a, ts, n + 1)
    wanted += [(track, *v) for track, v in now.items() if v[1] + gap < clock - late]
    table = spark.createDataFrame(rows, "track_id long, arrival long, ts long").repartition(3)
    found = recorder.drain(recorder.close_silent(recorder.replay(table, "arrival"), gap, f"{late} milliseconds"), "silent")
    assert sorted(map(tuple, found.collect())) == sorted(wanted) and len(now) > 5


def test_t5_a_timer_that_runs_out_leaves_one_for_the_rest():
    import pandas as pd

    own, handle = processors.InBuckets(processors.Closer(10), "track_id", "bigint", "EventTime"), _GroupHandle()
    own.init(handle)
    columns = ["bucket", "track_id", "arrival", "ts"]
    give = lambda rows: list(own.handleInputRows((0,), iter([pd.DataFrame(rows, columns=columns)]), _Now(0)))
    give([(0, 1, 0, 100), (0, 2, 1, 130), (0, 3, 2, 150)])
    assert handle.timers == {110}
    give([(0, 1, 3, 105)])  # the timer stays, too early now
    closed = pd.concat(list(own.handleExpiredTimer((0,), _Now(112), _Now(110))))
    handle.deleteTimer(110)  # as Spark does afterwards
    assert closed.empty and handle.timers == {115}
    closed = pd.concat(list(own.handleExpiredTimer((0,), _Now(141), _Now(115))))
    handle.deleteTimer(115)
    assert closed["track_id"].tolist() == [1, 2] and handle.timers == {160} and list(handle.entries.rows) == [(3,)]


def test_t10_many_devices_in_few_groups(spark, small, monkeypatch):
    monkeypatch.setattr(recorder, "BUCKETS", 3)
    monkeypatch.setattr(processors, "PACK_ROWS", 10)
    rng = random.Random(11)
    rows = [(k % 40 if k % 41 else None, k, rng.uniform(0, 8)) for k in range(600)]  # some without a device
    table = spark.createDataFrame(rows, "device long, arrival long, heading double").repartition(4)
    last, wanted = {}, set()
    for d, k, h in rows:
        if d not in last or min(abs(h - last[d]), 360 - abs(h - last[d])) > processors.JITTER_DEG:
            last[d] = h
            wanted.add((d, k))
    found = recorder.drain(recorder.steady_headings(recorder.replay(table, "arrival")), "steady").collect()
    assert len(found) == len(wanted) and {(r["device"], r["arrival"]) for r in found} == wanted


def test_t10_rows_are_packed_by_group():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"bucket": pa.array([2, 1, 2], pa.int32()), "arrival": [1, 2, 3], "host": ["a", "b", "c"]}), pa.RecordBatch.from_pydict({"bucket": pa.array([1], pa.int32()), "arrival": [4], "host": ["d"]})]
    (out,) = processors.packed(iter(batches))
    assert out.to_pydict() == {"bucket": [1, 2], "arrival": [[2, 4], [1, 3]], "host": [["b", "d"], ["a", "c"]]}
    (back,) = processors.unpacked(iter([out.to_pandas()]))
    assert back.values.tolist() == [[2, "b"], [4, "d"], [1, "a"], [3, "c"]]


def test_t12_marks_of_one_group_keep_to_their_tracks(spark, small, monkeypatch):
    monkeypatch.setattr(recorder, "BUCKETS", 1)
    rng = random.Random(13)
    rows = []
    for k in range(500):
        track, ts = k % 25, 1_000 * k
        rows.append((track, k, None, ts, float(k), 15.0, False, ts))
        if k % 3 == 0:
            rows.append((track, None, k, ts + rng.randint(-60_000, 20_000), None, None, None, ts + rng.randint(-5_000, 5_000)))
    rows += [(track, None, None, 0, None, None, True, 10**9) for track in range(25)]
    schema = "track_id long, arrival long, mark_id long, ts long, lat double, lon double, stop boolean, at long"
    both = recorder.replay(spark.createDataFrame(rows, schema).repartition(4), "at", "track_id")
    out = recorder.drain(recorder.marks_stream(both.where("mark_id IS NOT NULL"), both.where("mark_id IS NULL"), 30_000), "marks").collect()
    found = {r["mark_id"]: (r["track_id"], r["fix_ts"], r["lat"]) for r in out}
    fixes = [(r[0], r[3], r[4]) for r in rows if r[1] is not None]
    wanted = {r[2]: (r[0], *max(((ts, lat) for track, ts, lat in fixes if track == r[0] and ts <= r[3]), default=(None, None))) for r in rows if r[2] is not None}
    assert found == wanted and len(out) == len(wanted)
