"""Streams: the track recorder and other operators that remember, by stateful processors; windows and keyed tables for the rest.

Keyed state lives in the RocksDB store, in the query's checkpoint: a query that starts again goes on in the middle of a track.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from terravane.operators import tracks
from terravane.operators.store import at_exit, shared_path
from terravane.streaming import processors as P

FIXES = "track_id long, arrival long, ts long, lat double, lon double, accuracy_m double, stop boolean"
#: A track that hears nothing for this long is closed.
SILENT_MS = 12 * 3600 * 1000
#: How late a fix may be behind the latest one, and how long fixes are held for late marks.
LATE_MS, HOLD_MS = 4 * 3600 * 1000, 24 * 3600 * 1000
#: Rows of a micro-batch of a table that is replayed, about. Each micro-batch opens and commits every partition of the state, so small ones
#: cost more than their rows; what is held at once is a key's part of one.
BATCH_ROWS = 1_000_000
#: Micro-batches of a replay, at most. A key's state is read and written once in each that has rows of it, so this work grows with the table only while
#: the number of batches doesn't.
BATCHES = 6
#: A micro-batch of so many rows has FILES files, which as many tasks read.
LARGE_ROWS, FILES = 500_000, 8
#: Groups of keys of a stream with state. A checkpoint belongs to this number.
BUCKETS = 1024
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _keyed(rows: DataFrame, key: str, processor: P.OfKey, schema: str, time: str = "None", event_time: str = "") -> DataFrame:
    """Rows by the ``key``, BUCKETS groups of keys in all; rows without a key are one of their own. They go there packed, but where each has to be held against a watermark."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    kind = rows.schema[key].dataType.simpleString()
    bucket = F.when(F.col(key).isNull(), F.lit(P.InBuckets.NO_KEY)).otherwise(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
    dealt = rows.withColumn("bucket", bucket).withColumn(key, F.coalesce(key, F.lit("0").cast(kind)))
    pack = time != "EventTime"
    if pack:
        dealt = dealt.mapInArrow(P.packed, ", ".join(["bucket int", *[f"`{f.name}` array<{f.dataType.simpleString()}>" for f in dealt.schema if f.name != "bucket"]]))
    return dealt.groupBy("bucket").transformWithStateInPandas(P.InBuckets(processor, key, kind, time, pack), schema, "Append", time, eventTimeColumnName=event_time)


def record_stream(fixes: DataFrame, close_silent: bool = True, silent_ms: int = SILENT_MS) -> DataFrame:
    """Decisions on a stream of fixes (FIXES), as ``tracks.record`` makes them; a row with ``stop``, or a silence of ``silent_ms``, ends the track with its TAIL.

    A late fix is judged by the operator (OUT_OF_ORDER), not by a watermark; inside a micro-batch rows go by arrival. Without
    ``close_silent`` no timer runs, so that a run over what is there now comes to an end.
    """
    return _keyed(fixes, "track_id", P.Recorder(silent_ms if close_silent else None), tracks.DECISIONS, "ProcessingTime" if close_silent else "None")


def close_silent(fixes: DataFrame, silent_ms: int = SILENT_MS, late: str = "12 hours") -> DataFrame:
    """(track_id, started_at, ended_at, fixes) of each track of a stream of fixes (track_id, arrival, ts), once it was silent for ``silent_ms`` of event time.

    A later fix of the same id begins a new track. ``late`` is the watermark: fixes beyond it are dropped, and nothing waits longer for them.
    """
    timed = fixes.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", late)
    return _keyed(timed, "track_id", P.Closer(silent_ms), "track_id long, started_at long, ended_at long, fixes long", "EventTime")


def steady_headings(headings: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """Headings (device, arrival, heading) that differ from the last one passed on by more than JITTER_DEG; a device that is silent for ``forget_ms`` is forgotten."""
    return _keyed(headings, "device", P.Steady(forget_ms), "device long, arrival long, heading double", "ProcessingTime" if forget_ms else "None")


def recount_points(fixes: DataFrame) -> DataFrame:
    """Fixes at which a nearby count is due: the first, and each that is RECOUNT_M from the last one passed on."""
    return _keyed(fixes, "track_id", P.Recount(), "track_id long, arrival long, lat double, lon double")


def blocked_stream(responses: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """(host, id, streak, blocked_until) of a stream of responses (host, id, at_ms, status, retry_after_s); a host that is silent for ``forget_ms`` is forgotten."""
    return _keyed(responses, "host", P.Streaks(forget_ms), "host string, id long, streak long, blocked_until long", "ProcessingTime" if forget_ms else "None")


def marks_stream(marks: DataFrame, fixes: DataFrame, late_ms: int = LATE_MS, hold_ms: int = HOLD_MS) -> DataFrame:
    """Marks (track_id, mark_id, ts, at) of one stream with the last fix (track_id, arrival, ts, lat, lon, stop, at) of the other at or before each.

    ``at`` orders the rows of a micro-batch; a fix with ``stop`` ends its track. A mark is answered when the track's fixes are ``late_ms`` past it,
    at once if they are already, or by the stop.
    """
    nothing = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    kind = F.when(F.coalesce("stop", F.lit(False)), 2).otherwise(0).alias("kind")
    a = marks.select("track_id", "ts", "at", F.lit(1).alias("kind"), "mark_id", *nothing("long", "arrival"), *nothing("double", "lat", "lon"))
    b = fixes.select("track_id", "ts", "at", kind, *nothing("long", "mark_id"), "arrival", "lat", "lon")
    return _keyed(a.unionByName(b), "track_id", P.MarksAtFixes(late_ms, hold_ms), "track_id long, mark_id long, ts long, lat double, lon double, fix_ts long")


def daily_counter(log: DataFrame, late: str = "1 day") -> DataFrame:
    """(day, tiles, bytes) of a stream (ts timestamp, bytes) in tumbling windows of a day."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("tiles"), F.sum("bytes").alias("bytes")).select(F.col("w.start").alias("day"), "tiles", "bytes")


def live_histogram(finds: DataFrame) -> DataFrame:
    """Counts by category of a stream of finds, for the ``complete`` or ``update`` mode."""
    return finds.groupBy("category").agg(F.count("*").alias("n"))


def _files(spark: SparkSession, path: str):
    """(file system, the data files under ``path`` by name)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, sorted((f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())


def replay(table: DataFrame, *order: str, since: str | None = None, most: int | None = None) -> DataFrame:
    """A stream of ``table`` in the order of the columns ``order``, in micro-batches of about BATCH_ROWS rows, or in ``most`` (BATCHES) larger ones.

    One job writes a file for each range of the order; the source takes one a micro-batch, of large ones FILES, by their times, which are set in that order.
    ``since``: a folder to write to.
    """
    spark = table.sparkSession
    rows = table.count()
    n = max(min(-(-rows // BATCH_ROWS), most or BATCHES), 1)
    each = FILES if rows >= n * LARGE_ROWS else 1
    path = since or shared_path(spark, f"replay-{uuid.uuid4().hex}")
    table.repartitionByRange(n * each, *order).write.mode("append").parquet(path)
    at_exit(spark, path)
    fs, files = _files(spark, path)
    first = spark._jvm.java.lang.System.currentTimeMillis() - 1000 * len(files)
    for k, f in enumerate(files):
        fs.setTimes(f, first + 1000 * k, -1)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", each).parquet(path)


def started(writer: DataStreamWriter, spark: SparkSession) -> StreamingQuery:
    """Starts a stream whose keyed state has no more partitions than tasks run at once: each is opened and committed in every micro-batch.

    A stream keeps the number that its checkpoint began with.
    """
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), spark.sparkContext.defaultParallelism))
    try:
        return writer.start()
    finally:
        spark.conf.set(name, before)


def drain(stream: DataFrame, name: str, mode: str = "append", path: str | None = None) -> DataFrame:
    """Runs a stream over all that its source has now: appended rows go to files in the shared folder, a complete result (a few counters) is kept in memory.

    With a ``path`` of an earlier run the stream goes on from that run's checkpoint.
    """
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True)
    if mode != "append":
        writer.format("memory").queryName(name).start().awaitTermination()
        return spark.table(name)
    path = path or shared_path(spark, f"{name}-{uuid.uuid4().hex}")
    started(writer.format("parquet").option("checkpointLocation", f"{path}-log").option("path", path), spark).awaitTermination()
    for p in (path, f"{path}-log"):
        at_exit(spark, p)
    return spark.read.schema(stream.schema).parquet(path)
