"""Tile archives by content: each distinct tile is stored once, in packed segments of a bounded size, behind a directory of runs.

An archive is a folder of two tables. ``segments`` (segment, data) holds the distinct tiles end to end, in order of the first tile id
that has them; ``directory`` (tile_id, run_length, content, segment, offset, length) says for each run of tile ids where their bytes are.
Offsets come from an ordered scan over the tiles' hashes and lengths; bytes move once, to their segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terravane.operators import tiles as T
from terravane.operators.store import dropped, kept

#: A segment holds the tiles that begin within so many bytes.
SEGMENT_BYTES = 8_000_000


def write_files(files: DataFrame, root: str) -> None:
    """Writes ``files`` (name, data) below ``root``, each under a temporary name first, so that a task may run twice."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for batch in it:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                folder, _, last = f"{base}/{name}".rpartition("/")
                store.create_dir(folder)
                with store.open_output_stream(f"{folder}/.{last}.tmp") as out:
                    out.write(data.as_buffer())
                store.move(f"{folder}/.{last}.tmp", f"{folder}/{last}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    files.select("name", "data").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def _packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (segment, data) in order: a row for each segment, its tiles end to end."""
    now, parts = None, []

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([b"".join(parts)], pa.binary())], names=["segment", "data"])

    for batch in it:
        for segment, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            if segment != now:
                if parts:
                    yield row()
                now, parts = segment, []
            parts.append(data.as_py())
    if parts:
        yield row()


def build(tiles: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Writes the archive of ``tiles`` (tile_id, data; one row for each id) to ``path``. Tiles without bytes are left out."""
    n = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = tiles.where(F.coalesce(F.octet_length("data"), F.lit(0)) > 0)
    listed = kept(full.select("tile_id", F.sha2("data", 256).alias("content"), F.octet_length("data").cast("long").alias("bytes")), "listed")
    firsts = T.content_offsets(listed).withColumn("segment", F.floor(F.col("offset") / segment_bytes))
    in_segment = F.col("offset") - F.min("offset").over(Window.partitionBy("segment"))  # a segment's tiles: bounded by its bytes
    placed = kept(firsts.withColumn("offset", in_segment).withColumnRenamed("bytes", "length"), "placed")
    blobs = full.select("tile_id", "data").hint("merge").join(placed.select("tile_id", "segment", "offset").hint("merge"), "tile_id")
    packed = blobs.repartitionByRange(n, "segment").sortWithinPartitions("segment", "offset").select("segment", "data").mapInArrow(_packed, "segment long, data binary")
    packed.write.option("compression", "none").parquet(f"{path}/segments")
    runs = T.runs(listed.select("tile_id", "content"))
    entries = runs.hint("merge").join(placed.drop("tile_id").hint("merge"), "content")
    entries.repartitionByRange(n, "tile_id").sortWithinPartitions("tile_id").select("tile_id", "run_length", "content", "segment", "offset", "length").write.parquet(f"{path}/directory")
    dropped(listed, placed)


def read(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """(tile_id, data) of the asked ``ids`` (tile_id): null where the archive has none. A segment is opened once for all distinct tiles that are asked of it."""
    directory = spark.read.parquet(f"{path}/directory").select("tile_id", "run_length", F.struct("segment", "offset", "length").alias("content"))
    found = kept(T.lookup(ids, directory).select("tile_id", "content.*"), "found")
    asked = found.where("segment IS NOT NULL").select("segment", "offset", "length").distinct().groupBy("segment").agg(F.collect_list(F.struct("offset", "length")).alias("asked"))  # at most a segment's tiles
    opened = spark.read.parquet(f"{path}/segments").hint("merge").join(asked.hint("merge"), "segment")
    cut = F.transform("asked", lambda a: F.struct(a["offset"].alias("offset"), F.substring(F.col("data"), (a["offset"] + 1).cast("int"), a["length"].cast("int")).alias("data")))
    blobs = opened.select("segment", F.explode(cut).alias("b")).select("segment", "b.*")
    return found.hint("merge").join(blobs.hint("merge"), ["segment", "offset"], "left").select("tile_id", "data")


def summary(spark: SparkSession, path: str) -> DataFrame:
    """One row: addressed tiles, directory entries, distinct contents, stored bytes, segments."""
    d = spark.read.parquet(f"{path}/directory").agg(F.sum("run_length").alias("tiles"), F.count("*").alias("entries"), F.countDistinct("content").alias("unique_contents"))
    s = spark.read.parquet(f"{path}/segments").agg(F.sum(F.octet_length("data").cast("long")).alias("stored_bytes"), F.count("*").alias("segments"))
    return d.join(F.broadcast(s))  # one row each
