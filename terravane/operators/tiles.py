"""Tile tables: coverage, ids, run-length directories, content offsets, upserts, summaries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terravane.functions import geo, hilbert
from terravane.operators import scan
from terravane.operators.store import dropped, kept

#: Tile ids of one range of the two-level sums, and how ranges grow where runs meet at their borders: 2^16 * 8192^3 is beyond all ids.
RANGE, LEVEL, LEVELS = 65_536, 8192, 3


def zoom_list(text: str) -> list[int]:
    """"12-16", "14" or "10,12,14" as sorted distinct zooms; a range may be reversed; 0 to 24 only."""
    out: set[int] = set()
    for part in text.replace(" ", "").split(","):
        found = re.fullmatch(r"(\d+)(?:-(\d+))?", part)
        if not found:
            raise ValueError(f"no zooms: {text!r}")
        a, b = int(found[1]), int(found[2] or found[1])
        out.update(range(min(a, b), max(a, b) + 1))
    if not out or max(out) > 24:
        raise ValueError(f"zooms are 0 to 24: {text!r}")
    return sorted(out)


def zooms(text: Column) -> Column:
    """The same as a Column: array of int; null where the text is no list of zooms."""
    def one(part: Column) -> Column:
        a, b = F.split(part, "-")[0].try_cast("int"), F.element_at(F.split(part, "-"), -1).try_cast("int")
        return F.sequence(F.least(a, b), F.greatest(a, b))

    valid = text.rlike(r"^\d{1,2}(-\d{1,2})?(,\d{1,2}(-\d{1,2})?)*$")
    found = F.sort_array(F.array_distinct(F.flatten(F.transform(F.split(text, ","), one))))
    return F.when(valid, F.when(F.element_at(found, -1) <= 24, found))


def coverage(boxes: DataFrame, zooms: list[int]) -> DataFrame:
    """Boxes (box_id, west, south, east, north) to the tiles (box_id, z, x, y) that cover them."""
    each = boxes.withColumn("z", F.explode(F.array(*map(F.lit, zooms))))
    each = each.withColumn("r", geo.tile_range(F.col("west"), F.col("south"), F.col("east"), F.col("north"), F.col("z")))
    each = each.withColumn("x", F.explode(F.sequence("r.x0", "r.x1"))).withColumn("y", F.explode(F.sequence("r.y0", "r.y1")))
    return each.select("box_id", "z", "x", "y")


def coverage_cost(boxes: DataFrame, zooms: list[int]) -> DataFrame:
    """(box_id, tiles): how many tiles ``coverage`` would give, without making them."""
    n = F.lit(0).cast("long")
    for z in zooms:
        r = geo.tile_range(F.col("west"), F.col("south"), F.col("east"), F.col("north"), F.lit(z))
        n = n + (r["x1"] - r["x0"] + 1).cast("long") * (r["y1"] - r["y0"] + 1)
    return boxes.select("box_id", n.alias("tiles"))


def missing(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Wanted tiles without a non-empty one."""
    return wanted.hint("merge").join(present.where("bytes > 0").select("z", "x", "y").distinct().hint("merge"), ["z", "x", "y"], "left_anti")


def with_ids(tiles: DataFrame) -> DataFrame:
    return tiles.withColumn("tile_id", hilbert.tile_id(F.col("z"), F.col("x"), F.col("y")))


def clustered(tiles: DataFrame, partitions: int) -> DataFrame:
    """Rows laid out along the curve: ranges of tile ids, sorted inside."""
    return tiles.repartitionByRange(partitions, "tile_id").sortWithinPartitions("tile_id")


def runs(tiles: DataFrame) -> DataFrame:
    """Directory entries (tile_id, content, run_length) of (tile_id, content): neighbouring ids with equal content are one.

    Islands are found inside ranges of RANGE ids; those that touch a range's border, at most two for each range, are merged again
    inside ranges that are LEVEL times as wide, and so on up to LEVELS, until one range holds all ids: no window is over all rows.
    """
    entries = tiles.select("tile_id", "content", F.lit(1).cast("long").alias("run_length"))
    done, width = None, RANGE
    for level in range(LEVELS + 1):
        w = Window.partitionBy("range").orderBy("tile_id")
        goes_on = (F.lag(F.col("tile_id") + F.col("run_length")).over(w) == F.col("tile_id")) & F.lag("content").over(w).eqNullSafe(F.col("content"))
        islands = entries.withColumn("range", F.floor(F.col("tile_id") / width)).withColumn("brk", F.when(goes_on, 0).otherwise(1)).withColumn("island", F.sum("brk").over(w))
        entries = islands.groupBy("range", "island").agg(F.min("tile_id").alias("tile_id"), F.first("content").alias("content"), F.sum("run_length").alias("run_length"))
        entries = kept(entries.drop("range", "island"), "runs")
        at_border = (F.pmod("tile_id", F.lit(width)) == 0) | (F.pmod(F.col("tile_id") + F.col("run_length"), F.lit(width)) == 0)
        if level == LEVELS or (level and entries.where(at_border).isEmpty()):
            return entries if done is None else done.unionByName(entries)
        inner = entries.where(~at_border)
        done = inner if done is None else done.unionByName(inner)
        entries, width = entries.where(at_border), width * LEVEL


def content_offsets(tiles: DataFrame) -> DataFrame:
    """(content, tile_id, bytes, offset): each content's first tile by id, and the bytes of all contents first seen before it, by a scan in ranges of ids."""
    firsts = tiles.groupBy("content").agg(F.min("tile_id").alias("tile_id"), F.min_by("bytes", "tile_id").alias("bytes"))
    return scan.running_sum(firsts, [], ["tile_id"], F.col("bytes"), "up_to").select("content", "tile_id", "bytes", (F.col("up_to") - F.col("bytes")).alias("offset"))


def lookup(ids: DataFrame, directory: DataFrame) -> DataFrame:
    """(tile_id, content) of the directory run that holds each id; null without one. An as-of join in ranges of ids: each range is handed the last run before it, however long that is."""
    entries = directory.select(F.col("tile_id").alias("at"), F.lit(0).alias("kind"), F.struct(F.col("tile_id").alias("start"), "run_length", "content").alias("run"))
    asked = ids.select(F.col("tile_id").alias("at"), F.lit(1).alias("kind"))
    both = entries.unionByName(asked, allowMissingColumns=True)
    found = scan.last_known(both, [], ["at", "kind"], {"run": F.col("run")}).where("kind = 1")
    return found.select(F.col("at").alias("tile_id"), F.when(F.col("at") < F.col("run.start") + F.col("run.run_length"), F.col("run.content")).alias("content"))


def lowest_zoom_bounds(tiles: DataFrame) -> DataFrame:
    """One row: the box in degrees of the tiles of the lowest zoom; the world without tiles."""
    low = tiles.agg(F.min("z").alias("low"))
    own = tiles.join(F.broadcast(low), F.col("z") == F.col("low"))  # one row
    b = own.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.max("z").alias("z"))
    first, last = geo.tile_bounds_deg(F.col("x0"), F.col("y0"), F.col("z")), geo.tile_bounds_deg(F.col("x1"), F.col("y1"), F.col("z"))
    world = {"west": -180.0, "south": -geo.MAX_LATITUDE, "east": 180.0, "north": geo.MAX_LATITUDE}
    found = {"west": first["west"], "south": last["south"], "east": last["east"], "north": first["north"]}
    return b.select(*[F.coalesce(found[n], F.lit(world[n])).alias(n) for n in found])


def summary(tiles: DataFrame) -> DataFrame:
    """One row: tiles, unique contents, zooms and bytes, with the directory's entries."""
    entries = runs(tiles.select("tile_id", "content")).agg(F.count("*").alias("entries"))
    unique = tiles.groupBy("content").agg(F.max("bytes").alias("bytes")).agg(F.count("*").alias("unique_contents"), F.sum("bytes").alias("stored_bytes"))
    all_ = tiles.agg(F.count("*").alias("tiles"), F.min("z").alias("min_zoom"), F.max("z").alias("max_zoom"), F.sum("bytes").alias("addressed_bytes"))
    return all_.join(F.broadcast(unique)).join(F.broadcast(entries))  # one row each


def upsert(tiles: DataFrame, changes: DataFrame) -> DataFrame:
    """Tiles (z, x, y, content, bytes, seq) with the newest seq of each address; changes outside the grid or without bytes are skipped."""
    side = F.pow(F.lit(2.0), F.col("z"))
    valid = changes.where((F.col("bytes") > 0) & (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < side) & (F.col("y") < side))
    rest = [c for c in tiles.columns if c not in ("z", "x", "y", "seq")]
    newest = F.max(F.struct("seq", *rest)).alias("m")
    return tiles.unionByName(valid).groupBy("z", "x", "y").agg(newest).select("z", "x", "y", "m.*").select(*tiles.columns)


def upsert_zooms(path: str, changes: DataFrame) -> list[int]:
    """Merges ``changes`` into the tiles at ``path``, a table in folders by ``z``: only the folders of the zooms that they touch are written again. Returns these zooms."""
    spark = changes.sparkSession
    stored = kept(changes, "changes")
    touched = sorted(r["z"] for r in stored.select("z").where("z IS NOT NULL").distinct().collect())  # at most 25 zooms
    if not touched:
        return []
    tiles = spark.read.parquet(path)
    merged = kept(upsert(tiles.where(F.col("z").isin(touched)), stored.select(*tiles.columns)), "merged")
    merged.repartition("z", F.pmod(F.hash("x", "y"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("z").parquet(path)
    dropped(stored, merged)
    return touched


def scan_directory(spark: SparkSession, root: str, extension: str = "png") -> DataFrame:
    """Tiles (z, x, y, data, tile_id) of files {z}/{x}/{y}.{extension}: numeric names only, no hidden, partial or empty ones; ``sidecar`` has what is said about all of them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{extension}").load(root)
    pattern = rf"/(\d+)/(\d+)/(\d+)\.{re.escape(extension)}$"
    part = lambda k: F.regexp_extract("path", pattern, k).try_cast("int")
    found = files.where(F.col("path").rlike(pattern) & (F.col("length") > 0)).select(part(1).alias("z"), part(2).alias("x"), part(3).alias("y"), F.col("content").alias("data"))
    return with_ids(found).where("tile_id IS NOT NULL")


SIDECAR = "name string, title string, attribution string, bbox array<double>"


def sidecar(spark: SparkSession, path: str) -> DataFrame:
    """One row (title, attribution, west, south, east, north) of a tile folder's metadata document; nulls for what it lacks, a box only of four ordered numbers."""
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", SIDECAR).alias("m"))
    at = lambda k: F.get("m.bbox", F.lit(k))
    good = (F.size("m.bbox") == 4) & (at(0) <= at(2)) & (at(1) <= at(3))
    return parsed.select(F.coalesce("m.title", "m.name").alias("title"), F.col("m.attribution").alias("attribution"), *[F.when(good, at(k)).alias(c) for k, c in enumerate(("west", "south", "east", "north"))])


def archive_metadata(metadata: DataFrame, tiles: DataFrame) -> DataFrame:
    """One row of a tile database's metadata (name, value): name, format, min_zoom, max_zoom (else from the tiles) and bounds (null unless four ordered numbers)."""
    low = metadata.groupBy().agg(F.map_from_entries(F.collect_list(F.struct(F.lower("name"), "value"))).alias("m"))  # a few settings
    found = tiles.agg(F.min("zoom_level").alias("lo"), F.max("zoom_level").alias("hi"))
    numbers = F.transform(F.split(F.col("m")["bounds"], ","), lambda s: F.trim(s).try_cast("double"))
    good = (F.size(numbers) == 4) & (F.get(numbers, F.lit(0)) <= F.get(numbers, F.lit(2))) & (F.get(numbers, F.lit(1)) <= F.get(numbers, F.lit(3)))
    zoom = lambda key, other: F.coalesce(F.col("m")[key].try_cast("int"), F.col(other)).alias(key.replace("zoom", "_zoom"))
    return low.join(F.broadcast(found)).select(F.col("m")["name"].alias("name"), F.col("m")["format"].alias("format"), zoom("minzoom", "lo"), zoom("maxzoom", "hi"), F.when(good, numbers).alias("bounds"))
