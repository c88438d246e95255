"""Queries of tracks, tiles, fits, soil, logs, rasters, exchange and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from terravane.functions import affine, classify, geo
from terravane.operators import archive, calibration, fieldlog, layers, raster, tiles, tracks
from terravane.operators.blocks import BLOCK, in_blocks
from terravane.operators.store import at_exit, kept, shared_path
from terravane.plans.fieldlog_queries import _TRACKS, tracks_of
from terravane.plans.helpers import milli, polygons, query, sql_distance, sql_milli
from terravane.sources import exchange
from terravane.streaming import recorder, views

_STEPS = f"steps AS (SELECT track_id, arrival, ts, {sql_distance('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS d, lat, lon FROM fixes WINDOW w AS (PARTITION BY track_id ORDER BY ts, arrival))"


def _points(t):
    return t("fixes").withColumnRenamed("arrival", "id")


@query("w1_steps", f"WITH {_STEPS} SELECT track_id, arrival, {sql_milli('d')} AS step_mm FROM steps", "fixes")
def _(t):
    return tracks.steps(_points(t)).select("track_id", F.col("id").alias("arrival"), milli("step_m").alias("step_mm"))


@query("a6_track_lengths", f"WITH {_STEPS} SELECT track_id, count(*) AS points, CAST(round(coalesce(sum(d), 0)) AS BIGINT) AS metres, {sql_milli('least(min(lat), (min(lat)+max(lat))/2 - 0.0005e0)*1000')} AS south FROM steps GROUP BY 1", "fixes")
def _(t):
    return tracks.lengths(_points(t)).select("track_id", "points", F.round("distance_m").cast("long").alias("metres"), milli(F.col("box.south") * 1000).alias("south"))


@query("a7_finished_tracks", f"WITH {_TRACKS}, {_STEPS}, m AS (SELECT track_id, max(ts) AS last_ts, count(*) AS n, sum(d) AS d FROM steps GROUP BY 1) SELECT id, greatest(started_at, last_ts) AS ended_at, greatest(started_at, last_ts) - started_at AS duration_ms, CAST(round(d) AS BIGINT) AS metres, n AS point_count FROM tracks JOIN m ON m.track_id = id", "fixes")
def _(t):
    done = tracks.finish(tracks_of(t).select("id", "started_at"), _points(t))
    return done.select("id", "ended_at", "duration_ms", F.round("distance_m").cast("long").alias("metres"), "point_count")


@query("a3_track_stats", f"WITH {_TRACKS}, {_STEPS}, m AS (SELECT track_id, max(ts) AS last_ts, round(sum(d)) AS d FROM steps GROUP BY 1) SELECT count(*) AS n, CAST(sum(d) AS BIGINT) AS metres, CAST(sum(last_ts - started_at) AS BIGINT) AS duration_ms FROM tracks JOIN m ON m.track_id = id", "fixes")
def _(t):
    done = tracks.finish(tracks_of(t).select("id", "started_at"), _points(t)).withColumn("distance_m", F.round("distance_m").cast("long"))
    return fieldlog.track_stats(done).withColumnRenamed("distance_m", "metres")


@query("j23_track_details", f"WITH {_TRACKS}, {_STEPS}, m AS (SELECT track_id, round(sum(d)) AS d, max(lat) - min(lat) AS h FROM steps GROUP BY 1) SELECT id, name, CAST(d AS BIGINT) AS metres, {sql_milli('greatest(h, 0.001e0)*1000')} AS height FROM tracks LEFT JOIN m ON m.track_id = id", "fixes")
def _(t):
    joined = tracks_of(t).join(tracks.lengths(_points(t)), F.col("id") == F.col("track_id"), "left")
    return joined.select("id", "name", F.round("distance_m").cast("long").alias("metres"), milli((F.col("box.north") - F.col("box.south")) * 1000).alias("height"))


@query("x5_without_repeats", "SELECT track_id, count(*) AS n FROM (SELECT track_id, ts, lat, lon, lag(ts) OVER w AS pt, lag(lat) OVER w AS pa, lag(lon) OVER w AS po FROM doubled WINDOW w AS (PARTITION BY track_id ORDER BY arrival)) WHERE pt IS NULL OR pt <> ts OR pa <> lat OR po <> lon GROUP BY 1".replace("doubled", "(SELECT track_id, ts, lat, lon, arrival * 2 AS arrival FROM fixes UNION ALL SELECT track_id, ts, lat, lon, arrival * 2 + 1 FROM fixes WHERE arrival % 3 = 0)"), "fixes")
def _(t):
    f = t("fixes").select("track_id", "ts", "lat", "lon", (F.col("arrival") * 2).alias("arrival"))
    doubled = f.unionByName(f.where("arrival % 6 = 0").withColumn("arrival", F.col("arrival") + 1))
    return tracks.without_repeats(doubled).groupBy("track_id").agg(F.count("*").alias("n"))


def _d(a: str, b: str) -> str:
    return sql_distance(f"{a}lat", f"{a}lon", f"{b}.lat", f"{b}.lon")


#: The recorder step by step, one fix of each track a round: l the last accepted fix, s the last vertex, c the waiting candidate, a where standing began.
_RECORDER = f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY arrival) AS k FROM fixes),
rec AS (SELECT track_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS arrival, CAST(NULL AS VARCHAR) AS decision, CAST(NULL AS BIGINT) AS lts, CAST(NULL AS DOUBLE) AS llat, CAST(NULL AS DOUBLE) AS llon,
CAST(NULL AS DOUBLE) AS slat, CAST(NULL AS DOUBLE) AS slon, CAST(NULL AS DOUBLE) AS clat, CAST(NULL AS DOUBLE) AS clon, CAST(NULL AS BIGINT) AS ats, CAST(NULL AS DOUBLE) AS alat, CAST(NULL AS DOUBLE) AS alon,
CAST(0 AS DOUBLE) AS dist, CAST(0 AS BIGINT) AS verts, false AS idle, CAST(NULL AS DOUBLE) AS vlat FROM numbered WHERE k = 1
UNION ALL SELECT track_id, k, arrival, decision, CASE WHEN ok THEN ts ELSE lts END, CASE WHEN ok THEN lat ELSE llat END, CASE WHEN ok THEN lon ELSE llon END,
CASE WHEN NOT ok THEN slat WHEN slat IS NULL THEN lat WHEN confirmed THEN clat ELSE slat END, CASE WHEN NOT ok THEN slon WHEN slat IS NULL THEN lon WHEN confirmed THEN clon ELSE slon END,
CASE WHEN NOT ok THEN clat WHEN slat IS NULL OR near OR (confirmed AND cd < least_m) THEN NULL ELSE lat END, CASE WHEN NOT ok THEN clon WHEN slat IS NULL OR near OR (confirmed AND cd < least_m) THEN NULL ELSE lon END,
CASE WHEN ok AND (lts IS NULL OR ad >= 10) THEN ts ELSE ats END, CASE WHEN ok AND (lts IS NULL OR ad >= 10) THEN lat ELSE alat END, CASE WHEN ok AND (lts IS NULL OR ad >= 10) THEN lon ELSE alon END,
dist + CASE WHEN ok AND lts IS NOT NULL AND ld > greatest(3.0e0, acc) THEN ld ELSE 0.0e0 END, verts + CASE WHEN ok AND (slat IS NULL OR confirmed) THEN 1 ELSE 0 END,
CASE WHEN NOT ok OR lts IS NULL THEN idle WHEN ad >= 10 THEN false WHEN ts - ats >= 60000 THEN true ELSE idle END, CASE WHEN ok AND slat IS NULL THEN lat WHEN ok AND confirmed THEN clat END
FROM (SELECT *, decision = 'ACCEPTED' AS ok, sd < least_m AS near, sd >= least_m AND clat IS NOT NULL AS confirmed FROM
(SELECT o.track_id, o.k, o.arrival, o.ts, o.lat, o.lon, coalesce(o.accuracy_m, 0.0e0) AS acc, greatest(10.0e0, coalesce(o.accuracy_m, 0.0e0)) AS least_m, r.lts, r.llat, r.llon, r.slat, r.slon, r.clat, r.clon, r.ats, r.alat, r.alon, r.dist, r.verts, r.idle,
{_d('r.l', 'o')} AS ld, {_d('r.s', 'o')} AS sd, {_d('r.c', 'o')} AS cd, {_d('r.a', 'o')} AS ad,
CASE WHEN o.accuracy_m > 50 THEN 'ACCURACY' WHEN r.lts IS NULL THEN 'ACCEPTED' WHEN o.ts < r.lts THEN 'OUT_OF_ORDER' WHEN o.ts = r.lts AND {_d('r.l', 'o')} <= 0 THEN 'DUPLICATE' WHEN o.ts = r.lts THEN 'JUMP'
WHEN {_d('r.l', 'o')} / ((o.ts - r.lts) / 1000.0e0) > 15 THEN 'JUMP' ELSE 'ACCEPTED' END AS decision FROM rec r JOIN numbered o ON o.track_id = r.track_id AND o.k = r.k + 1) q1) q2)"""


@query("w2_recorded_tracks", f"WITH RECURSIVE {_RECORDER} SELECT track_id, arrival, decision, idle, CAST(round(dist) AS BIGINT) AS metres, verts AS vertices, {sql_milli('vlat*1000')} AS vertex_lat FROM rec WHERE k > 0", "fixes")
def _(t):
    decisions = tracks.record(t("fixes")).where("decision <> 'TAIL'")
    return decisions.select("track_id", "arrival", "decision", "idle", F.round("distance_m").cast("long").alias("metres"), "vertices", milli(F.col("v_lat") * 1000).alias("vertex_lat"))


# the trail ends with the waiting candidate, else the last fix, unless the last vertex stands there
_TAILS = "ends AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY k DESC) AS back FROM rec WHERE k > 0), tails AS (SELECT track_id, CASE WHEN llat IS NULL OR (slat = coalesce(clat, llat) AND slon = coalesce(clon, llon)) THEN 0 ELSE 1 END AS tail FROM ends WHERE back = 1)"


@query("t2_trails", f"WITH RECURSIVE {_RECORDER}, {_TAILS} SELECT track_id, max(verts) + any_value(tail) AS vertices, max(verts) + any_value(tail) AS counted, CAST(round(max(dist)) AS BIGINT) AS metres, bool_or(idle) AS was_idle FROM rec JOIN tails USING (track_id) WHERE k > 0 GROUP BY 1", "fixes")
def _(t):
    trail = tracks.record(t("fixes"))
    return trail.groupBy("track_id").agg(F.count("v_ts").alias("vertices"), F.max("vertices").alias("counted"), F.round(F.max("distance_m")).cast("long").alias("metres"), F.bool_or("idle").alias("was_idle"))


@query("t5_stale_tracks", f"WITH {_TRACKS}, m AS (SELECT track_id, max(ts) AS last_ts FROM fixes GROUP BY 1) SELECT id, last_ts >= 1600200000000 - 100000000 AS resume, CASE WHEN last_ts < 1600200000000 - 100000000 THEN last_ts END AS ended_at FROM tracks JOIN m ON m.track_id = id WHERE tracks.ended_at IS NULL", "fixes")
def _(t):
    return tracks.close_stale(tracks_of(t), t("fixes"), 1600200000000, 100_000_000).select("id", "resume", "ended_at")


@query(
    "t12_marks_at_fixes",
    "SELECT m.track_id, m.mark_id, f.ts AS fix_ts, f.lat FROM (SELECT user_id AS track_id, event_id AS mark_id, 1600000000000 + event_id * 14000 AS ts FROM events) m ASOF LEFT JOIN (SELECT track_id, ts, max_by(lat, arrival) AS lat FROM fixes GROUP BY 1, 2) f ON f.track_id = m.track_id AND f.ts <= m.ts",
    "fixes",
)
def _(t):
    marks = t("events").select(F.col("user_id").alias("track_id"), F.col("event_id").alias("mark_id"), (F.lit(1600000000000) + F.col("event_id") * 14000).alias("ts"))
    return tracks.marks_at_fixes(marks, t("fixes")).select("track_id", "mark_id", "fix_ts", "lat")


def _boxes(t):
    return t("areas").select(F.col("id").alias("box_id"), F.col("lon").alias("west"), F.col("lat").alias("south"), (F.col("lon") + F.col("side")).alias("east"), (F.col("lat") + F.col("side")).alias("north"))


_PI = "3.141592653589793e0"
_UNIT = "(1.0e0-ln(tan(radians({0}))+1.0e0/cos(radians({0})))/" + _PI + ")/2.0e0*n"
_RANGE = f"""z AS (SELECT unnest([8, 10, 12]) AS z), b AS (SELECT id AS box_id, z, pow(2.0e0, z) AS n, lon AS w, lat AS s, lon + side AS e, lat + side AS nn FROM areas, z),
r AS (SELECT box_id, z, CAST(floor((w+180.0e0)/360.0e0*n + 1e-9) AS INT) AS x0, CAST(ceil((e+180.0e0)/360.0e0*n - 1e-9) - 1 AS INT) AS x1, CAST(floor({_UNIT.format('nn')} + 1e-9) AS INT) AS y0, CAST(ceil({_UNIT.format('s')} - 1e-9) - 1 AS INT) AS y1 FROM b)"""


@query("g1_coverage", f"WITH {_RANGE} SELECT box_id, z, x, y FROM (SELECT box_id, z, unnest(range(x0, x1 + 1)) AS x, y0, y1 FROM r) JOIN LATERAL (SELECT unnest(range(y0, y1 + 1)) AS y) ON true", "areas")
def _(t):
    return tiles.coverage(_boxes(t), [8, 10, 12])


@query("a17_coverage_cost", f"WITH {_RANGE} SELECT box_id, CAST(sum((x1-x0+1)*(y1-y0+1)) AS BIGINT) AS tiles FROM r GROUP BY 1", "areas")
def _(t):
    return tiles.coverage_cost(_boxes(t), [8, 10, 12])


@query("g2_missing_tiles", f"WITH {_RANGE.replace('[8, 10, 12]', '[8, 9]')}, want AS (SELECT DISTINCT z, x, y FROM (SELECT z, unnest(range(x0, x1 + 1)) AS x, y0, y1 FROM r) JOIN LATERAL (SELECT unnest(range(y0, y1 + 1)) AS y) ON true) SELECT z, x, y FROM want WHERE (z, x, y) NOT IN (SELECT (z, x + 100 * (z - 7), y + 70 * (z - 7)) FROM tiles)", "areas", "tiles")
def _(t):
    present = t("tiles").withColumns({"x": F.col("x") + (F.col("z") - 7) * 100, "y": F.col("y") + (F.col("z") - 7) * 70})
    return tiles.missing(tiles.coverage(_boxes(t), [8, 9]).select("z", "x", "y").distinct(), present)


_RUN_IDS = "SELECT tile_id, (tile_id // 40) % 50 AS content, (tile_id // 40) % 50 + 400 AS bytes FROM (SELECT DISTINCT x AS tile_id FROM (SELECT unnest([o_orderkey * 9 + (o_orderkey // 10) % 3, o_orderkey * 9 + (o_orderkey // 10) % 3 + 1, o_orderkey * 9 + (o_orderkey // 10) % 3 + 2]) AS x FROM orders))"


def _run_ids(t):
    base = F.col("o_orderkey") * 9 + F.floor(F.col("o_orderkey") / 10) % 3
    ids = t("orders").select(F.explode(F.array(base, base + 1, base + 2)).alias("tile_id")).distinct()
    content = F.floor(F.col("tile_id") / 40) % 50
    return ids.select("tile_id", content.alias("content"), (content + 400).alias("bytes"))


_RUNS = f"ids AS ({_RUN_IDS}), b AS (SELECT *, CASE WHEN lag(tile_id) OVER w + 1 = tile_id AND lag(content) OVER w = content THEN 0 ELSE 1 END AS brk FROM ids WINDOW w AS (ORDER BY tile_id)), i AS (SELECT *, sum(brk) OVER (ORDER BY tile_id) AS island FROM b), runs AS (SELECT min(tile_id) AS tile_id, min(content) AS content, count(*) AS run_length FROM i GROUP BY island)"


@query("w4_directory_runs", f"WITH {_RUNS} SELECT * FROM runs")
def _(t):
    return tiles.runs(_run_ids(t))


@query("w5_content_offsets", f"WITH ids AS ({_RUN_IDS}), f AS (SELECT content, min(tile_id) AS tile_id, min(bytes) AS bytes FROM ids GROUP BY 1) SELECT content, tile_id, bytes, CAST(sum(bytes) OVER (ORDER BY tile_id) - bytes AS BIGINT) AS \"offset\" FROM f")
def _(t):
    return tiles.content_offsets(_run_ids(t))


@query("w12_directory_lookup", f"WITH {_RUNS}, q AS (SELECT DISTINCT l_orderkey * 7 AS tile_id FROM lineitem) SELECT q.tile_id, CASE WHEN q.tile_id < runs.tile_id + run_length THEN content END AS content FROM q ASOF LEFT JOIN runs ON runs.tile_id <= q.tile_id")
def _(t):
    asked = t("lineitem").select((F.col("l_orderkey") * 7).alias("tile_id")).distinct()
    return tiles.lookup(asked, tiles.runs(_run_ids(t)))


@query(
    "a13_lowest_zoom_bounds",
    f"WITH b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM tiles WHERE z = 8) SELECT {sql_milli('(x0/256.0e0*360.0e0-180.0e0)*1000')} AS west, {sql_milli('((x1+1)/256.0e0*360.0e0-180.0e0)*1000')} AS east, {sql_milli(f'degrees(atan(sinh({_PI}*(1-2*y0/256.0e0))))*1000')} AS north, {sql_milli(f'degrees(atan(sinh({_PI}*(1-2*(y1+1)/256.0e0))))*1000')} AS south FROM b",
    "tiles",
)
def _(t):
    return tiles.lowest_zoom_bounds(t("tiles")).select(*[milli(F.col(c) * 1000).alias(c) for c in ("west", "east", "north", "south")])


_TILE_IDS = """h AS (SELECT z, x, y, content, z AS k, CAST(x AS BIGINT) AS cx, CAST(y AS BIGINT) AS cy, CAST((CAST(pow(4, z) AS BIGINT)-1)//3 AS BIGINT) AS d FROM tiles
UNION ALL SELECT z, x, y, content, k-1, CASE WHEN ry=0 THEN CASE WHEN rx=1 THEN s-1-my ELSE my END ELSE mx END, CASE WHEN ry=0 THEN CASE WHEN rx=1 THEN s-1-mx ELSE mx END ELSE my END, d + s*s*xor(3*rx, ry)
FROM (SELECT *, CAST(pow(2,k-1) AS BIGINT) AS s, cx % CAST(pow(2,k-1) AS BIGINT) AS mx, cy % CAST(pow(2,k-1) AS BIGINT) AS my, CAST(cx >= pow(2,k-1) AS BIGINT) AS rx, CAST(cy >= pow(2,k-1) AS BIGINT) AS ry FROM h WHERE k > 0) q),
starts AS (SELECT CASE WHEN lag(d) OVER (ORDER BY d) + 1 = d AND lag(content) OVER (ORDER BY d) = content THEN 0 ELSE 1 END AS n FROM h WHERE k = 0)"""


@query("a15_pyramid_summary", f"WITH RECURSIVE {_TILE_IDS} SELECT count(*) AS tiles, min(z) AS min_zoom, max(z) AS max_zoom, CAST(sum(bytes) AS BIGINT) AS addressed_bytes, (SELECT count(DISTINCT content) FROM tiles) AS unique_contents, (SELECT CAST(sum(b) AS BIGINT) FROM (SELECT max(bytes) AS b FROM tiles GROUP BY content)) AS stored_bytes, (SELECT CAST(sum(n) AS BIGINT) FROM starts) AS entries FROM tiles", "tiles")
def _(t):
    return tiles.summary(tiles.with_ids(t("tiles"))).select("tiles", "min_zoom", "max_zoom", F.col("addressed_bytes").cast("long"), "unique_contents", F.col("stored_bytes").cast("long"), "entries")


@query("d3_tile_upsert", "SELECT z, x, y, content, bytes FROM (SELECT *, row_number() OVER (PARTITION BY z, x, y ORDER BY seq DESC) AS rn FROM (SELECT z, x, y, content, bytes, 1 AS seq FROM tiles UNION ALL SELECT z, x, y, content + 1, bytes, 2 FROM tiles WHERE x % 2 = 0 AND bytes <> 400)) WHERE rn = 1", "tiles")
def _(t):
    base = t("tiles").withColumn("seq", F.lit(1))
    changes = base.where("x % 2 = 0").withColumns({"content": F.col("content") + 1, "seq": F.lit(2), "bytes": F.when(F.col("bytes") == 400, 0).otherwise(F.col("bytes"))})
    outside = changes.withColumn("x", F.col("x") + 100_000)
    return tiles.upsert(base, changes.unionByName(outside)).drop("seq")


@query("d3_touched_zooms", "SELECT z, x, y, content, bytes FROM (SELECT *, row_number() OVER (PARTITION BY z, x, y ORDER BY seq DESC) AS rn FROM (SELECT z, x, y, content, bytes, 1 AS seq FROM tiles UNION ALL SELECT z, x, y, content + 1, bytes, 2 FROM tiles WHERE x % 2 = 0 AND z = 9)) WHERE rn = 1", "tiles")
def _(t):
    base = t("tiles").withColumn("seq", F.lit(1))
    path = shared_path(base.sparkSession, f"zooms-{uuid.uuid4().hex}")
    base.write.partitionBy("z").parquet(path)
    at_exit(base.sparkSession, path)
    tiles.upsert_zooms(path, base.where("x % 2 = 0 AND z = 9").withColumns({"content": F.col("content") + 1, "seq": F.lit(2)}))
    return base.sparkSession.read.parquet(path).select("z", "x", "y", "content", "bytes")


_FILED = """filed AS (SELECT DISTINCT 12 AS z, CAST(floor((lon+180.0e0)/360.0e0*4096) AS INT) AS x, CAST(floor((1.0e0-ln(tan(radians(lat))+1.0e0/cos(radians(lat)))/3.141592653589793e0)/2.0e0*4096) AS INT) AS y FROM places),
data AS (SELECT z, x, y, 'tile ' || (x // 4) || ' ' || (y // 4) || repeat('#', 100 + x % 4 * 0 + (x // 4) % 50) AS data FROM filed)"""


def _filed(t):
    """A tile file for each tile of zoom 12 with a place; blocks of four by four have equal bytes. Beside some are files that are none."""
    at = t("places").select(F.lit(12).alias("z"), geo.tile_x(F.col("lon"), 12).cast("int").alias("x"), geo.tile_y(F.col("lat"), 12).cast("int").alias("y")).distinct()
    four = lambda c: F.floor(F.col(c) / 4).cast("string")
    data = F.concat(F.lit("tile "), four("x"), F.lit(" "), four("y"), F.expr("repeat('#', CAST(100 + floor(x / 4) % 50 AS INT))"))
    name = F.concat_ws("/", *[F.col(c).cast("string") for c in ("z", "x", "y")])
    good = at.select(F.concat(name, F.lit(".png")).alias("name"), data.cast("binary").alias("data"))
    odd = [at.where("(x + y) % 9 = 0").select(F.concat(F.col("z").cast("string"), F.lit("/"), F.col("x").cast("string"), F.lit(kind)).alias("name"), F.lit(body).cast("binary").alias("data")) for kind, body in (("/.hidden.png", "x"), ("/7.png.part", "x"), ("/name.png", "x"), ("/7.txt", "x"), ("/99999.png", ""))]
    root = shared_path(at.sparkSession, f"tile-files-{uuid.uuid4().hex}")
    for files in (good, *[f.distinct() for f in odd]):
        archive.write_files(files, root)
    at_exit(at.sparkSession, root)
    return root


@query("s13_tile_scan", f"WITH {_FILED} SELECT z, x, y, length(data) AS bytes, sha256(data) AS hash FROM data", "places")
def _(t):
    root = _filed(t)
    return tiles.scan_directory(t("places").sparkSession, root).select("z", "x", "y", F.octet_length("data").cast("long").alias("bytes"), F.sha2("data", 256).alias("hash"))


@query("a26_tile_archive", f"WITH {_FILED} SELECT z, x, y, sha256(data) AS hash, (SELECT count(DISTINCT data) FROM data) AS unique_contents, (SELECT CAST(sum(length(d)) AS BIGINT) FROM (SELECT DISTINCT data AS d FROM data)) AS stored_bytes FROM data", "places")
def _(t):
    # files to an archive in small segments, and back by (segment, offset, length)
    spark = t("places").sparkSession
    path = shared_path(spark, f"archive-{uuid.uuid4().hex}")
    found = tiles.scan_directory(spark, _filed(t))
    archive.build(found.select("tile_id", "data"), path, segment_bytes=20_000)
    at_exit(spark, path)
    back = archive.read(spark, path, found.select("tile_id"))
    both = found.select("tile_id", "z", "x", "y").hint("merge").join(back.hint("merge"), "tile_id")
    totals = archive.summary(spark, path).select("unique_contents", F.col("stored_bytes").cast("long").alias("stored_bytes"))
    return both.select("z", "x", "y", F.sha2("data", 256).alias("hash")).join(F.broadcast(totals))  # one row


@query("f17_cacheable_tiles", "SELECT count(*) AS n FROM tiles WHERE bytes BETWEEN 400 AND 8388608 AND concat('layer', CAST(x % 40 AS VARCHAR)) NOT IN (SELECT layer_id FROM calibrations WHERE NOT active)", "tiles", "calibrations")
def _(t):
    own = t("tiles").withColumn("layer_id", F.concat(F.lit("layer"), (F.col("x") % 40).cast("string"))).where(classify.tile_cacheable(F.col("bytes")))
    return own.join(t("calibrations").where("NOT active").select("layer_id").distinct(), "layer_id", "left_anti").agg(F.count("*").alias("n"))


@query("a19_cache_bytes", "SELECT concat('layer', CAST(x % 40 AS VARCHAR)) AS layer_id, CAST(sum(bytes) AS BIGINT) AS bytes FROM tiles GROUP BY 1", "tiles")
def _(t):
    return t("tiles").groupBy(F.concat(F.lit("layer"), (F.col("x") % 40).cast("string")).alias("layer_id")).agg(F.sum(F.col("bytes").cast("long")).alias("bytes"))


@query("e33_image_types", "SELECT ['jpg', 'png', 'gif', 'webp', 'none'][page_id % 5 + 1] AS type, count(*) AS n FROM pages GROUP BY 1")
def _(t):
    heads = F.element_at(F.array(*[F.unhex(F.lit(h)) for h in ("FFD8FFE0", "89504E47", "47494638", "52494646", "")]), (F.col("page_id") % 5 + 1).cast("int"))
    return t("pages").groupBy(classify.image_type(F.concat(heads, F.col("html").cast("binary"))).alias("type")).agg(F.count("*").alias("n"))


@query(
    "e34_response_bodies",
    "SELECT kind, CASE WHEN kind IN ('arcgis-rest', 'xyz') THEN 'BAD_BODY' WHEN contains(low, 'serviceexception') OR contains(low, 'exceptionreport') THEN 'BAD_BODY' WHEN kind = 'wmts' THEN CASE WHEN contains(low, 'capabilities') THEN 'OK' ELSE 'BAD_BODY' END WHEN kind = 'atom' THEN CASE WHEN contains(low, '<feed') OR contains(low, 'atom') THEN 'OK' ELSE 'BAD_BODY' END ELSE 'OK' END AS class, count(*) AS n FROM (SELECT ['arcgis-rest', 'wmts', 'atom', 'xyz', 'other'][page_id % 5 + 1] AS kind, lower(left(html, 4096)) AS low FROM pages) GROUP BY 1, 2",
)
def _(t):
    kind = F.element_at(F.array(*map(F.lit, ["arcgis-rest", "wmts", "atom", "xyz", "other"])), (F.col("page_id") % 5 + 1).cast("int"))
    return t("pages").select(kind.alias("kind"), "html").groupBy("kind", classify.body_class(F.col("kind"), F.col("html")).alias("class")).agg(F.count("*").alias("n"))


@query(
    "e34_body_details",
    """WITH b AS (SELECT page_id, page_id % 12 AS k, html, CASE page_id % 12 WHEN 0 THEN '{"error":{"message":"no ' || page_id || '"}}' WHEN 1 THEN '{"mapName":"Map ' || page_id || '"}' WHEN 2 THEN '{"layers":[]}' WHEN 3 THEN html WHEN 4 THEN '<ServiceExceptionReport><ServiceException>Layer ' || page_id || ' not there</ServiceException></ServiceExceptionReport>' WHEN 5 THEN '<WMS_Capabilities>' || html WHEN 6 THEN '<Capabilities/>' WHEN 7 THEN '<feed/>' WHEN 8 THEN 'plain text' WHEN 9 THEN 'none' WHEN 10 THEN html ELSE '{}' END AS body FROM pages)
SELECT page_id, CASE WHEN k IN (1, 2, 5, 6, 7, 10, 11) THEN 'OK' ELSE 'BAD_BODY' END AS class, CASE k WHEN 0 THEN 'SERVICE_ERROR: no ' || page_id WHEN 1 THEN 'LAYER: Map ' || page_id WHEN 2 THEN 'METADATA' WHEN 3 THEN 'NOT_JSON' WHEN 4 THEN 'EXCEPTION: Layer ' || page_id || ' not there' WHEN 5 THEN 'CAPABILITIES' WHEN 6 THEN 'CAPABILITIES' WHEN 7 THEN 'FEED' WHEN 8 THEN 'NO_FEED' WHEN 9 THEN 'NO_IMAGE' WHEN 10 THEN 'RECEIVED' ELSE 'METADATA' END AS detail FROM b""",
)
def _(t):
    k, page = F.col("page_id") % 12, F.col("page_id").cast("string")
    kinds = F.element_at(F.array(*map(F.lit, ["arcgis-rest"] * 4 + ["wms", "wms", "wmts", "atom", "atom", "xyz", "other", "arcgis-rest"])), (k + 1).cast("int"))
    said = lambda a, b: F.concat(F.lit(a), page, F.lit(b))
    bodies = [said('{"error":{"message":"no ', '"}}'), said('{"mapName":"Map ', '"}'), F.lit('{"layers":[]}'), F.col("html"), said("<ServiceExceptionReport><ServiceException>Layer ", " not there</ServiceException></ServiceExceptionReport>"), F.concat(F.lit("<WMS_Capabilities>"), F.col("html"))]
    bodies += [F.lit("<Capabilities/>"), F.lit("<feed/>"), F.lit("plain text"), F.lit("none"), F.col("html"), F.lit("{}")]
    return t("pages").select("page_id", classify.body_findings(kinds, F.element_at(F.array(*bodies), (k + 1).cast("int"))).alias("f")).select("page_id", "f.class", "f.detail")


@query(
    "e35_request_urls",
    "SELECT z, x, y, 'https://' || ['a','b','c'][(x + y) % 3 + 1] || '.example.org/' || z || '/' || x || '/' || (CAST(pow(2, z) AS INT) - 1 - y) || '.png' AS xyz, 'https://example.org/wmts?SERVICE=WMTS&REQUEST=GetTile&VERSION=1.0.0&LAYER=ii&STYLE=default&TILEMATRIXSET=GoogleMapsCompatible&TILEMATRIX=' || z || '&TILEROW=' || y || '&TILECOL=' || x || '&FORMAT=image/jpeg' AS wmts FROM tiles",
    "tiles",
)
def _(t):
    z, x, y = F.col("z"), F.col("x"), F.col("y")
    return t("tiles").select("z", "x", "y", classify.xyz_url(F.lit("https://{s}.example.org/{z}/{x}/{-y}.png"), z, x, y).alias("xyz"), classify.wmts_kvp_url(F.lit("https://example.org/wmts"), z, x, y, "ii").alias("wmts"))


_SPAN = "40075016.685578488e0/pow(2.0e0, z)"
_TILE_BOX = f"SELECT z, x, y, x*{_SPAN}-20037508.342789244e0 AS w, 20037508.342789244e0-(y+1)*{_SPAN} AS s, (x+1)*{_SPAN}-20037508.342789244e0 AS e, 20037508.342789244e0-y*{_SPAN} AS n FROM tiles"


@query(
    "e35_service_urls",
    f"WITH b AS ({_TILE_BOX}) SELECT z, x, y, {sql_milli('w')} AS west_mm, {sql_milli('n')} AS north_mm, 'https://example.org/wmts/ii/default/GoogleMapsCompatible/' || z || '/' || y || '/' || x || '.jpg' AS rest, "
    "'https://example.org/wms?map=a&SERVICE=WMS&REQUEST=GetMap&VERSION=1.3.0&LAYERS=ii&STYLES=&CRS=EPSG:3857&BBOX=#&WIDTH=256&HEIGHT=256&FORMAT=image/png&TRANSPARENT=FALSE' AS wms, "
    "'https://example.org/wms?SERVICE=WMS&REQUEST=GetMap&VERSION=1.3.0&LAYERS=ii&STYLES=&CRS=EPSG:4326&BBOX=' || printf('%.9f,%.9f,%.9f,%.9f', y + 0.5e0, x + 0.25e0, y + 1.5e0, x + 1.25e0) || '&WIDTH=256&HEIGHT=256&FORMAT=image/png&TRANSPARENT=FALSE' AS swapped, "
    "'https://example.org/wms?SERVICE=WMS&REQUEST=GetMap&VERSION=1.1.1&LAYERS=ii&STYLES=&SRS=EPSG:4326&BBOX=' || printf('%.9f,%.9f,%.9f,%.9f', x + 0.25e0, y + 0.5e0, x + 1.25e0, y + 1.5e0) || '&WIDTH=256&HEIGHT=256&FORMAT=image/png&TRANSPARENT=FALSE' AS older, "
    "'https://example.org/map/MapServer/export?bbox=' || printf('%.6f,%.6f,%.6f,%.6f', w, s, e, n) || '&bboxSR=3857&imageSR=3857&size=256,256&format=png&transparent=false&f=image' AS export FROM b",
    "tiles",
)
def _(t):
    z, x, y = F.col("z"), F.col("x"), F.col("y")
    b = geo.tile_bounds_m(x, y, z)
    metres = (b["min_x"], b["min_y"], b["max_x"], b["max_y"])
    degrees = (x + 0.25, y + 0.5, x + 1.25, y + 1.5)
    base = F.lit("https://example.org/wms")
    wms = classify.wms_url(F.lit("https://example.org/wms?map=a"), *metres, "ii")
    # the engines round the ninth digit of large numbers differently: the box is compared as numbers
    box = F.split(F.regexp_extract(wms, "BBOX=([^&]*)", 1), ",")
    return t("tiles").select(
        "z", "x", "y",
        milli(box[0].cast("double")).alias("west_mm"), milli(box[3].cast("double")).alias("north_mm"),
        classify.wmts_rest_url(F.lit("https://example.org/wmts/{layer}/{style}/{tilematrixset}/{z}/{y}/{x}.jpg"), z, x, y, "ii").alias("rest"),
        F.regexp_replace(wms, "BBOX=[^&]*", "BBOX=#").alias("wms"),
        classify.wms_url(base, *degrees, "ii", "EPSG:4326").alias("swapped"),
        classify.wms_url(base, *degrees, "ii", "EPSG:4326", "1.1.1").alias("older"),
        classify.export_url(F.lit("https://example.org/map/MapServer/export/"), *metres).alias("export"),
    )


@query("f16_valid_tiles", "SELECT z, x - 5 AS x, y - 3 AS y, x >= 5 AND y >= 3 AND x - 5 < pow(2, z) AND y - 3 < pow(2, z) AND content % 16 <> 0 AS valid FROM tiles", "tiles")
def _(t):
    data = F.when(F.col("content") % 16 != 0, F.col("content").cast("string")).otherwise("").cast("binary")
    moved = t("tiles").select("z", (F.col("x") - 5).alias("x"), (F.col("y") - 3).alias("y"), data.alias("data"))
    return moved.select("z", "x", "y", classify.tile_valid(F.col("z"), F.col("x"), F.col("y"), F.col("data")).alias("valid"))


@query("x1_zoom_lists", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN '12,13,14,15,16' WHEN 1 THEN CAST(page_id % 25 AS VARCHAR) WHEN 2 THEN '10,12,14' END AS zooms FROM pages")
def _(t):
    text = F.when(F.col("page_id") % 4 == 0, "16-12").when(F.col("page_id") % 4 == 1, (F.col("page_id") % 25).cast("string")).when(F.col("page_id") % 4 == 2, "10,14,12,12").otherwise("3-x")
    return t("pages").select("page_id", F.array_join(tiles.zooms(text), ",").alias("zooms"))


_MOMENTS = "m AS (SELECT set_id, count(*) AS n, avg(src_x) AS mx, avg(src_y) AS my, avg(dst_x) AS mu, avg(dst_y) AS mv FROM gcp_points GROUP BY 1), s AS (SELECT set_id, any_value(n) AS n, any_value(mx) AS mx, any_value(my) AS my, any_value(mu) AS mu, any_value(mv) AS mv, sum((src_x-mx)*(src_x-mx)) AS xx, sum((src_x-mx)*(src_y-my)) AS xy, sum((src_y-my)*(src_y-my)) AS yy, sum((src_x-mx)*(dst_x-mu)) AS xu, sum((src_y-my)*(dst_x-mu)) AS yu, sum((src_x-mx)*(dst_y-mv)) AS xv, sum((src_y-my)*(dst_y-mv)) AS yv FROM gcp_points JOIN m USING (set_id) GROUP BY 1)"
_SOLVED = "f AS (SELECT *, CASE WHEN n >= 3 AND xx*yy-xy*xy > 1e-12 * xx*yy THEN (xu*yy-yu*xy)/(xx*yy-xy*xy) END AS a, CASE WHEN n >= 3 AND xx*yy-xy*xy > 1e-12 * xx*yy THEN (yu*xx-xu*xy)/(xx*yy-xy*xy) END AS b, CASE WHEN n >= 3 AND xx*yy-xy*xy > 1e-12 * xx*yy THEN (xv*yy-yv*xy)/(xx*yy-xy*xy) END AS c, CASE WHEN n >= 3 AND xx*yy-xy*xy > 1e-12 * xx*yy THEN (yv*xx-xv*xy)/(xx*yy-xy*xy) END AS d FROM s)"


@query("a12_affine_fits", f"WITH {_MOMENTS}, {_SOLVED} SELECT set_id, n, {sql_milli('a*1000')} AS a, {sql_milli('b*1000')} AS b, {sql_milli('mu-(a*mx+b*my)')} AS tx, {sql_milli('mv-(c*mx+d*my)')} AS ty FROM f", "gcp_points")
def _(t):
    fits = calibration.fit(t("gcp_points"), "affine")
    return fits.select("set_id", "n", milli(F.col("transform.a") * 1000).alias("a"), milli(F.col("transform.b") * 1000).alias("b"), milli("transform.tx").alias("tx"), milli("transform.ty").alias("ty"))


@query("a11_similarity_fits", f"WITH {_MOMENTS} SELECT set_id, {sql_milli('(xu+yv)/(xx+yy)*1000')} AS alpha, {sql_milli('(xv-yu)/(xx+yy)*1000')} AS beta, {sql_milli('mu-mx')} AS shift_x FROM s", "gcp_points")
def _(t):
    points = t("gcp_points")
    similar, shift = calibration.fit(points, "similarity"), calibration.fit(points, "translation").select("set_id", F.col("transform.tx").alias("shift"))
    return similar.join(shift, "set_id").select("set_id", milli(F.col("transform.a") * 1000).alias("alpha"), milli(F.col("transform.c") * 1000).alias("beta"), milli("shift").alias("shift_x"))


@query("a14_fit_residuals", f"WITH {_MOMENTS}, {_SOLVED} SELECT set_id, {sql_milli('sqrt(avg(pow(a*(src_x-mx)+b*(src_y-my)+mu-dst_x,2)+pow(c*(src_x-mx)+d*(src_y-my)+mv-dst_y,2)))')} AS rmse FROM gcp_points JOIN f USING (set_id) WHERE a IS NOT NULL GROUP BY 1", "gcp_points")
def _(t):
    points = t("gcp_points")
    return calibration.rmse(points, calibration.fit(points, "affine").where("transform IS NOT NULL")).select("set_id", milli("rmse").alias("rmse"))


_EXTENT = "b AS (SELECT set_id, min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS n FROM (SELECT set_id, dst_x/20037508.342789244e0*180.0e0 AS lon, degrees(atan(sinh(dst_y/6378137.0e0))) AS lat FROM gcp_points) GROUP BY 1), h AS (SELECT set_id, (w+e)/2 AS cx, (s+n)/2 AS cy, greatest((e-w)*1.2e0, 0.02e0)/2 AS hw, greatest((n-s)*1.2e0, 0.02e0)/2 AS hh FROM b)"


@query("a9_control_extents", f"WITH {_EXTENT} SELECT set_id, {sql_milli('(cx-hw)*1000')} AS west, {sql_milli('(cy-hh)*1000')} AS south, {sql_milli('(cx+hw)*1000')} AS east, {sql_milli('(cy+hh)*1000')} AS north FROM h UNION ALL SELECT -1, 12000000, 48500000, 18900000, 51100000", "gcp_points")
def _(t):
    points = t("gcp_points")
    sets = points.select("set_id").distinct().union(points.sparkSession.range(1).select(F.lit(-1).alias("set_id")))  # the last one has no points
    boxes = calibration.extent(points, sets)
    return boxes.select("set_id", *[milli(F.col(f"box.{k}") * 1000).alias(k) for k in ("west", "south", "east", "north")])


_SMALL_SETS = "gcp AS (SELECT CASE (id // 4) % 4 WHEN 0 THEN id WHEN 1 THEN id - id % 2 ELSE id - id % 4 END AS set_id, id, src_x, src_y, dst_x, dst_y FROM gcp_points)"
_EDITOR = "CASE WHEN n >= 3 AND xx*yy-xy*xy > 1e-12 * greatest(xx*yy, 1e-300) THEN {0} WHEN n >= 2 AND xx+yy >= 1e-12 THEN {1} WHEN n = 1 THEN {2} END"


@query(
    "e18_fit_choices",
    f"WITH {_SMALL_SETS}, {_MOMENTS.replace('gcp_points', 'gcp')}, f AS (SELECT set_id, n, {_EDITOR.format('(xu*yy-yu*xy)/(xx*yy-xy*xy)', '(xu+yv)/(xx+yy)', '1.0e0')} AS a, {_EDITOR.format('(xv*yy-yv*xy)/(xx*yy-xy*xy)', '(xv-yu)/(xx+yy)', '0.0e0')} AS c FROM s) SELECT set_id, n, {sql_milli('a*1000')} AS a, {sql_milli('c*1000')} AS c FROM f",
    "gcp_points",
)
def _(t):
    small = F.when(F.floor(F.col("id") / 4) % 4 == 0, F.col("id")).when(F.floor(F.col("id") / 4) % 4 == 1, F.col("id") - F.col("id") % 2).otherwise(F.col("id") - F.col("id") % 4)
    fits = calibration.fit(t("gcp_points").withColumn("set_id", small), "editor")
    return fits.select("set_id", "n", milli(F.col("transform.a") * 1000).alias("a"), milli(F.col("transform.c") * 1000).alias("c"))


@query("e19_warp_methods", "SELECT set_id, CASE WHEN count(*) >= 6 THEN 'tps' WHEN count(*) >= 3 THEN 'polynomial' ELSE 'too_few' END AS method FROM gcp_points GROUP BY 1", "gcp_points")
def _(t):
    return t("gcp_points").groupBy("set_id").agg(F.count("*").alias("n")).select("set_id", classify.warp_method(F.col("n")).alias("method"))


_SOIL_NOW = 1715000000


@query(
    "a22_soil_readings",
    f"""WITH p AS (SELECT * FROM hours WHERE time <= {_SOIL_NOW}), m AS (SELECT place, arg_max(moisture, time) FILTER (WHERE moisture IS NOT NULL) AS moisture, CASE WHEN count(rain) > 0 THEN coalesce(sum(rain) FILTER (WHERE time >= {_SOIL_NOW} - 259200), 0.0e0) END AS rain FROM p GROUP BY 1)
SELECT place, {sql_milli('moisture*1000')} AS moisture, {sql_milli('rain')} AS rain, CASE WHEN moisture IS NOT NULL THEN CASE WHEN moisture < 0.2e0 THEN 'SUCHO' WHEN moisture < 0.35e0 THEN 'VLHKO' ELSE 'MOKRO' END WHEN rain < 3 THEN 'SUCHO' WHEN rain < 15 THEN 'VLHKO' WHEN rain IS NOT NULL THEN 'MOKRO' END AS soil FROM m WHERE moisture IS NOT NULL OR rain IS NOT NULL""",
    "hours",
)
def _(t):
    return layers.soil_readings(t("hours"), _SOIL_NOW).select("place", milli(F.col("moisture") * 1000).alias("moisture"), milli("rain_mm").alias("rain"), "soil")


@query("w6_running_soil", f"SELECT place, time, {sql_milli('last_value(moisture IGNORE NULLS) OVER (PARTITION BY place ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)*1000')} AS moisture, {sql_milli('coalesce(sum(rain) OVER (PARTITION BY place ORDER BY time RANGE BETWEEN 259200 PRECEDING AND CURRENT ROW), 0)')} AS rain FROM hours", "hours")
def _(t):
    return layers.running_soil(t("hours")).select("place", "time", milli(F.col("moisture") * 1000).alias("moisture"), milli("rain_mm").alias("rain"))


@query(
    "t11_blocked_hosts",
    "WITH i AS (SELECT *, sum(CASE WHEN status IN (429, 503) THEN 0 ELSE 1 END) OVER (PARTITION BY host ORDER BY at_ms, id) AS island FROM responses), s AS (SELECT *, sum(CASE WHEN status IN (429, 503) THEN 1 ELSE 0 END) OVER (PARTITION BY host, island ORDER BY at_ms, id) AS streak FROM i) SELECT id, host, CAST(streak AS BIGINT) AS streak, CASE WHEN status IN (429, 503) THEN CAST(at_ms + greatest(least(300000, 2000 * pow(2, least(streak - 1, 20))), least(300000, coalesce(retry_after_s, 0) * 1000)) AS BIGINT) END AS blocked_until FROM s",
    "responses",
)
def _(t):
    return layers.blocked_until(t("responses")).select("id", "host", "streak", "blocked_until")


@query("a20_daily_usage", "SELECT at_ms // 86400000 AS day, count(*) AS tiles, CAST(sum(bytes) AS BIGINT) AS bytes FROM responses GROUP BY 1", "responses")
def _(t):
    return layers.daily_usage(t("responses"))


_OUTCOMES = "log AS (SELECT id, id % 7 AS run, at_ms, CASE WHEN status = 429 THEN 'failed' WHEN bytes < 20000 THEN 'empty' WHEN id % 10 = 0 THEN 'skipped' ELSE 'ok' END AS outcome FROM responses)"


def _log(t):
    outcome = F.when(F.col("status") == 429, "failed").when(F.col("bytes") < 20000, "empty").when(F.col("id") % 10 == 0, "skipped").otherwise("ok")
    return t("responses").select("id", (F.col("id") % 7).alias("run"), "at_ms", outcome.alias("outcome"))


@query("a18_fetch_outcomes", f"WITH {_OUTCOMES} SELECT outcome, count(*) AS n FROM log GROUP BY 1", "responses")
def _(t):
    return layers.outcomes(_log(t))


@query("o10_first_failures", f"WITH {_OUTCOMES} SELECT run, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY at_ms, id) AS rank FROM log WHERE outcome = 'failed') WHERE rank <= 50", "responses")
def _(t):
    return layers.first_failures(_log(t)).select("run", "id", "rank")


@query("a25_endpoint_report", "SELECT CASE WHEN status = 200 THEN 'OK' ELSE 'HTTP' END AS status, count(*) AS n, bool_or(id % 3 = 0 AND status <> 200) AS fails FROM responses GROUP BY 1", "responses")
def _(t):
    checks = t("responses").select(F.when(F.col("id") % 3 == 0, "P1").otherwise("P2").alias("priority"), F.when(F.col("status") == 200, "OK").otherwise("HTTP").alias("status"))
    return layers.endpoint_report(checks)


@query("x7_reachable_feeds", "WITH l AS (SELECT DISTINCT l_suppkey AS a, l_partkey % 100 AS b FROM lineitem), r1 AS (SELECT DISTINCT b FROM l WHERE a = 3 AND b <> 3), r2 AS (SELECT DISTINCT b FROM l WHERE a IN (SELECT b FROM r1) AND b <> 3 AND b NOT IN (SELECT b FROM r1)) SELECT '3' AS url, 0 AS depth UNION ALL SELECT CAST(b AS VARCHAR), 1 FROM r1 UNION ALL SELECT CAST(b AS VARCHAR), 2 FROM r2")
def _(t):
    links = t("lineitem").select(F.col("l_suppkey").cast("string").alias("from_url"), (F.col("l_partkey") % 100).cast("string").alias("to_url")).distinct()
    return layers.reachable_feeds(links, "3")


@query("g4_scan_strips", "SELECT p_partkey AS scan_id, s AS strip, least(4100, h - s * 4100) AS \"rows\" FROM (SELECT p_partkey, 5000 + p_partkey * 37 % 9000 AS h FROM part WHERE p_size * 400 <= 15000) JOIN LATERAL (SELECT unnest(range(0, CAST(ceil(h / 4100.0e0) AS BIGINT))) AS s) ON true")
def _(t):
    scans = t("part").select(F.col("p_partkey").alias("scan_id"), (F.col("p_size") * 400).alias("width"), (5000 + F.col("p_partkey") * 37 % 9000).alias("height"), F.lit(0.0).alias("west"), F.lit(0.0).alias("south"), F.lit(1.0).alias("east"), F.lit(1.0).alias("north"))
    return layers.strips(scans).where("error IS NULL").select("scan_id", F.col("strip").cast("long").alias("strip"), F.col("rows"))


@query("f13_scans_by_prefix", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE starts_with(c_name, 'Customer#0000001')")
def _(t):
    return layers.scans(t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), "Customer#0000001")


@query("f12_sheet_lookup", "SELECT n_nationkey AS id FROM nation WHERE upper(n_name) = 'NATION_7' OR upper(concat('sheet ', n_nationkey)) = 'NATION_7'")
def _(t):
    return layers.sheets(t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("sheet "), F.col("n_nationkey").cast("string")).alias("other_name")), "nation_7").select("id")


@query("f14_priority_sources", "SELECT p_partkey AS id FROM part WHERE p_size % 3 = 0 AND p_partkey % 2 = 0")
def _(t):
    sources = t("part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 == 0, "P1").otherwise("P2").alias("priority"), (F.col("p_partkey") % 2 == 0).alias("verified"))
    return layers.priority_sources(sources).select("id")


@query("f11_feed_items", "SELECT page_id FROM pages WHERE regexp_matches(url, '(?i)/FR/') AND (page_id % 3 = 0 OR page_id % 20 < 5)")
def _(t):
    box = lambda v: F.when(F.col("page_id") % 3 != 0, v)
    k = (F.col("page_id") % 20).cast("double")
    items = t("pages").select("page_id", F.lit("").alias("title"), "url", box(k).alias("west"), box(k).alias("south"), box(k + 0.5).alias("east"), box(k + 0.5).alias("north"))
    return layers.feed_items(items, "/FR/", {"west": 0.0, "south": 0.0, "east": 4.0, "north": 90.0}).select("page_id")


_SIDES = "nb AS (SELECT a.row, a.col, a.z, u.z AS up, d.z AS dn, l.z AS le, r.z AS ri FROM dem a LEFT JOIN dem u ON u.row = a.row-1 AND u.col = a.col LEFT JOIN dem d ON d.row = a.row+1 AND d.col = a.col LEFT JOIN dem l ON l.row = a.row AND l.col = a.col-1 LEFT JOIN dem r ON r.row = a.row AND r.col = a.col+1)"
_GRAD = "CASE WHEN {0} IS NOT NULL AND {1} IS NOT NULL THEN ({1}-{0})/2 WHEN {1} IS NOT NULL THEN {1}-z WHEN {0} IS NOT NULL THEN z-{0} ELSE 0.0e0 END"
_SLOPE = f"{_SIDES}, g AS (SELECT row, col, {_GRAD.format('up', 'dn')} AS dy, {_GRAD.format('le', 'ri')} AS dx FROM nb), sa AS (SELECT row, col, atan(sqrt(dx*dx+dy*dy)) AS slope, atan2(dy, -dx) AS aspect FROM g)"
_SHADE = "(" + " + ".join(f"greatest(0.0e0, least(1.0e0, cos(radians(45.0e0))*cos(slope) + sin(radians(45.0e0))*sin(slope)*cos(radians({450.0 - a}e0) - aspect)))" for a in raster.AZIMUTHS) + ")/6.0e0"


@query("r2_hillshade", f"WITH {_SLOPE} SELECT row, col, {sql_milli('slope')} AS slope, {sql_milli(_SHADE)} AS shade FROM sa", "dem")
def _(t):
    s = raster.slope_aspect(t("dem"), block=64)
    return s.select("row", "col", milli("slope").alias("slope"), milli(raster.hillshade(F.col("slope"), F.col("aspect"))).alias("shade"))


_OFFSETS = ", ".join(f"({k}, {dy}, {dx})" for k, steps in enumerate(raster.directions()) for dy, dx in steps if dy or dx)


@query("r3_sky_view", f"WITH o(k, dy, dx) AS (VALUES {_OFFSETS}), h AS (SELECT a.row, a.col, o.k, greatest(0.0e0, max((b.z - a.z)/sqrt(o.dy*o.dy+o.dx*o.dx))) AS t FROM dem a JOIN o ON true LEFT JOIN dem b ON b.row = a.row+o.dy AND b.col = a.col+o.dx GROUP BY 1, 2, 3) SELECT row, col, {sql_milli('avg(1.0e0 - sin(atan(coalesce(t, 0.0e0))))')} AS svf FROM h GROUP BY 1, 2", "dem")
def _(t):
    return raster.sky_view(t("dem"), block=64).select("row", "col", milli("svf").alias("svf"))


@query(
    "r4_relief",
    f"WITH {_SLOPE}, o(k, dy, dx) AS (VALUES {_OFFSETS}), h AS (SELECT a.row, a.col, o.k, greatest(0.0e0, max((b.z - a.z)/sqrt(o.dy*o.dy+o.dx*o.dx))) AS t FROM dem a JOIN o ON true LEFT JOIN dem b ON b.row = a.row+o.dy AND b.col = a.col+o.dx GROUP BY 1, 2, 3), v AS (SELECT row, col, avg(1.0e0 - sin(atan(coalesce(t, 0.0e0)))) AS svf FROM h GROUP BY 1, 2) SELECT row, col, {sql_milli('svf')} AS svf, {sql_milli(_SHADE)} AS shade, CAST(floor(round(greatest(0.0e0, least(1.0e0, {_SHADE} * 0.6e0 + svf * 0.4e0)) * 255.0e0, 9)) AS INT) AS value FROM sa JOIN v USING (row, col)",
    "dem",
)
def _(t):
    r = raster.relief(t("dem"), block=64)
    return r.select("row", "col", milli("svf").alias("svf"), milli("shade").alias("shade"), "value")


@query("r5_idw_grid", f"WITH p AS (SELECT x, y, z FROM points_cloud), c AS (SELECT DISTINCT CAST(floor(x) AS INT) + dx AS col, CAST(floor(y) AS INT) + dy AS row FROM p, (SELECT unnest(range(-2, 3)) AS dx), (SELECT unnest(range(-2, 3)) AS dy)), j AS (SELECT row, col, z, pow(x - (col + 0.5e0), 2) + pow(y - (row + 0.5e0), 2) AS d2 FROM c JOIN p ON x BETWEEN col - 2.5e0 AND col + 3.5e0 AND y BETWEEN row - 2.5e0 AND row + 3.5e0) SELECT CAST(row AS INT) AS row, CAST(col AS INT) AS col, {sql_milli('coalesce(avg(z) FILTER (WHERE d2 < 1e-18), sum(z/greatest(d2,1e-18))/sum(1/greatest(d2,1e-18)))')} AS z FROM j WHERE d2 <= 4 GROUP BY 1, 2", "points_cloud")
def _(t):
    return raster.idw_grid(t("points_cloud")).select("row", "col", milli("z").alias("z"))


@query("s5_finds_features", f"SELECT f.id, {sql_milli('any_value(lat)*1000')} AS lat, {sql_milli('any_value(lon)*1000')} AS lon, any_value(f.title) AS title, any_value(depth_cm) AS depth_cm, count(p.find_id) AS photos, min(p.created_at) AS first_photo FROM finds f LEFT JOIN find_photos p ON p.find_id = f.id GROUP BY 1", "finds", "find_photos")
def _(t):
    written = exchange.finds_features(t("finds"), t("find_photos"))
    shape = "geometry struct<coordinates:array<double>>, properties struct<id:bigint,title:string,depthCm:int,photos:array<struct<created_at:bigint>>>"
    back = written.select(F.from_json("feature", shape).alias("f"))
    p = F.col("f.properties")
    first = F.when(F.size(p["photos"]) > 0, F.element_at(p["photos"], 1)["created_at"])
    return back.groupBy(p["id"].alias("id")).agg(
        milli(F.max(F.col("f.geometry.coordinates")[1]) * 1000).alias("lat"), milli(F.max(F.col("f.geometry.coordinates")[0]) * 1000).alias("lon"), F.max(p["title"]).alias("title"), F.max(p["depthCm"]).alias("depth_cm"),
        F.sum(F.size(p["photos"]).cast("long")).alias("photos"), F.min(first).alias("first_photo"),
    )


@query("s5_places_features", f"SELECT id, {sql_milli('lat*1000')} AS lat, type, title, created_at, visited FROM places", "places")
def _(t):
    shape = "geometry struct<coordinates:array<double>>, properties struct<id:bigint,type:string,title:string,createdAt:bigint,visited:boolean>"
    back = exchange.places_features(t("places")).select(F.from_json("feature", shape).alias("f"))
    p = F.col("f.properties")
    return back.select(p["id"].alias("id"), milli(F.col("f.geometry.coordinates")[1] * 1000).alias("lat"), p["type"].alias("type"), p["title"].alias("title"), p["createdAt"].alias("created_at"), p["visited"].alias("visited"))


def _collection(features, *order):
    """Features written as one document of several files, and read back."""
    spark = features.sparkSession
    path = shared_path(spark, f"collection-{uuid.uuid4().hex}")
    exchange.write_collection(features, path, *order)
    at_exit(spark, path)
    return exchange.read_collection(spark, path)


@query("s4_framed_points", f"SELECT id, {sql_milli('lat*1000')} AS lat, {sql_milli('lon*1000')} AS lon, CASE WHEN id % 5 <> 0 THEN CAST(id % 900 AS DOUBLE) END AS altitude FROM finds", "finds")
def _(t):
    height = F.when(F.col("id") % 5 != 0, (F.col("id") % 900).cast("double"))
    features = t("finds").select("id", exchange.point_feature(F.col("lat"), F.col("lon"), height, F.struct("id")).alias("feature"))
    found = exchange.points(_collection(features, "id"))[0]
    return found.select(F.element_at("properties", "id").cast("long").alias("id"), milli(F.col("lat") * 1000).alias("lat"), milli(F.col("lon") * 1000).alias("lon"), "altitude")


@query("s5_areas_features", f"SELECT id, name, status, {sql_milli('area_ha')} AS milli_ha, CASE WHEN id % 7 = 0 THEN 'broken {{ ' || id END AS raw, CASE WHEN id % 7 <> 0 THEN {sql_milli('lat*1000')} END AS south, CASE WHEN id % 7 <> 0 THEN {sql_milli('(lon+side)*1000')} END AS east FROM areas", "areas")
def _(t):
    ring = polygons(t("areas")).select("poly_id", exchange.ring_to_geojson(F.element_at("rings", 1)).alias("geo"))
    areas = t("areas").hint("merge").join(ring.hint("merge"), F.col("id") == F.col("poly_id"))
    text = F.when(F.col("id") % 7 == 0, F.concat(F.lit("broken { "), F.col("id").cast("string"))).otherwise(F.col("geo"))
    docs = _collection(exchange.areas_features(areas.select("id", "name", "status", "area_ha", text.alias("polygon_geojson"))), "id")
    p = lambda c: F.element_at("properties", c)
    rows = exchange.features(docs).select(p("id").cast("long").alias("id"), p("name").alias("name"), p("status").alias("status"), milli(p("areaHa").cast("double")).alias("milli_ha"), p("polygonRaw").alias("raw"))
    boxes = exchange.polygons(docs).select(p("id").cast("long").alias("id"), milli(F.col("south") * 1000).alias("south"), milli(F.col("east") * 1000).alias("east"))
    return rows.hint("merge").join(boxes.hint("merge"), "id", "left")


@query("s10_calibration_round_trip", f"SELECT id, layer_id, {sql_milli('west*1000')} AS west, {sql_milli('b*1000')} AS b, {sql_milli('ty*1000')} AS ty, active FROM calibrations", "calibrations")
def _(t):
    back = exchange.read_calibrations(exchange.calibration_rows(t("calibrations")))
    return back.select("id", "layer_id", *[milli(F.col(c) * 1000).alias(c) for c in ("west", "b", "ty")], "active")


@query("s1_polygon_round_trip", f"SELECT id, CASE WHEN holed THEN 2 ELSE 1 END AS rings, {sql_milli('lat*1000')} AS south, uan FROM areas", "areas")
def _(t):
    areas = polygons(t("areas"))
    ring = lambda r: F.transform(r, lambda p: F.array(p["lon"], p["lat"]))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.transform("rings", ring).alias("coordinates"))
    text = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.col("properties").alias("properties"))).alias("features")))
    back = exchange.polygons(areas.select(F.col("poly_id").alias("id"), text.alias("doc")))
    return back.select("id", F.size("rings").alias("rings"), milli(F.col("south") * 1000).alias("south"), F.element_at("properties", "uan").alias("uan"))


@query("s2_point_round_trip", f"SELECT id, {sql_milli('lat*1000')} AS lat, {sql_milli('lon*1000')} AS lon FROM finds", "finds")
def _(t):
    feature = exchange.point_feature(F.col("lat"), F.col("lon"), F.lit(None).cast("double"), F.struct("title"))
    docs = t("finds").select("id", F.concat(F.lit('{"type":"FeatureCollection","features":['), feature, F.lit("]}")).alias("doc"))
    return exchange.points(docs)[0].select("id", milli(F.col("lat") * 1000).alias("lat"), milli(F.col("lon") * 1000).alias("lon"))


def _measured_points(t):
    """Points with altitudes and accuracies, some of them unknown."""
    height = F.when(F.col("arrival") % 4 != 0, 200.0 + F.col("arrival") % 900 / 10.0)
    return t("fixes").select("track_id", "ts", F.col("arrival").alias("id"), "lat", "lon", height.alias("altitude"), "accuracy_m")


@query(
    "s6_gpx_round_trip",
    f"SELECT track_id, count(*) AS points, min(ts) AS first_ts, max(ts) AS last_ts, CAST(sum(ts % 1000003) AS BIGINT) AS checked, {sql_milli('sum(CASE WHEN arrival % 4 <> 0 THEN 200.0e0 + arrival % 900 / 10.0e0 END)')} AS heights, {sql_milli('sum(accuracy_m)')} AS accuracies, {sql_milli('sum(lat)*1000')} AS lats FROM fixes GROUP BY 1",
    "fixes",
)
def _(t):
    texts = exchange.gpx(tracks_of(t), _measured_points(t), exact=True, most=60)  # small documents, so that tracks have several
    _, points = exchange.read_gpx(texts.withColumnRenamed("gpx", "doc"))
    sums = [milli(F.sum("altitude")).alias("heights"), milli(F.sum("accuracy_m")).alias("accuracies"), milli(F.sum("lat") * 1000).alias("lats")]
    return points.groupBy("track_id").agg(F.count("*").alias("points"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum(F.col("ts") % 1000003).alias("checked"), *sums)


_ISO = "strftime(make_timestamp({0} * 1000), '%Y-%m-%dT%H:%M:%SZ')"


@query(
    "s8_plain_gpx",
    f"""WITH p AS (SELECT *, (row_number() OVER (PARTITION BY track_id ORDER BY ts, arrival) - 1) AS k, CASE WHEN arrival % 4 <> 0 THEN 200.0e0 + arrival % 900 / 10.0e0 END AS h FROM fixes)
SELECT track_id, count(*) AS points, CAST(sum(CAST('0x' || substr(md5(k || '<trkpt lat="' || printf('%.7f', lat) || '" lon="' || printf('%.7f', lon) || '">' || coalesce('<ele>' || printf('%.2f', h) || '</ele>', '') || '<time>' || {_ISO.format('ts')} || '</time></trkpt>'), 1, 8) AS BIGINT)) AS BIGINT) AS vertices, '<name>Track ' || track_id || '</name><time>' || {_ISO.format('min(ts)')} || '</time>' AS metadata FROM p GROUP BY 1""",
    "fixes",
)
def _(t):
    text = exchange.gpx(tracks_of(t), _measured_points(t))
    between = lambda a, b: F.substring_index(F.substring_index("gpx", a, -1), b, 1)
    parts = text.select("track_id", "block", between("<trkseg>", "</trkseg>").alias("body"), between("<metadata>", "</metadata>").alias("metadata"))
    counted = F.sum((F.length("body") - F.length(F.replace("body", F.lit("<trkpt "), F.lit("")))) / 7).cast("long")
    # each vertex is hashed with its place in the track, and the hashes are added up: no row holds a track
    hashed = F.transform(F.filter(F.split("body", "(?<=</trkpt>)"), lambda v: v != ""), lambda v, i: F.conv(F.substring(F.md5(F.concat((F.col("block").cast("long") * BLOCK + i).cast("string"), v).cast("binary")), 1, 8), 16, 10).cast("long"))
    vertices = parts.select("track_id", "block", "body", "metadata", F.aggregate(hashed, F.lit(0).cast("long"), lambda s, v: s + v).alias("hashes"))
    return vertices.groupBy("track_id").agg(counted.alias("points"), F.sum("hashes").alias("vertices"), F.min_by("metadata", "block").alias("metadata"))


@query(
    "s9_manifest",
    "SELECT (SELECT count(*) FROM finds) AS finds, (SELECT count(*) FROM find_photos) AS photos, (SELECT count(*) FROM places) AS places, (SELECT count(*) FROM areas) AS areas, (SELECT count(DISTINCT track_id) FROM fixes) AS tracks, (SELECT count(*) FROM fixes) AS track_points, (SELECT count(*) FROM calibrations) AS calibrations, (SELECT count(DISTINCT set_id) FROM gcp_points) AS gcp_sets, (SELECT count(*) FROM gcp_points) AS gcp_points, (SELECT count(*) FROM find_photos WHERE uri NOT IN (SELECT concat('/p/', p_partkey, '.jpg') FROM part WHERE p_size < 45)) AS missing_photos, 2 AS schema_version, 1 AS format_version",
    "finds", "find_photos", "places", "areas", "fixes", "calibrations", "gcp_points",
)
def _(t):
    # files are there for the parts that are small enough
    files = t("part").where("p_size < 45").select(F.concat(F.lit("/p/"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("uri"))
    tables = {"finds": t("finds"), "photos": t("find_photos"), "places": t("places"), "areas": t("areas"), "tracks": tracks_of(t), "track_points": t("fixes"), "calibrations": t("calibrations"), "gcp_sets": t("gcp_points").select("set_id").distinct(), "gcp_points": t("gcp_points")}
    return exchange.manifest(tables, files)


@query("s10_control_sets", "SELECT set_id AS id, count(*) AS points, min(id) AS first_id, CAST(sum(src_x) AS BIGINT) AS xs FROM gcp_points GROUP BY 1", "gcp_points")
def _(t):
    points = t("gcp_points")
    sets = exchange.control_sets(points.select(F.col("set_id").alias("id")).distinct(), points)
    xs = F.aggregate("points", F.lit(0.0), lambda s, p: s + p["src_x"]).cast("long")
    return sets.groupBy("id").agg(F.sum(F.size("points").cast("long")).alias("points"), F.min(F.element_at("points", 1)["id"]).alias("first_id"), F.sum(xs).alias("xs"))


_BAD_DOCS = "docs AS (SELECT CASE WHEN (id // 5) % 6 = 0 THEN 1000000000 + id ELSE id // 5 END AS doc, CASE WHEN id % 37 = 0 THEN NULL ELSE src_x END AS px, src_y AS py, CASE WHEN id % 41 = 0 THEN 400.0e0 ELSE 15.0e0 END AS lon FROM gcp_points), g AS (SELECT *, CASE WHEN doc % 3 = 0 THEN 1500 WHEN doc % 10 = 1 THEN 0 ELSE 2000 END AS width FROM docs)"


@query(
    "s11_control_validation",
    f"WITH {_BAD_DOCS} SELECT doc, doc % 7 = 0 AS no_image, doc % 3 <> 0 AND doc % 10 = 1 AS bad_size, count(*) < 3 AS few_points, bool_or(px IS NULL) AS incomplete, bool_or(lon > 180) AS bad_lonlat, coalesce(bool_or(px > width OR py > 1800), false) AS outside FROM g GROUP BY 1",
    "gcp_points",
)
def _(t):
    doc = F.when(F.floor(F.col("id") / 5) % 6 == 0, 1000000000 + F.col("id")).otherwise(F.floor(F.col("id") / 5))
    points = exchange.control_points_lonlat(t("gcp_points")).withColumns({"doc": doc, "px": F.when(F.col("id") % 37 != 0, F.col("px")), "lon": F.when(F.col("id") % 41 == 0, 400.0).otherwise(15.0)})
    nested = fieldlog.nested(points.select(F.col("doc").alias("set")).distinct(), points.select("doc", "id", "px", "py", "lon", "lat"), "set", "doc", ["id"], "points")
    docs = nested.select(
        "set", F.when(F.col("set") % 7 != 0, "scan.jpg").alias("image"), F.when(F.col("set") % 3 == 0, 1500).when(F.col("set") % 10 == 1, 0).otherwise(2000).alias("width"), F.lit(1800).alias("height"),
        F.transform("points", lambda p: F.struct(p["px"].alias("px"), p["py"].alias("py"), p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("points"),
    )
    codes = {"NO_IMAGE": "no_image", "BAD_SIZE": "bad_size", "FEW_POINTS": "few_points", "INCOMPLETE": "incomplete", "BAD_LONLAT": "bad_lonlat", "OUTSIDE": "outside"}
    return exchange.validate_control(docs).select(F.col("set").alias("doc"), *[F.array_contains("errors", code).alias(n) for code, n in codes.items()])


@query("s15_hourly_round_trip", "SELECT place, count(*) AS hours, count(moisture) AS known, CAST(floor((sum(CAST(round(rain * 1000000) AS BIGINT)) + 500) / 1000.0e0) AS BIGINT) AS rain FROM hours GROUP BY 1", "hours")
def _(t):
    lists = in_blocks(t("hours"), "place", ["time"], "h", most=100)
    pick = lambda k: F.transform("h", lambda x: x[k])
    payload = F.to_json(F.struct(F.struct(pick("time").alias("time"), pick("moisture").alias("soil_moisture_3_to_9cm"), pick("rain").alias("precipitation")).alias("hourly")), {"ignoreNullFields": "false"})
    back = exchange.hourly(lists.select("place", payload.alias("doc")))
    # sums of whole millionths are exact: those of doubles end on either side of a half, by the order of the rows
    rain = F.floor((F.sum(F.round(F.col("rain") * 1_000_000).cast("long")) + 500) / 1000.0)
    return back.groupBy("place").agg(F.count("*").alias("hours"), F.count("moisture").alias("known"), rain.alias("rain"))


@query("s16_paged_features", "SELECT user_id AS run, least(count(*), 50) AS n, user_id % 2 = 1 AND count(*) % 10 <> 0 AS complete FROM events GROUP BY 1")
def _(t):
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    numbered = t("events").select(F.col("user_id").alias("run"), "event_id", k.alias("k"))
    # a page has ten features; the even runs' servers always say that there are more
    pages = numbered.groupBy("run", (F.floor(F.col("k") / 10) * 10).alias("offset")).agg(F.sort_array(F.collect_list("event_id")).alias("features")).withColumn("exceeded", F.col("run") % 2 == 0)
    found, runs = exchange.paged_features(pages, 50, 10)
    counts = found.groupBy("run").agg(F.count("*").alias("n"))
    return counts.hint("merge").join(runs.select("run", "complete").hint("merge"), "run")


@query("s17_feed_entries", "SELECT page_id, 'T' || page_id AS title, CASE page_id % 3 WHEN 0 THEN 'http://x/' || page_id || '.LAZ' WHEN 1 THEN 'http://x/sub/' || page_id ELSE 'http://x/' || page_id || '.zip' END AS url, CASE WHEN page_id % 3 = 1 THEN 'feed' ELSE 'file' END AS kind, CASE WHEN page_id % 4 <> 0 THEN CAST(page_id % 90 * 1000 AS BIGINT) END AS south, CASE WHEN page_id % 4 <> 0 THEN CAST(page_id % 170 * 1000 + 1500 AS BIGINT) END AS east FROM pages")
def _(t):
    p = F.col("page_id")
    number = lambda c: c.cast("string")
    south, west = p % 90, p % 170
    box = F.concat(F.lit('<georss:box xmlns:georss="g">'), number(south), F.lit(" "), number(west), F.lit(" "), number(south + 0.5), F.lit(" "), number(west + 1.5), F.lit("</georss:box>"))
    link = F.when(p % 3 == 0, F.concat(F.lit('href="http://x/'), number(p), F.lit('.LAZ" type="application/zip"'))).when(p % 3 == 1, F.concat(F.lit('href="http://x/sub/'), number(p), F.lit('" type="application/atom+xml"'))).otherwise(F.concat(F.lit('href="http://x/'), number(p), F.lit('.zip" type="application/zip"')))
    other = F.lit('<link href="http://x/readme.txt" type="text/plain"/>')  # neither a file nor a feed
    doc = F.concat(F.lit("<feed><entry><title>T"), number(p), F.lit("</title><link "), link, F.lit("/>"), other, F.when(p % 4 != 0, box).otherwise(""), F.lit("</entry></feed>"))
    found = exchange.feed_entries(t("pages").select("page_id", doc.alias("doc")))
    return found.select("page_id", "title", "url", "kind", milli("south").alias("south"), milli("east").alias("east"))


@query("s18_layer_catalogue", "SELECT 4 AS version, CAST(n_nationkey AS INT) AS ord, 'l' || n_nationkey AS layer_id, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'l' || n_nationkey END AS title, CASE WHEN n_nationkey % 3 = 0 THEN 'wms' ELSE 'xyz' END AS kind, n_nationkey % 4 = 0 AS visible, CASE WHEN n_nationkey % 5 = 0 THEN 500 ELSE 1000 END AS opacity, CASE WHEN n_nationkey % 2 = 0 THEN 3 ELSE 0 END AS min_zoom, 22 AS max_zoom FROM nation")
def _(t):
    k = F.col("n_nationkey")
    layer = F.struct(F.concat(F.lit("l"), k.cast("string")).alias("id"), F.when(k % 2 == 0, F.col("n_name")).alias("title"), F.when(k % 3 == 0, "wms").alias("kind"), F.when(k % 4 == 0, True).alias("visible"), F.when(k % 5 == 0, 0.5).alias("opacity"), F.when(k % 2 == 0, 3).alias("minZoom"), F.lit(None).cast("int").alias("maxZoom"), F.lit(None).cast("string").alias("attribution"))
    doc = t("nation").groupBy(F.lit(4).alias("version")).agg(F.transform(F.array_sort(F.collect_list(F.struct(k, layer.alias("l")))), lambda x: x["l"]).alias("layers"))  # a catalogue has a few layers
    out = exchange.layer_catalogue(doc.select(F.from_json(F.to_json(F.struct("version", "layers")), exchange.LAYERS).alias("d")).select("d.*"))
    return out.select("version", "ord", "layer_id", "title", "kind", "visible", (F.col("opacity") * 1000).cast("int").alias("opacity"), "min_zoom", "max_zoom")


_LINES = "SELECT track_id * 100000 + arrival // 90 AS line, count(*) AS points FROM fixes GROUP BY 1 HAVING count(*) >= 2"


@query("f18_usable_lines", _LINES, "fixes")
def _(t):
    pieces = t("fixes").select((F.col("track_id") * 100000 + F.floor(F.col("arrival") / 90)).alias("line"), "arrival")
    return exchange.usable_line(pieces, "line").groupBy("line").agg(F.count("*").alias("points"))


@query("e30_ring_text", f"SELECT id, 4 AS corners, {sql_milli('lon*1000')} AS west FROM areas", "areas")
def _(t):
    rings = polygons(t("areas")).select(F.col("poly_id").alias("id"), exchange.geojson_to_ring(exchange.ring_to_geojson(F.element_at("rings", 1))).alias("r"))
    return rings.select("id", F.size("r").alias("corners"), milli(F.element_at("r", 1)["lon"] * 1000).alias("west"))


@query("o9_clustered_tiles", f"WITH RECURSIVE {_TILE_IDS} SELECT d AS tile_id, row_number() OVER (ORDER BY d) AS place FROM h WHERE k = 0", "tiles")
def _(t):
    # the places are those of the files that were written: file by file, row by row
    laid = kept(tiles.clustered(tiles.with_ids(t("tiles")), 4), "clustered")
    rows = laid.select("tile_id", F.col("_metadata.file_name").alias("file"), (F.col("_metadata.row_index") + 1).alias("row"))
    counts = rows.groupBy("file").agg(F.count("*").alias("n"))  # four files
    before = counts.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "file").select("tile_id", (F.col("before") + F.col("row")).alias("place"))


def _stream(t, name: str, table: str, columns):
    """A derived table as a stream: written as files in the shared folder, then read by a stream."""
    df = t(table).select(*columns)
    spark = df.sparkSession
    path = shared_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


@query("t1_recorder_stream", f"WITH RECURSIVE {_RECORDER} SELECT track_id, count(*) AS fixes, count(*) FILTER (WHERE decision = 'ACCURACY') AS bad_accuracy, count(*) FILTER (WHERE decision = 'JUMP') AS jumps, count(*) FILTER (WHERE decision = 'OUT_OF_ORDER') AS late, CAST(round(max(dist)) AS BIGINT) AS metres, max(verts) AS vertices, bool_or(idle) AS was_idle FROM rec WHERE k > 0 GROUP BY 1", "fixes")
def _(t):
    columns = ["track_id", "arrival", "ts", "lat", "lon", F.col("accuracy_m").cast("double").alias("accuracy_m"), F.lit(False).alias("stop")]
    stream = recorder.record_stream(recorder.replay(t("fixes").select(*columns), "arrival"), close_silent=False)
    out = recorder.drain(stream, "recorded_fixes").where("decision <> 'TAIL'")
    of = lambda d: F.count(F.when(F.col("decision") == d, 1))
    return out.groupBy("track_id").agg(
        F.count("*").alias("fixes"), of("ACCURACY").alias("bad_accuracy"), of("JUMP").alias("jumps"), of("OUT_OF_ORDER").alias("late"), F.round(F.max("distance_m")).cast("long").alias("metres"), F.max("vertices").alias("vertices"), F.bool_or("idle").alias("was_idle")
    )


@query(
    "t5_silent_tracks",
    "WITH m AS (SELECT *, max(ts) OVER (PARTITION BY track_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS up_to FROM fixes), i AS (SELECT *, sum(CASE WHEN ts - up_to > 7200001 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY arrival) AS island FROM m), g AS (SELECT track_id, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS fixes, island = max(island) OVER (PARTITION BY track_id) AS is_last FROM i GROUP BY track_id, island) SELECT track_id, started_at, ended_at, fixes FROM g WHERE NOT is_last OR ended_at + 7200001 < (SELECT max(ts) - 43200000 FROM fixes)",
    "fixes",
)
def _(t):
    stream = recorder.close_silent(recorder.replay(t("fixes").select("track_id", "arrival", "ts"), "arrival"), 7_200_001, "12 hours")
    return recorder.drain(stream, "silent_tracks")


@query(
    "t12_mark_stream",
    "SELECT m.track_id, m.mark_id, f.ts AS fix_ts, f.lat FROM (SELECT user_id AS track_id, event_id AS mark_id, 1600000000000 + event_id * 14000 AS ts FROM events) m ASOF LEFT JOIN (SELECT track_id, ts, max_by(lat, arrival) AS lat FROM fixes GROUP BY 1, 2) f ON f.track_id = m.track_id AND f.ts <= m.ts",
    "fixes",
)
def _(t):
    # one source of both kinds in order of time, some marks before and some behind their fixes; a stop row ends each track
    null = lambda kind, c: F.lit(None).cast(kind).alias(c)
    fixes = t("fixes").select("track_id", "arrival", null("long", "mark_id"), "ts", "lat", "lon", F.lit(False).alias("stop"), (F.lit(1600000000000) + F.col("arrival") * 15000).alias("at"))
    marked = F.lit(1600000000000) + F.col("event_id") * 14000
    marks = t("events").select(F.col("user_id").alias("track_id"), null("long", "arrival"), F.col("event_id").alias("mark_id"), marked.alias("ts"), null("double", "lat"), null("double", "lon"), null("boolean", "stop"), (marked + (F.col("event_id") % 7 - 3) * 600_000).alias("at"))
    end = fixes.agg(F.max("at")).first()[0] or 0
    stops = fixes.select("track_id").distinct().select("track_id", null("long", "arrival"), null("long", "mark_id"), F.lit(end).alias("ts"), null("double", "lat"), null("double", "lon"), F.lit(True).alias("stop"), F.lit(end + 10**10).alias("at"))
    both = recorder.replay(fixes.unionByName(marks).unionByName(stops), "at", "track_id")
    out = recorder.marks_stream(both.where("mark_id IS NOT NULL"), both.where("mark_id IS NULL"))
    return recorder.drain(out, "marks").select("track_id", "mark_id", "fix_ts", "lat")


@query("t11_blocked_stream", "WITH i AS (SELECT *, sum(CASE WHEN status IN (429, 503) THEN 0 ELSE 1 END) OVER (PARTITION BY host ORDER BY at_ms, id) AS island FROM responses), s AS (SELECT *, sum(CASE WHEN status IN (429, 503) THEN 1 ELSE 0 END) OVER (PARTITION BY host, island ORDER BY at_ms, id) AS streak FROM i) SELECT id, CAST(streak AS BIGINT) AS streak, CASE WHEN status IN (429, 503) THEN CAST(at_ms + greatest(least(300000, 2000 * pow(2, least(streak - 1, 20))), least(300000, coalesce(retry_after_s, 0) * 1000)) AS BIGINT) END AS blocked_until FROM s", "responses")
def _(t):
    stream = recorder.blocked_stream(recorder.replay(t("responses").select("host", "id", "at_ms", "status", "retry_after_s"), "at_ms", "id"))
    return recorder.drain(stream, "blocked_hosts").select("id", "streak", "blocked_until")


@query("t8_daily_counter", "SELECT CAST(at_ms // 86400000 AS BIGINT) AS day, count(*) AS tiles, CAST(sum(bytes) AS BIGINT) AS bytes FROM responses GROUP BY 1", "responses")
def _(t):
    stream = _stream(t, "usage", "responses", [F.timestamp_millis("at_ms").alias("ts"), "bytes"])
    out = recorder.drain(recorder.daily_counter(stream), "daily_counter", "complete")
    return out.select(F.floor(F.unix_millis("day") / 86_400_000).alias("day"), "tiles", "bytes")


@query("t7_live_histogram", "SELECT category, count(*) AS n FROM finds GROUP BY 1", "finds")
def _(t):
    return recorder.drain(recorder.live_histogram(_stream(t, "finds", "finds", ["category"])), "live_histogram", "complete")


_FIND_CHANGES = """changes AS (SELECT id, 1 AS version, category, favorite, false AS deleted FROM finds UNION ALL SELECT id, 2, CASE WHEN id % 2 = 0 THEN 'MINCE' ELSE category END, NOT favorite, false FROM finds WHERE id % 3 = 0 UNION ALL SELECT id, 3, category, favorite, true FROM finds WHERE id % 10 = 0),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS rn FROM changes) WHERE rn = 1 AND NOT deleted)"""


def _live_finds(t):
    """Finds that are added, changed and deleted, as a stream in order of the changes."""
    finds = t("finds").select("id", "category", "favorite")
    row = lambda df, version, category, favorite, deleted: df.select("id", F.lit(version).alias("version"), category.alias("category"), favorite.alias("favorite"), F.lit(deleted).alias("deleted"))
    first = row(finds, 1, F.col("category"), F.col("favorite"), False)
    second = row(finds.where("id % 3 = 0"), 2, F.when(F.col("id") % 2 == 0, "MINCE").otherwise(F.col("category")), ~F.col("favorite"), False)
    third = row(finds.where("id % 10 = 0"), 3, F.col("category"), F.col("favorite"), True)
    spark = finds.sparkSession
    path = shared_path(spark, f"live-{uuid.uuid4().hex}")
    live = views.LiveList(spark, path, "id long, version int, category string, favorite boolean, deleted boolean", ["id"], "version", ["category"])
    live.follow(recorder.replay(first.unionByName(second).unionByName(third), "version", "id", most=views.BATCHES), f"{path}/log")
    at_exit(spark, path)
    return live


@query("t7_live_finds", f"WITH {_FIND_CHANGES} SELECT id, category, favorite FROM newest", "finds")
def _(t):
    return _live_finds(t).current().select("id", "category", "favorite")


@query("t7_live_totals", f"WITH {_FIND_CHANGES} SELECT category, count(*) AS n FROM newest GROUP BY 1", "finds")
def _(t):
    return _live_finds(t).totals()


@query("t7_live_places", "SELECT id, type, CASE WHEN id % 2 = 0 THEN NOT visited ELSE visited END AS visited FROM places", "places")
def _(t):
    places = t("places").select("id", F.lit(1).alias("version"), "type", "visited", F.lit(False).alias("deleted"))
    changed = places.where("id % 2 = 0").withColumns({"version": F.lit(2), "visited": ~F.col("visited")})
    spark = places.sparkSession
    path = shared_path(spark, f"live-{uuid.uuid4().hex}")
    live = views.LiveList(spark, path, "id long, version int, type string, visited boolean, deleted boolean", ["id"], "version", ["type", "visited"])
    live.follow(recorder.replay(places.unionByName(changed), "version", "id", most=views.BATCHES), f"{path}/log")
    at_exit(spark, path)
    return live.current().select("id", "type", "visited")


_RECOUNTS = f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY arrival) AS k FROM fixes),
rec AS (SELECT track_id, k, arrival, lat AS plat, lon AS plon, true AS due FROM numbered WHERE k = 1
UNION ALL SELECT track_id, k, arrival, CASE WHEN due THEN lat ELSE plat END, CASE WHEN due THEN lon ELSE plon END, due FROM (SELECT o.*, r.plat, r.plon, {sql_distance('r.plat', 'r.plon', 'o.lat', 'o.lon')} >= 30 AS due FROM rec r JOIN numbered o ON o.track_id = r.track_id AND o.k = r.k + 1) q)"""


@query("t9_recount_points", f"WITH RECURSIVE {_RECOUNTS} SELECT track_id, arrival FROM rec WHERE due", "fixes")
def _(t):
    stream = recorder.recount_points(recorder.replay(t("fixes").select("track_id", "arrival", "lat", "lon"), "arrival"))
    return recorder.drain(stream, "recount_points").select("track_id", "arrival")


_STEADY = """numbered AS (SELECT user_id AS device, event_id AS arrival, value % 360.0e0 AS heading, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
rec AS (SELECT device, k, arrival, heading AS last, true AS passed FROM numbered WHERE k = 1
UNION ALL SELECT device, k, arrival, CASE WHEN least(d, 360.0e0 - d) > 1.5e0 THEN heading ELSE last END, least(d, 360.0e0 - d) > 1.5e0 FROM (SELECT o.*, r.last, abs(o.heading - r.last) % 360.0e0 AS d FROM rec r JOIN numbered o ON o.device = r.device AND o.k = r.k + 1) q)"""


@query("t10_steady_headings", f"WITH RECURSIVE {_STEADY} SELECT device, arrival FROM rec WHERE passed")
def _(t):
    columns = [F.col("user_id").alias("device"), F.col("event_id").alias("arrival"), (F.col("value") % 360.0).alias("heading")]
    stream = recorder.steady_headings(recorder.replay(t("events").select(*columns), "arrival"))
    return recorder.drain(stream, "steady_headings").select("device", "arrival")


_TURN = "SELECT id, 1605282.7e0 AS px, 6461356.4e0 AS py, tx, ty, cos(b)*a AS c, sin(b)*a AS s FROM calibrations"


@query("e17_similarity_about_pivot", f"WITH m AS ({_TURN}) SELECT id, {sql_milli('px + tx + c*1000 + s*700')} AS x, {sql_milli('py + ty + s*1000 - c*700')} AS y, {sql_milli('px + tx')} AS pivot_x FROM m", "calibrations")
def _(t):
    # a point beside the pivot, where turn and scale show, and the pivot itself
    px, py = F.lit(1605282.7), F.lit(6461356.4)
    s = affine.similarity(px, py, F.col("tx"), F.col("ty"), F.col("b"), F.col("a"))
    x, y = px + 1000.0, py - 700.0
    return t("calibrations").select("id", milli(affine.apply_x(s, x, y)).alias("x"), milli(affine.apply_y(s, x, y)).alias("y"), milli(affine.apply_x(s, px, py)).alias("pivot_x"))


@query("e37_scan_sizes", "SELECT id, CAST(round(side * 100000 / 25) AS INT) AS width FROM areas", "areas")
def _(t):
    m = F.col("side") * 100000
    size = layers.scan_size(F.lit(0.0), F.lit(0.0), m, m, 25.0)
    return t("areas").select("id", size["width"].alias("width"))


@query("s12_control_lonlat", f"SELECT set_id, id, {sql_milli('dst_x/20037508.342789244e0*180.0e0*1000')} AS lon, {sql_milli('degrees(atan(sinh(dst_y/6378137.0e0)))*1000')} AS lat, {sql_milli('src_x')} AS px FROM gcp_points", "gcp_points")
def _(t):
    written = exchange.control_points_lonlat(t("gcp_points")).select(F.to_json(F.struct("set_id", "id", "px", "py", "lon", "lat")).alias("row"))
    back = written.select(F.from_json("row", "set_id int, id bigint, px double, py double, lon double, lat double").alias("r")).select("r.*")
    return back.select("set_id", "id", milli(F.col("lon") * 1000).alias("lon"), milli(F.col("lat") * 1000).alias("lat"), milli("px").alias("px"))


@query("s19_archive_metadata", "SELECT (SELECT n_name FROM nation WHERE n_nationkey = 0) AS name, 'jpg' AS format, 5 AS min_zoom, (SELECT max(z) FROM tiles) AS max_zoom, 12000 AS west, 51000 AS north", "tiles")
def _(t):
    # settings under odd spellings, one that is no number, and others that mean nothing
    k = F.col("n_nationkey")
    key = F.when(k == 0, "Name").when(k == 1, "MINZOOM").when(k == 2, "maxzoom").when(k == 3, "bounds").when(k == 4, "Format").otherwise(F.concat(F.lit("other"), k.cast("string")))
    setting = F.when(k == 1, "5").when(k == 2, "x").when(k == 3, "12, 48,18,51").when(k == 4, "jpg").otherwise(F.col("n_name"))
    found = tiles.archive_metadata(t("nation").select(key.alias("name"), setting.alias("value")), t("tiles").select(F.col("z").alias("zoom_level")))
    return found.select("name", "format", "min_zoom", "max_zoom", (F.col("bounds")[0] * 1000).cast("int").alias("west"), (F.col("bounds")[3] * 1000).cast("int").alias("north"))


@query("s21_xyz_points", f"SELECT CAST(floor(x) AS BIGINT) AS column_, count(*) AS n, {sql_milli('sum(y)')} AS ys, {sql_milli('sum(z)')} AS zs FROM points_cloud GROUP BY 1", "points_cloud")
def _(t):
    points = t("points_cloud")
    path = shared_path(points.sparkSession, f"xyz-{uuid.uuid4().hex}")
    points.select(F.concat_ws(" ", *[F.col(c).cast("double").cast("string") for c in ("x", "y", "z")])).write.text(path)
    back = raster.read_xyz(points.sparkSession, path)
    return back.groupBy(F.floor("x").alias("column_")).agg(F.count("*").alias("n"), milli(F.sum("y")).alias("ys"), milli(F.sum("z")).alias("zs"))
