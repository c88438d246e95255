"""Readers and small operators that no registered query covers."""

import math
import time

import pytest
from pyspark.sql import functions as F

from terravane.functions import classify
from terravane.operators import blocks, fieldlog, raster, tiles
from terravane.sources import exchange
from terravane.streaming import recorder


def test_layer_catalogue_has_defaults(spark):
    rows = spark.createDataFrame([(4, [("a", None, None, True, None, None, None, None), ("b", "B", "wms", None, 0.5, 3, 9, "x")])], exchange.LAYERS)
    out = exchange.layer_catalogue(rows).orderBy("ord").collect()
    assert [tuple(r)[2:] for r in out] == [("a", "a", "xyz", True, 1.0, 0, 22, ""), ("b", "B", "wms", False, 0.5, 3, 9, "x")]


def test_archive_metadata(spark):
    tiles_ = spark.createDataFrame([(8,), (12,)], "zoom_level int")
    good = spark.createDataFrame([("Name", "n"), ("minzoom", "9"), ("maxzoom", "?"), ("bounds", "14, 49,15,50")], "name string, value string")
    row = tiles.archive_metadata(good, tiles_).first()
    assert (row["name"], row["min_zoom"], row["max_zoom"], row["bounds"]) == ("n", 9, 12, [14.0, 49.0, 15.0, 50.0])
    bad = spark.createDataFrame([("bounds", "15,49,14,50")], "name string, value string")
    assert tiles.archive_metadata(bad, tiles_).first()["bounds"] is None


def test_xyz_points(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("1.5 2.5 10\n3.5 2.5 20\nnot a point\n")
    points = raster.read_xyz(spark, str(tmp_path))
    assert points.where("z IS NOT NULL").count() == 2
    cells = {(r["row"], r["col"]): r["z"] for r in raster.idw_grid(points.where("z IS NOT NULL"), radius=1.0).collect()}
    assert cells[(2, 1)] == 10 and cells[(2, 3)] == 20


def test_tile_validity_and_lenient_values(spark):
    rows = spark.createDataFrame([(3, 1, 2, b"x", "TRUE", "7"), (3, 8, 2, b"x", "0", "x"), (27, 1, 1, b"x", "?", None), (3, 1, 2, b"", None, "1.5")], "z int, x int, y int, data binary, flag string, n string")
    out = rows.select(classify.tile_valid(F.col("z"), F.col("x"), F.col("y"), F.col("data")).alias("v"), classify.lenient_boolean(F.col("flag")).alias("b"), classify.lenient_number(F.col("n"), "int", 0).alias("n")).collect()
    assert [r["v"] for r in out] == [True, False, False, False] and [r["n"] for r in out][:3] == [7, 0, 0]
    assert [r["b"] for r in out] == [True, False, False, False]


def test_areas_features_keep_bad_geometry(spark):
    areas = spark.createDataFrame([(1, "a", "HOTOVO", 1.0, '{"type":"Polygon","coordinates":[]}'), (2, "b", "HOTOVO", 1.0, "broken")], "id long, name string, status string, area_ha double, polygon_geojson string")
    texts = {r["id"]: r["feature"] for r in exchange.areas_features(areas).collect()}
    assert '"geometry":{"type":"Polygon"' in texts[1] and '"geometry":null' in texts[2] and '"polygonRaw":"broken"' in texts[2]


def test_points_by_class_and_nodata(spark):
    points = spark.createDataFrame([(0.5, 0.5, 10.0, 2), (0.6, 0.5, 99.0, 5), (3.5, 0.5, 20.0, 2)], "x double, y double, z double, class int")
    ground = raster.idw_grid(points, radius=0.9, classes=[2])
    cells = {(r["row"], r["col"]): r["z"] for r in raster.dense(ground).collect()}
    assert cells[0, 0] == 10 and cells[0, 3] == 20 and cells[0, 1] == raster.NODATA == -9999


def test_blocks_are_bounded_and_in_order(spark):
    rows = [("hot" if k % 3 else f"k{k % 50}", k * 7919 % 5000, k) for k in range(4000)] + [("hot", 3, 1)] * 40
    df = spark.createDataFrame(rows, "key string, at int, id int").repartition(5)
    found = {}
    for r in sorted(blocks.in_blocks(df, "key", ["at", "id"], "items", most=70).collect(), key=lambda r: r["block"]):
        assert 0 < len(r["items"]) <= 70 and r["block"] == len(found.setdefault(r["key"], []))
        assert all(len(b) == 70 for b in found[r["key"]])  # only the last one may have fewer
        found[r["key"]].append([(i["at"], i["id"]) for i in r["items"]])
    wanted = {}
    for key, at, id_ in sorted(rows, key=lambda r: r[1:]):
        wanted.setdefault(key, []).append((at, id_))
    assert {k: sum(v, []) for k, v in found.items()} == wanted


def test_gpx_keeps_heights_and_splits_long_tracks(spark):
    tracks = spark.createDataFrame([(1, "A <&> 'b'", 1000, 90_000, 12.5), (2, None, 5000, None, 0.0)], "id long, name string, started_at long, ended_at long, distance_m double")
    points = spark.createDataFrame([(1, 1000 + 500 * k, k, 50 + k / 1e4, 14.123456789, None if k % 2 else 200.456, 3.5) for k in range(25)], "track_id long, ts long, id long, lat double, lon double, altitude double, accuracy_m double")
    exact = exchange.gpx(tracks, points, exact=True, most=10)
    assert exact.where("track_id = 1").count() == 3 and exact.where("track_id = 2").count() == 1
    found, back = exchange.read_gpx(exact.withColumnRenamed("gpx", "doc"))
    assert {(r["name"], r["started_at"], r["ended_at"], r["distance_m"]) for r in found.where("track_id = 1").collect()} == {("A <&> 'b'", 1000, 90_000, 12.5)}
    same = ["track_id", "ts", "lat", "lon", "altitude", "accuracy_m"]
    assert sorted(map(repr, back.select(*same).collect())) == sorted(map(repr, points.select(*same).collect()))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        plain = exchange.gpx(tracks, points).where("track_id = 1").first()["gpx"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert '<trkpt lat="50.0000000" lon="14.1234568"><ele>200.46</ele><time>1970-01-01T00:00:01Z</time></trkpt>' in plain
    assert plain.count("<ele>") == 13 and "<metadata><name>A &lt;&amp;&gt; &apos;b&apos;</name><time>1970-01-01T00:00:01Z</time></metadata>" in plain


def test_sidecar(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"name": "n", "attribution": "a", "bbox": [14, 49, 15, 50]}')
    (tmp_path / "bad.json").write_text('{"title": "t", "bbox": [15, 49, 14, 50]}')
    assert tuple(tiles.sidecar(spark, str(tmp_path / "good.json")).first()) == ("n", "a", 14.0, 49.0, 15.0, 50.0)
    assert tuple(tiles.sidecar(spark, str(tmp_path / "bad.json")).first()) == ("t", None, None, None, None, None)


def test_insert_refuses_taken_keys(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    assert fieldlog.insert(table, spark.createDataFrame([(3, "c")], table.schema)).count() == 3
    for rows in ([(2, "x")], [(5, "x"), (5, "y")]):
        with pytest.raises(ValueError):
            fieldlog.insert(table, spark.createDataFrame(rows, table.schema))


def test_a_silent_track_is_closed_by_its_timer(spark, tmp_path):
    rows = [(1, k, 1_700_000_000_000 + 5000 * k, 50 + 15 * k / 111132, 15.0, 4.0, False) for k in range(4)]
    spark.createDataFrame(rows, recorder.FIXES).write.parquet(str(tmp_path / "in"))
    stream = recorder.record_stream(spark.readStream.schema(recorder.FIXES).parquet(str(tmp_path / "in")), silent_ms=2000)
    run = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).trigger(processingTime="1 second").start(str(tmp_path / "out"))
    try:
        until, tails = time.monotonic() + 60, []
        while not tails and time.monotonic() < until:
            time.sleep(1)
            if (tmp_path / "out").exists():
                tails = spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).where("decision = 'TAIL'").collect()
    finally:
        run.stop()
    assert len(tails) == 1 and tails[0]["vertices"] == 4 and tails[0]["v_lat"] == pytest.approx(50 + 45 / 111132) and math.isfinite(tails[0]["distance_m"])
