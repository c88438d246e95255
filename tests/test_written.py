"""What is written as files: archives by content, touched zooms, live views, framed collections."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from terravane.functions import classify
from terravane.operators import archive, tiles
from terravane.sources import exchange
from terravane.streaming import recorder, views


def test_an_archive_of_real_files(spark, tmp_path):
    rng = random.Random(1)
    wanted = {}
    rows = []
    for x in range(16):
        for y in range(16):
            data = b"sea" if (x // 8 + y // 8) % 2 else bytes(rng.randbytes(rng.randint(1, 900)))
            wanted[6, x, y] = data
            rows.append((f"6/{x}/{y}.png", data))
    rows += [("6/3/.5.png", b"x"), ("6/3/5.png.part", b"x"), ("6/3/77.png", b""), ("6/name/1.png", b"x"), ("6/3/4.jpg", b"x"), ("6/99/1.png", b"outside")]
    root, at = f"file://{tmp_path}/files", f"file://{tmp_path}/archive"
    archive.write_files(spark.createDataFrame(rows, "name string, data binary").repartition(3), root)
    found = tiles.scan_directory(spark, root)
    assert {(r["z"], r["x"], r["y"]): bytes(r["data"]) for r in found.collect()} == wanted
    archive.build(found.select("tile_id", "data"), at, segment_bytes=5_000)
    asked = found.select("tile_id", "z", "x", "y")
    missing = spark.createDataFrame([(1,), (10**9,)], "tile_id long")
    back = archive.read(spark, at, asked.select("tile_id").union(missing))
    assert {(r["z"], r["x"], r["y"]): bytes(r["data"]) for r in asked.join(back, "tile_id").collect()} == wanted
    assert back.where("data IS NULL").count() == 2
    s = archive.summary(spark, at).first()
    assert s["tiles"] == 256 and s["unique_contents"] == len(set(wanted.values())) and s["stored_bytes"] == sum(map(len, set(wanted.values())))  # once each
    assert s["entries"] < 256 and s["segments"] >= s["stored_bytes"] // 5_900
    assert spark.read.parquet(f"{at}/segments").agg(F.max(F.octet_length("data"))).first()[0] < 5_000 + 900


def test_an_empty_archive(spark, tmp_path):
    at = f"file://{tmp_path}/a"
    archive.build(spark.createDataFrame([(5, b""), (6, None)], "tile_id long, data binary"), at)
    assert archive.read(spark, at, spark.createDataFrame([(5,)], "tile_id long")).first()["data"] is None


def test_only_touched_zooms_are_written(spark, tmp_path):
    path = f"{tmp_path}/tiles"
    rows = [(z, x, y, x, 10 + y, 1) for z in (3, 4, 5) for x in range(6) for y in range(6)]
    schema = "z int, x int, y int, content int, bytes int, seq int"
    spark.createDataFrame(rows, schema).write.partitionBy("z").parquet(path)
    files = lambda z: {(f.name, f.stat().st_mtime_ns) for f in Path(path, f"z={z}").iterdir()}
    before = {z: files(z) for z in (3, 4, 5)}
    changes = [(4, 0, 0, 99, 7, 2), (4, 1, 1, 98, 7, 0), (4, 15, 15, 97, 7, 2), (4, 16, 0, 96, 7, 2), (4, 2, 2, 95, 0, 2)]  # newer, older, new, outside, without bytes
    assert tiles.upsert_zooms(path, spark.createDataFrame(changes, schema)) == [4]
    assert files(3) == before[3] and files(5) == before[5] and files(4).isdisjoint(before[4])
    wanted = {r[:3]: r[3:] for r in rows} | {(4, 0, 0): (99, 7, 2), (4, 15, 15): (97, 7, 2)}
    assert {(r["z"], r["x"], r["y"]): (r["content"], r["bytes"], r["seq"]) for r in spark.read.parquet(path).collect()} == wanted
    assert tiles.upsert_zooms(path, spark.createDataFrame([], schema)) == []
    assert tiles.upsert_zooms(path, spark.createDataFrame([(6, 1, 1, 1, 1, 1)], schema)) == [6] and files(3) == before[3]


LIST = "id long, version int, kind string, deleted boolean"


def _state(live):
    return sorted(map(tuple, live.current().collect())), sorted(map(tuple, live.totals().collect()), key=repr)


def test_a_batch_played_twice_changes_nothing(spark, tmp_path):
    rng = random.Random(2)
    live = views.LiveList(spark, f"file://{tmp_path}/live", LIST, ["id"], "version", ["kind"], parts=4)
    newest = {}
    for batch in range(6):
        rows = [(rng.randrange(40), rng.randrange(20), rng.choice(["a", "b", None]), rng.random() < 0.2) for _ in range(25)]
        df = spark.createDataFrame(rows, LIST)
        live.batch(df, batch)
        state = _state(live)
        live.batch(df, batch)
        assert _state(live) == state
        for r in rows:
            key = lambda r: (r[1], r[2] is not None, r[2] or "", r[3])
            if r[0] not in newest or key(r) > key(newest[r[0]]):
                newest[r[0]] = r
        there = sorted(r for r in newest.values() if not r[3])
        assert [r[0] for r in state[0]] == [r[0] for r in there] and state[0] == there
        totals = {}
        for r in there:
            totals[r[2]] = totals.get(r[2], 0) + 1
        assert dict(state[1]) == totals
    assert all(len(b) <= 3 for b in live.rows._tables().values())  # older tables go


def test_a_live_list_follows_a_stream(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(recorder, "BATCH_ROWS", 40)
    rows = [(k % 30, k, "ab"[k % 2], k % 7 == 0) for k in range(200)]
    live = views.LiveList(spark, f"file://{tmp_path}/live", LIST, ["id"], "version", ["kind"], parts=4)
    live.follow(recorder.replay(spark.createDataFrame(rows, LIST), "version"), f"file://{tmp_path}/log")
    newest = {r[0]: r for r in rows}
    assert _state(live)[0] == sorted(r for r in newest.values() if not r[3])
    assert max(max(b) for b in live.rows._tables().values()) >= 3  # in several batches


@pytest.mark.parametrize("n", [0, 1, 300])
def test_a_collection_is_one_document(spark, tmp_path, n):
    path = f"{tmp_path}/c"
    points = spark.range(n).select("id", exchange.point_feature(F.col("id") / 10, F.lit(15.0), F.when(F.col("id") % 2 == 0, 7.0), F.struct("id", F.lit('a "b", c\n').alias("note"))).alias("feature")).repartition(3)
    exchange.write_collection(points, path, "id")
    document = "".join(f.read_text() for f in sorted(Path(path).glob("part-*")))
    parsed = json.loads(document)
    assert parsed["type"] == "FeatureCollection" and [f["properties"]["id"] for f in parsed["features"]] == list(range(n))
    found, bad = exchange.points(spark.createDataFrame([(document,)], "doc string"))
    assert found.count() == n and bad.count() == 0
    again = exchange.points(exchange.read_collection(spark, path))[0]
    assert {(r["lat"], r["altitude"], r["properties"]["note"]) for r in again.collect()} == {(k / 10, 7.0 if k % 2 == 0 else None, 'a "b", c\n') for k in range(n)}


def test_findings_of_bodies(spark):
    cases = [
        ("arcgis-rest", "<html>", ("BAD_BODY", "NOT_JSON")), ("arcgis-rest", '{"error":{"code":1}}', ("BAD_BODY", 'SERVICE_ERROR: {"code":1}')), ("arcgis-rest", '{"name":"","mapName":"M"}', ("OK", "LAYER: M")),
        ("arcgis-rest", "[1]", ("OK", "METADATA")), ("arcgis-rest", json.dumps({"name": "n" * 90}), ("OK", "LAYER: " + "n" * 60)), ("wms", "<a>ExceptionReport</a><b>Something wrong</b>", ("BAD_BODY", "EXCEPTION: ExceptionReport")),
        ("wms", "exceptionreport", ("BAD_BODY", "EXCEPTION: ?")), ("wms", "x" * 5000 + "wms_capabilities", ("BAD_BODY", "NO_CAPABILITIES")), ("wms", "<WMT_MS_Capabilities>", ("OK", "CAPABILITIES")), ("arcgis-wmts", "none", ("BAD_BODY", "NO_CAPABILITIES")),
        ("atom", "<Feed>", ("OK", "FEED")), ("atom", "", ("BAD_BODY", "NO_FEED")), ("xyz", "GIF8", ("BAD_BODY", "NO_IMAGE")), ("else", "", ("OK", "RECEIVED")),
    ]
    df = spark.createDataFrame([(k, kind, body) for k, (kind, body, _) in enumerate(cases)], "k int, kind string, body string")
    found = {r["k"]: (r["class"], r["detail"]) for r in df.select("k", classify.body_findings(F.col("kind"), F.col("body")).alias("f")).select("k", "f.*").collect()}
    assert found == {k: c[2] for k, c in enumerate(cases)}
    assert df.where("k = 12").select(classify.body_class(F.col("kind"), F.col("body"))).first()[0] == "BAD_BODY"


def test_the_relief_is_within_one_grey(spark):
    from terravane.operators import raster

    rng = random.Random(3)
    dem = spark.createDataFrame([(r, c, rng.uniform(0, 40)) for r in range(40) for c in range(40)], "row int, col int, z double")
    for r in raster.relief(dem, block=16).collect():
        light = max(0.0, min(1.0, r["shade"] * 0.6 + r["svf"] * 0.4)) * 255
        assert abs(r["value"] - light) <= 1 and r["value"] == int(round(light, 9))
