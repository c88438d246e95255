"""Spatial joins, tracks, tiles and exchange against golden cases and brute force.

Fixed values that must equal public ones: 111,132 m to a degree of latitude, and the recorder's bounds (accuracy 50 m, speed 15 m/s,
idle 10 m and 60 s, steps 3 m and 10 m) in the scenarios.
"""

import math
import random

import pytest
from pyspark.sql import functions as F

from terravane.operators import spatial, tiles, tracks
from terravane.sources import exchange
from terravane.streaming import recorder

POLYGONS = "poly_id long, poly_ord long, rings array<array<struct<lat:double,lon:double>>>, properties map<string,string>"


def square(south, west, side):
    return [(south, west), (south, west + side), (south + side, west + side), (south + side, west)]


def polygons(spark, *rings):
    return spark.createDataFrame([(k, k, r, {"name": str(k)}) for k, r in enumerate(rings)], POLYGONS)


def points(spark, *where):
    return spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(where)], "point_id long, lat double, lon double")


def test_holes_and_overlaps(spark):
    holed = polygons(spark, [square(49.0, 15.0, 1.0), square(49.4, 15.4, 0.2)])
    assert [r["point_id"] for r in spatial.point_in_polygon(points(spark, (49.2, 15.2), (49.5, 15.5), (48.0, 15.5)), holed).collect()] == [0]
    both = polygons(spark, [square(49.0, 15.0, 1.0)], [square(49.4, 15.4, 0.2)])
    assert spatial.property_of_polygon(points(spark, (49.5, 15.5)), both, "name").first()["value"] == "0"


def test_nearest(spark):
    one = polygons(spark, [square(49.0, 15.0, 1.0)])
    outside, inside = points(spark, (48.99, 15.5)), points(spark, (49.5, 15.5))
    assert spatial.nearest_polygon(outside, one, 2000.0).first()["distance_m"] == pytest.approx(1111, abs=30)
    assert spatial.nearest_polygon(outside, one, 120.0).isEmpty()
    assert spatial.nearest_polygon(inside, one, 120.0).first()["distance_m"] == 0


def _inside(ring, lat, lon):
    found = False
    for k in range(len(ring)):
        (a, b), (c, d) = ring[k], ring[k - 1]
        if (b > lon) != (d > lon) and lat < a + (c - a) / (d - b) * (lon - b):
            found = not found
    return found


def test_grid_join_is_brute_force(spark):
    rng = random.Random(5)
    rings = [[square(49.007 + 0.05 * j, 15.007 + 0.05 * i, 0.012)] for i in range(10) for j in range(10)]
    where = [(49 + rng.random() * 0.5, 15 + rng.random() * 0.5) for _ in range(600)]
    wanted = {k: next((p for p, r in enumerate(rings) if _inside(r[0], *w)), None) for k, w in enumerate(where)}
    found = {r["point_id"]: r["poly_id"] for r in spatial.point_in_polygon(points(spark, *where), polygons(spark, *rings)).collect()}
    assert found == {k: p for k, p in wanted.items() if p is not None} and found


def test_radius(spark):
    here = points(spark, (50.5123, 16.0116), (51.0, 15.0))
    others = spark.createDataFrame([(k, 50.5123 + a, 16.0116 + b, 0) for k, (a, b) in enumerate([(0.0, 0.0), (0.0009, 0.0), (0.00126, 0.00198), (0.01, 0.0)])], "other_id long, o_lat double, o_lon double, o_created_at long")
    assert {r["point_id"]: r["n"] for r in spatial.within_radius(here, others).collect()} == {0: 2, 1: 0}


START = 1700000000000


def fix(k, metres, seconds, accuracy=5.0):
    return (1, k, START + int(seconds * 1000), 50 + metres / 111132, 15.0, accuracy)


def decisions(spark, rows):
    df = spark.createDataFrame(rows, "track_id long, arrival long, ts long, lat double, lon double, accuracy_m double")
    return tracks.record(df).orderBy(F.col("arrival").asc_nulls_last()).collect()


def test_recorder_scenarios(spark):
    assert [r["decision"] for r in decisions(spark, [fix(0, 0, 0, 80.0), fix(1, 0, 1, None)])] == ["ACCURACY", "ACCEPTED"]
    assert [r["decision"] for r in decisions(spark, [fix(0, 0, 0), fix(1, 2000, 1), fix(2, 0, -1)])] == ["ACCEPTED", "JUMP", "OUT_OF_ORDER"]
    walk = [r for r in decisions(spark, [fix(k, 5 * k, k) for k in range(21)]) if r["decision"] != "TAIL"]
    assert all(r["decision"] == "ACCEPTED" for r in walk) and walk[-1]["vertices"] == 10 and walk[-1]["distance_m"] == pytest.approx(100, abs=1)
    stand = decisions(spark, [fix(k, 0, k) for k in range(62)] + [fix(62, 17, 63)])
    assert stand[61]["idle"] and not stand[62]["idle"]
    wander = [r for r in decisions(spark, [fix(k, m, 30 * k) for k, m in enumerate([0, 2, 5, 1, 7, 3, 6, 2, 4])]) if r["decision"] != "TAIL"]
    assert wander[-1]["vertices"] == 1
    assert [r["v_ts"] is not None for r in decisions(spark, [fix(0, 0, 0), fix(1, 15, 5), fix(2, 30, 10)])][:3] == [True, False, True]
    spike = [r for r in decisions(spark, [fix(0, 0, 0), fix(1, 40, 5), fix(2, 2, 10)]) if r["decision"] != "TAIL"]
    assert spike[-1]["vertices"] == 1
    assert decisions(spark, [fix(0, 0, 0), fix(1, 15, 5)])[-1]["decision"] == "TAIL"


def test_stream_is_the_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for track in (1, 2):
        at = 0.0
        for k in range(60):
            at += rng.choice([0, 3, 8, 15, 400])
            rows.append((track, k, START + 5000 * (k - rng.choice([0, 0, 0, 2])), 50 + at / 111132, 15.0, rng.choice([4.0, 20.0, 70.0]), False))
    df = spark.createDataFrame(rows, recorder.FIXES)
    df.write.parquet(str(tmp_path / "in"))
    stream = recorder.record_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), close_silent=False)
    key = ["track_id", "arrival", "decision", "vertices", "v_ts"]
    live = recorder.drain(stream, "live_fixes").select(*key)
    batch = tracks.record(df).where("decision <> 'TAIL'").select(*key)
    assert sorted(map(tuple, live.collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)


def test_runs_across_ranges(spark):
    ids = spark.range(0, 200_000).select(F.col("id").alias("tile_id"), F.lit(7).alias("content"))
    assert [tuple(r) for r in tiles.runs(ids).collect()] == [(0, 7, 200_000)]
    found = tiles.lookup(spark.createDataFrame([(150_000,), (300_000,)], "tile_id long"), tiles.runs(ids)).collect()
    assert {r["tile_id"]: r["content"] for r in found} == {150_000: 7, 300_000: None}


def test_scan_directory(spark, tmp_path):
    for name, data in (("3/1/2.png", b"x"), ("3/1/3.png", b""), ("3/a/2.png", b"x"), ("3/1/4.png.part", b"x"), ("3/9/2.png", b"x")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    assert [(r["z"], r["x"], r["y"]) for r in tiles.scan_directory(spark, str(tmp_path)).collect()] == [(3, 1, 2)]


def test_geojson(spark):
    ring = "[[15,49],[16,49],[16,50],[15,50],[15,49]]"
    docs = spark.createDataFrame(
        [
            (1, '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"n":5},"geometry":{"type":"MultiPolygon","coordinates":[[%s],[%s]]}}]}' % (ring, ring)),
            (2, '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{},"geometry":{"type":"Polygon","coordinates":[[[1,2],[3,4]]]}}]}'),
            (3, "not json"),
        ],
        "id int, doc string",
    )
    rows = exchange.polygons(docs).collect()
    assert [(r["id"], r["properties"]["n"], r["west"], r["north"]) for r in rows] == [(1, "5", 15.0, 50.0)] * 2


def test_feed_and_control_points(spark):
    feed = '<feed><entry><title>T</title><link href="http://x/a.LAZ" type="application/zip"/><link href="http://x/sub" type="application/atom+xml"/><georss:box xmlns:georss="g">49.3 14.6 49.5 14.9</georss:box></entry></feed>'
    rows = exchange.feed_entries(spark.createDataFrame([(feed,)], "doc string")).collect()
    assert sorted(r["kind"] for r in rows) == ["feed", "file"]
    assert (rows[0]["west"], rows[0]["south"], rows[0]["east"], rows[0]["north"]) == (14.6, 49.3, 14.9, 49.5)
    good = ("a.jpg", 100, 100, [(1.0, 1.0, 15.0, 50.0)] * 3)
    bad = ("a.jpg", 0, 100, [(1.0, 1.0, 200.0, 50.0)] * 2)
    codes = [r["errors"] for r in exchange.validate_control(spark.createDataFrame([good, bad], exchange.CONTROL)).collect()]
    assert codes[0] == [] and {"BAD_SIZE", "FEW_POINTS", "BAD_LONLAT"} <= set(codes[1])


def test_metres_is_haversine():
    assert tracks.metres((0, 50.0, 14.0, None), (0, 50.0, 14.0, None)) == 0
    assert tracks.metres((0, 0.0, 0.0, None), (0, 0.0, 180.0, None)) == pytest.approx(math.pi * 6371008.8)


def test_boxes_at_and_counts_are_brute_force(spark):
    rng = random.Random(9)
    where = [(rng.choice([50 + rng.random(), round(50 + rng.random(), 2)]), rng.choice([14 + rng.random() * 2, round(14 + rng.random() * 2, 2)])) for _ in range(800)]
    boxes = []
    for k in range(60):
        south, west = round(50 + rng.random(), 2), round(14 + rng.random() * 2, 2)
        boxes.append((k, f"l{k % 2}", west, south, west + rng.choice([0.0, 0.01, 0.3, 2.0]), south + rng.choice([0.0, 0.02, 0.4, 3.0])))
    df = spark.createDataFrame(boxes, "box_id long, layer_id string, west double, south double, east double, north double")
    rows = spark.createDataFrame([(k, f"l{k % 3}", *map(float, p)) for k, p in enumerate(where)], "point_id long, layer_id string, lat double, lon double")
    holds = lambda b, p: b[3] <= p[0] <= b[5] and b[2] <= p[1] <= b[4]
    counts = {r["box_id"]: r["holds"] for r in spatial.count_in_boxes(rows, df).collect()}
    assert counts == {b[0]: sum(holds(b, p) for p in where) for b in boxes}
    pairs = {(r["point_id"], r["box_id"]) for r in spatial.boxes_at(rows, df, "layer_id").collect()}
    assert pairs == {(k, b[0]) for k, p in enumerate(where) for b in boxes if f"l{k % 3}" == b[1] and holds(b, p)}


def test_runs_merge_in_levels(spark, monkeypatch):
    monkeypatch.setattr(tiles, "RANGE", 4)
    monkeypatch.setattr(tiles, "LEVEL", 3)
    rng = random.Random(10)
    ids = sorted(rng.sample(range(100), 85))
    content = {k: (k // 17) % 3 for k in ids}
    wanted = []
    for k in ids:
        if wanted and wanted[-1][0] + wanted[-1][2] == k and wanted[-1][1] == content[k]:
            wanted[-1][2] += 1
        else:
            wanted.append([k, content[k], 1])
    found = tiles.runs(spark.createDataFrame([(k, content[k]) for k in ids], "tile_id long, content int")).collect()
    assert sorted(map(list, found)) == wanted


def test_an_external_id_of_several_parents_moves_a_child_once(spark):
    from terravane.operators import fieldlog

    parents = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, external_id string")
    resolved = spark.createDataFrame([(102, "a"), (101, "a"), (103, "b")], "id long, external_id string")
    children = spark.createDataFrame([(10, 1), (20, 2), (30, 3)], "photo long, find_id long")
    assert sorted(map(tuple, fieldlog.reparent(children, parents, resolved, "find_id").select("photo", "find_id").collect())) == [(10, 101), (20, 101), (30, 103)]


def test_places_equally_far_go_by_id(spark):
    from terravane.operators import fieldlog

    # the same way to the west and to the east: distances that differ in their last bits only
    pairs = [(2 * k + side, 50.0 + k * 0.0137, 15.0 + (-1 if (side + k) % 2 else 1) * (0.1 + k * 0.0317)) for k in range(40) for side in (0, 1)]
    found = spark.createDataFrame(pairs, "id long, lat double, lon double").orderBy(*fieldlog.of_places("nearest", 50.0, 15.0))
    assert [r["id"] for r in found.collect()] == sorted(p[0] for p in pairs)


def test_ranked_calibrations_are_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spatial, "PAIRS", 50)
    rng = random.Random(11)
    points = [(k, f"l{k % 3}", round(50 + rng.random(), 2), round(14 + rng.random() * 2, 2)) for k in range(200)]
    boxes = []
    for k in range(120):
        south, west = round(50 + rng.random(), 2), round(14 + rng.random() * 2, 2)
        boxes.append((k, f"l{k % 2}", west, south, west + rng.choice([-0.1, 0.0, 0.01, 0.3, 2.0]), south + rng.choice([0.0, 0.02, 0.4, 3.0]), k % 7 != 0))
    df = spark.createDataFrame(boxes, "id long, layer_id string, west double, south double, east double, north double, active boolean")
    rows = spark.createDataFrame(points, "point_id long, layer_id string, lat double, lon double")
    wanted = set()
    for p in points:
        held = sorted(((b[4] - b[2]) * (b[5] - b[3]), b[0]) for b in boxes if b[6] and b[1] == p[1] and b[3] <= p[2] <= b[5] and b[2] <= p[3] <= b[4])
        wanted |= {(p[0], k, n + 1) for n, (_, k) in enumerate(held)}
    whole = spatial.ranked_calibrations(rows, df)
    assert set(map(tuple, whole.collect())) == wanted and whole.count() == len(wanted)
    # no sort of pairs
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "row_number" not in plan
    # cells of several blocks
    monkeypatch.setattr(spatial, "BLOCK", 3)
    assert sorted(map(tuple, spatial.ranked_calibrations(rows, df).collect())) == sorted(wanted)


def test_overlapping_calibrations_are_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spatial, "PAIRS", 50)
    monkeypatch.setattr(spatial, "BLOCK", 7)
    rng = random.Random(12)
    corner = lambda: (round(14 + rng.random() * 2, 2), round(50 + rng.random(), 2))
    box = lambda: (lambda w, s: (w, s, w + rng.choice([-0.02, 0.0, 0.01, 0.3, 5.0]), s + rng.choice([0.0, 0.02, 0.4, 3.0])))(*corner())
    views, boxes = [(k, f"l{k % 3}", *box()) for k in range(150)], [(k, f"l{k % 2}", *box(), k % 7 != 0) for k in range(120)]
    v = spark.createDataFrame(views, "view_id long, layer_id string, v_west double, v_south double, v_east double, v_north double")
    c = spark.createDataFrame(boxes, "id long, layer_id string, west double, south double, east double, north double, active boolean")
    wanted = [(a[0], b[0]) for a in views for b in boxes if b[6] and a[1] == b[1] and b[2] <= a[4] and a[2] <= b[4] and b[3] <= a[5] and a[3] <= b[5]]
    found = spatial.overlapping_calibrations(v, c)
    assert sorted((r["view_id"], r["id"]) for r in found.collect()) == sorted(wanted)
    # a viewport is one row of a level, not one for each cell that it touches
    assert "sequence(FLOOR((v_west" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_counts_in_boxes_meet_no_pairs(spark):
    rng = random.Random(13)
    zero = [(0.0, -0.0), (-0.0, 0.0), (None, 1.0), (1.0, None)]
    points = zero + [(round(rng.random(), 1), round(rng.random(), 1)) for _ in range(70)] + [(rng.random(), rng.random()) for _ in range(70)]
    boxes = [(0, 0.0, 0.0, 0.0, 0.0), (1, -0.0, -0.0, 9.0, 9.0), (2, None, 0.0, 1.0, 1.0), (3, 0.5, 0.5, 0.4, 0.9)]
    boxes += [(k, *sorted((round(rng.random(), 1), rng.random()))[:1], round(rng.random(), 1), round(1 + rng.random(), 1), round(rng.random() * 1.2, 1)) for k in range(4, 60)]
    rows, df = spark.createDataFrame(points, "lat double, lon double"), spark.createDataFrame(boxes, "box_id long, west double, south double, east double, north double")
    holds = lambda b, p: None not in (*b, *p) and b[2] <= p[0] <= b[4] and b[1] <= p[1] <= b[3]
    for few in (points, points[:1], points[2:3], points[: len(zero) + 4]):
        found = spatial.count_in_boxes(spark.createDataFrame(few, "lat double, lon double"), df)
        assert {r["box_id"]: r["holds"] for r in found.collect()} == {b[0]: sum(holds(b, p) for p in few) for b in boxes}
    # the only join is that of the counts with the boxes
    plan = spatial.count_in_boxes(rows, df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
