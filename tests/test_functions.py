"""Golden values of geodesy, tiles, ids, fits and classes.

Fixed values that must equal public ones: the Earth's mean radius, tile numbers of Prague at zooms 12 and 14, its Mercator metres.
"""

import math

import pytest
from pyspark.sql import functions as F

from terravane.functions import affine, classify, geo, hilbert
from terravane.operators import calibration, layers, raster, tiles


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_distance_and_bearing(spark):
    assert value(spark, geo.distance_m(50.0755, 14.4378, 49.1951, 16.6068)) == pytest.approx(184_000, abs=2_000)
    assert value(spark, geo.distance_m(50.0, 14.0, 50.0, 14.0)) == 0
    assert value(spark, geo.bearing_deg(50.0, 14.0, 51.0, 14.0)) == pytest.approx(0, abs=1e-9)
    assert value(spark, geo.bearing_deg(50.0, 14.0, 50.0, 15.0)) == pytest.approx(90, abs=0.5)
    labels = [value(spark, geo.compass_label(F.lit(float(b)))) for b in (0, 45, 180, 359, -45)]
    assert labels == ["S", "SV", "J", "S", "SZ"]


def test_mercator_and_tiles(spark):
    m = value(spark, geo.to_mercator(50.0870, 14.4205))
    assert m["x"] == pytest.approx(1605282.7, abs=1) and m["y"] == pytest.approx(6461356.4, abs=1)
    assert value(spark, F.struct(geo.tile_x(14.4205, 14).alias("x"), geo.tile_y(50.0870, 14).alias("y"))) == (8848, 5550)
    assert value(spark, F.struct(geo.tile_x(14.4378, 12).alias("x"), geo.tile_y(50.0755, 12).alias("y"))) == (2212, 1387)
    back = value(spark, geo.from_mercator(F.lit(m["x"]), F.lit(m["y"])))
    assert back["lat"] == pytest.approx(50.0870) and back["lon"] == pytest.approx(14.4205)


def test_area_and_sun(spark):
    d_lat, d_lon = 100 / 111_229.0, 100 / (111_412.84 * math.cos(math.radians(50)))
    ring = F.array(*[F.struct(F.lit(50 + a * d_lat).alias("lat"), F.lit(14 + b * d_lon).alias("lon")) for a, b in ((0, 0), (0, 1), (1, 1), (1, 0))])
    assert value(spark, geo.ring_area_ha(ring)) == pytest.approx(1, abs=0.05)
    assert value(spark, geo.ring_area_ha(F.slice(ring, 1, 2))) == 0
    sun = value(spark, geo.sun_times(50.08, 14.42, 20625))
    assert 15 <= (sun["set"] - sun["rise"]) / 3_600_000 <= 17.5
    assert value(spark, geo.sun_times(89.0, 0.0, 20800)) is None


def test_hilbert_is_a_dense_bijection(spark):
    assert [value(spark, hilbert.tile_id(F.lit(z), F.lit(x), F.lit(y))) for z, x, y in ((0, 0, 0), (1, 0, 0), (1, 0, 1), (1, 1, 1), (1, 1, 0), (2, 0, 0))] == [0, 1, 2, 3, 4, 5]
    assert value(spark, hilbert.tile_id(F.lit(2), F.lit(4), F.lit(0))) is None
    grid = spark.range(64).select(F.lit(3).alias("z"), (F.col("id") % 8).cast("int").alias("x"), F.floor(F.col("id") / 8).cast("int").alias("y"))
    rows = tiles.with_ids(grid).withColumn("b", hilbert.zxy(F.col("tile_id"))).collect()
    assert sorted(r["tile_id"] for r in rows) == list(range(21, 85))
    assert all((r["b"]["z"], r["b"]["x"], r["b"]["y"]) == (3, r["x"], r["y"]) for r in rows)
    path = sorted((r["tile_id"], r["x"], r["y"]) for r in rows)
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(path, path[1:]))


def test_zooms():
    assert tiles.zoom_list("12-16") == tiles.zoom_list("16-12") == [12, 13, 14, 15, 16]
    assert tiles.zoom_list("14") == [14] and tiles.zoom_list("10,14,12") == [10, 12, 14]
    for bad in ("30", ""):
        with pytest.raises(ValueError):
            tiles.zoom_list(bad)


def _points(spark, pairs):
    return spark.createDataFrame([(1, k, *map(float, p)) for k, p in enumerate(pairs)], "set_id int, id int, src_x double, src_y double, dst_x double, dst_y double")


def test_fits(spark):
    a, b, tx, c, d, ty = 1.03, -0.07, 250.0, 0.05, 0.98, -410.0
    move = lambda x, y: (x, y, a * x + b * y + tx, c * x + d * y + ty)
    points = _points(spark, [move(*p) for p in ((0, 0), (1000, 0), (0, 1000), (700, 900))])
    found = calibration.fit(points, "affine").first()["transform"]
    assert list(found) == pytest.approx([a, b, tx, c, d, ty])
    assert calibration.rmse(points, calibration.fit(points)).first()["rmse"] < 1e-4
    line = _points(spark, [move(k, 2 * k) for k in range(4)])
    assert calibration.fit(line, "affine").first()["transform"] is None
    assert calibration.fit(line, "best").first()["transform"] is not None
    shifts = _points(spark, [(0, 0, 10, 0), (5, 5, 25, 9)])
    t = calibration.fit(shifts, "translation").first()["transform"]
    assert (t["tx"], t["ty"]) == (15, 2)
    turn = lambda x, y: (x, y, 1.4 * (x * math.cos(0.25) - y * math.sin(0.25)) + 3, 1.4 * (x * math.sin(0.25) + y * math.cos(0.25)) - 4)
    s = calibration.fit(_points(spark, [turn(0, 0), turn(100, 50)]), "similarity").first()["transform"]
    assert s["a"] == pytest.approx(s["d"]) and s["b"] == pytest.approx(-s["c"]) and s["a"] == pytest.approx(1.4 * math.cos(0.25))


def test_inverse_and_identity(spark):
    m = affine.transform(1.2, 0.1, 5.0, -0.2, 0.9, 7.0)
    assert value(spark, affine.is_identity(affine.concat(m, affine.inverse(m)), 1e-9))
    assert value(spark, affine.inverse(affine.transform(1.0, 2.0, 0.0, 2.0, 4.0, 0.0))) is None
    assert value(spark, affine.negligible(affine.identity(), F.lit(14)))


def test_presets_and_soil(spark):
    presets = spark.createDataFrame([(1, "PLAZ", "SUCHO"), (2, "PLAZ", "MOKRO"), (3, "LES", "SUCHO"), (4, "LES", "MOKRO")], "position int, terrain string, soil string")
    ranked = layers.rank_presets(presets, "LES", "MOKRO").collect()
    assert [(r["position"], r["score"]) for r in ranked] == [(4, 3), (3, 2), (2, 1), (1, 0)]
    assert "neznáme" in layers.rank_presets(presets, "LES", None).first()["reason"]
    now, day = 1700000000, 86400
    hours = spark.createDataFrame([(1, now - 4 * day, 0.10, 100.0), (1, now - 7200, 0.30, 1.0), (1, now - 3600, None, 2.0), (1, now + 3600, 0.50, 9.0), (2, now + 3600, 0.5, 9.0)], "place int, time long, moisture double, rain double")
    rows = layers.soil_readings(hours, now).collect()
    assert [tuple(r) for r in rows] == [(1, 0.30, 3.0, "VLHKO")]
    assert value(spark, classify.soil_estimate(F.lit(float("nan")), F.lit(20.0))) == "MOKRO"


def test_raster_golden_cases(spark):
    def dem(z):
        return spark.createDataFrame([(r, c, float(z(r, c))) for r in range(24) for c in range(24)], "row int, col int, z double")

    flat = raster.relief(dem(lambda r, c: 5), block=16)
    assert flat.select("shade").distinct().count() == 1 and flat.select("svf").distinct().first()[0] == 1
    ramp = raster.slope_aspect(dem(lambda r, c: 2 * c), block=16)
    assert ramp.agg(F.max("slope") - F.min("slope")).first()[0] == pytest.approx(0) and ramp.first()["slope"] == pytest.approx(math.atan(2))
    pit = raster.sky_view(dem(lambda r, c: -5 if (r, c) == (12, 12) else 0), block=16)
    low = pit.orderBy("svf").first()
    assert (low["row"], low["col"]) == (12, 12) and low["svf"] < 0.5
    both = raster.relief(dem(lambda r, c: (r * 7 + c * 3) % 11), block=16).select("row", "col", "svf")
    apart = raster.sky_view(dem(lambda r, c: (r * 7 + c * 3) % 11), block=16)
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, apart.collect()))


def test_lights_and_greys(spark):
    up, east = raster.lights([90.0], 90.0), raster.lights([90.0], 0.0)
    assert value(spark, raster.hillshade(F.lit(0.0), F.lit(0.0), up)) == pytest.approx(1) and value(spark, raster.hillshade(F.lit(0.0), F.lit(0.0), east)) == pytest.approx(0)
    # a slope that faces the light is bright, one that faces away is dark; weights are shares
    faces, away = (value(spark, raster.hillshade(F.lit(0.7), F.lit(a), raster.lights([90.0]))) for a in (0.0, math.pi))
    assert faces > 0.9 and away < 0.1
    mixed = value(spark, raster.hillshade(F.lit(0.7), F.lit(0.0), raster.lights({90.0: 3.0, 270.0: 1.0})))
    assert mixed == pytest.approx((3 * faces + away) / 4)
    with pytest.raises(ValueError):
        raster.lights({90.0: 0.0})
    greys = [value(spark, raster.grey(F.lit(s), F.lit(v) if v is not None else None, w, g)) for s, v, w, g in ((0.5, None, 0.4, 1.0), (0.5, 1.0, 0.5, 1.0), (0.5, 1.0, 7.0, 1.0), (0.5, 1.0, -1.0, 1.0), (0.25, None, 0.4, 2.0), (2.0, None, 0.4, 1.0), (-1.0, None, 0.4, 1.0))]
    assert greys == [127, 191, 255, 127, 127, 255, 0]


def test_the_area_of_a_small_ring_is_exact(spark):
    # a side of 2^-10 degrees: differences of coordinates are exact, products of whole coordinates are not
    side, lat, lon = 2.0**-10, 51.1234, 18.4321
    corners = [(lat, lon), (lat, lon + side), (lat + side, lon + side), (lat + side, lon)]
    ring = F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in corners])
    m = math.radians(sum(a for a, _ in corners) / 4)
    wanted = ((lon + side) - lon) * ((lat + side) - lat) * (111_132.92 - 559.82 * math.cos(2 * m)) * (111_412.84 * math.cos(m)) / 10_000
    assert value(spark, geo.ring_area_ha(ring)) == pytest.approx(wanted, rel=1e-13)


def test_accuracy_circles_are_spread_and_summed_once(spark):
    from terravane.plans import registry

    rows = spark.createDataFrame([(50.0 + k * 0.37, 14.0 + k, None if k == 3 else 0.5 + 7.3 * k) for k in range(12)], "lat double, lon double, r double")
    lat, lon = F.col("lat"), F.col("lon")
    ring = geo.accuracy_circle(lat, lon, F.col("r"))
    plain = F.aggregate(ring, F.lit(0.0), lambda s, p: s + geo.distance_m(lat, lon, p["lat"], p["lon"]))
    found = rows.select(plain.alias("a"), geo.ring_distances_m(ring, lat, lon, F.cos(F.radians(lat))).alias("b"), F.size(ring).alias("n")).collect()
    assert [r["a"] for r in found] == [r["b"] for r in found] and {r["n"] for r in found if r["a"] is not None} == {49}
    # one small file is one task; the circles go to all
    query = registry.QUERIES["e31_accuracy_circles"](spark, "/root/testdata/sf0.001")
    assert query.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
