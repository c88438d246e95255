"""Queries of spatial joins, geodesy and tile functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from terravane.functions import affine, classify, geo, hilbert
from terravane.operators import spatial, tiles
from terravane.plans.helpers import SQL_INSIDE, milli, polygons, query, sql_distance, sql_milli


def _points(finds):
    return finds.select(F.col("id").alias("point_id"), "lat", "lon")


@query("j6_point_in_polygon", f"WITH {SQL_INSIDE} SELECT point_id, min(poly_id) AS poly_id FROM inside GROUP BY 1", "finds", "areas")
def _(t):
    return spatial.point_in_polygon(_points(t("finds")), polygons(t("areas")))


@query(
    "j8_finds_by_area",
    f"WITH {SQL_INSIDE}, first AS (SELECT point_id, min(poly_id) AS poly_id FROM inside GROUP BY 1) SELECT uan, CASE WHEN category = 'NEZNAMA' THEN 'OSTATNI' ELSE category END AS category, count(*) AS n, max(depth_cm) AS deepest_cm FROM first JOIN areas ON areas.id = poly_id JOIN finds ON finds.id = point_id GROUP BY 1, 2",
    "finds", "areas",
)
def _(t):
    finds = t("finds")
    points = finds.select(F.col("id").alias("point_id"), "lat", "lon", "category", "depth_cm")
    inside = spatial.property_of_polygon(points, polygons(t("areas")), "uan", ["category", "depth_cm"])
    return inside.groupBy(F.col("value").alias("uan"), classify.decode(F.col("category"), classify.FIND_CATEGORIES, "OSTATNI").alias("category")).agg(F.count("*").alias("n"), F.max("depth_cm").alias("deepest_cm"))


_SEGMENT = "greatest(0.0e0, least(1.0e0, ((f.lon*k - e.alon*k)*((e.blon-e.alon)*k) + (f.lat*111132.0e0 - e.alat*111132.0e0)*((e.blat-e.alat)*111132.0e0)) / (((e.blon-e.alon)*k)*((e.blon-e.alon)*k) + ((e.blat-e.alat)*111132.0e0)*((e.blat-e.alat)*111132.0e0))))"


@query(
    "j7_nearest_area",
    f"""WITH {SQL_INSIDE}, f AS (SELECT *, 111320.0e0 * cos(radians(lat)) AS k FROM finds),
near AS (SELECT f.id AS point_id, e.id AS poly_id, f.lat, f.lon, f.k, e.alat, e.alon, e.blat, e.blon, {_SEGMENT} AS t FROM f JOIN edges e ON abs(f.lat - e.alat) < 0.35 AND abs(f.lon - e.alon) < 0.5),
d AS (SELECT point_id, poly_id, min(sqrt(pow(lon*k - (alon*k + t*(blon-alon)*k), 2) + pow(lat*111132.0e0 - (alat*111132.0e0 + t*(blat-alat)*111132.0e0), 2))) AS d FROM near GROUP BY 1, 2),
d0 AS (SELECT point_id, poly_id, CASE WHEN inside.point_id IS NULL THEN d ELSE 0.0e0 END AS d FROM d LEFT JOIN inside USING (point_id, poly_id)),
best AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, poly_id) AS rn FROM d0 WHERE d <= 900)
SELECT point_id, poly_id, {sql_milli('d')} AS distance_mm FROM best WHERE rn = 1""",
    "finds", "areas",
)
def _(t):
    near = spatial.nearest_polygon(_points(t("finds")), polygons(t("areas")), 900.0)
    return near.select("point_id", "poly_id", milli("distance_m").alias("distance_mm"))


_NEAR = f"b.lat BETWEEN a.lat - 150.0e0/111320.0e0 AND a.lat + 150.0e0/111320.0e0 AND b.lon BETWEEN a.lon - 150.0e0/(111320.0e0*cos(radians(a.lat))) AND a.lon + 150.0e0/(111320.0e0*cos(radians(a.lat))) AND {sql_distance('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 150"


def _others(df):
    return df.select(F.col("id").alias("other_id"), F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"), F.col("created_at").alias("o_created_at"))


@query("j14_finds_near_places", f"SELECT a.id AS point_id, count(b.id) AS n FROM places a LEFT JOIN finds b ON {_NEAR} GROUP BY 1", "places", "finds")
def _(t):
    return spatial.within_radius(_points(t("places")), _others(t("finds")))


@query("w9_nth_find_at_spot", f"SELECT a.id AS point_id, count(b.id) + 1 AS nth FROM finds a LEFT JOIN finds b ON {_NEAR} AND (b.created_at < a.created_at OR (b.created_at = a.created_at AND b.id < a.id)) GROUP BY 1", "finds")
def _(t):
    finds = t("finds")
    earlier = (F.col("o_created_at") < F.col("created_at")) | ((F.col("o_created_at") == F.col("created_at")) & (F.col("other_id") < F.col("point_id")))
    points = finds.select(F.col("id").alias("point_id"), "lat", "lon", "created_at")
    return spatial.within_radius(points, _others(finds), also=earlier).select("point_id", (F.col("n") + 1).alias("nth"))


_HOLDS = "c.layer_id = f.layer_context_id AND c.active AND f.lat BETWEEN c.south AND c.north AND f.lon BETWEEN c.west AND c.east"


def _layered(finds):
    return finds.select(F.col("id").alias("point_id"), F.col("layer_context_id").alias("layer_id"), "lat", "lon")


@query(
    "j9_best_calibration",
    f"""WITH r AS (SELECT f.id AS point_id, c.id AS cid, c.tx, c.a, row_number() OVER (PARTITION BY f.id ORDER BY (c.east-c.west)*(c.north-c.south), c.updated_at DESC, c.id) AS rn FROM finds f JOIN calibrations c ON {_HOLDS})
SELECT f.id AS point_id, r.cid AS calibration_id, coalesce(r.tx, 0.0e0) AS tx, coalesce(r.a, 1.0e0) AS a FROM finds f LEFT JOIN r ON r.point_id = f.id AND rn = 1""",
    "finds", "calibrations",
)
def _(t):
    matrix = F.struct("a", "b", "tx", "c", "d", "ty")
    best = spatial.best_calibration(_layered(t("finds")), t("calibrations"), matrix)
    return best.select("point_id", "calibration_id", F.col("transform.tx").alias("tx"), F.col("transform.a").alias("a"))


@query("j10_containing_calibrations", f"SELECT f.id AS point_id, c.id AS calibration_id, row_number() OVER (PARTITION BY f.id ORDER BY (c.east-c.west)*(c.north-c.south), c.id) AS tightness FROM finds f JOIN calibrations c ON {_HOLDS}", "finds", "calibrations")
def _(t):
    found = spatial.ranked_calibrations(_layered(t("finds")), t("calibrations"))
    return found.select("point_id", F.col("id").alias("calibration_id"), "tightness")


@query(
    "j11_calibrations_in_viewports",
    "SELECT p.id AS view_id, c.id AS calibration_id FROM places p JOIN calibrations c ON c.layer_id = concat('layer', CAST(p.id % 25 AS VARCHAR)) AND c.active AND c.west <= p.lon + 0.2e0 AND p.lon - 0.2e0 <= c.east AND c.south <= p.lat + 0.1e0 AND p.lat - 0.1e0 <= c.north",
    "places", "calibrations",
)
def _(t):
    views = t("places").select(F.col("id").alias("view_id"), F.concat(F.lit("layer"), (F.col("id") % 25).cast("string")).alias("layer_id"), (F.col("lon") - 0.2).alias("v_west"), (F.col("lat") - 0.1).alias("v_south"), (F.col("lon") + 0.2).alias("v_east"), (F.col("lat") + 0.1).alias("v_north"))
    return spatial.overlapping_calibrations(views, t("calibrations")).select("view_id", F.col("id").alias("calibration_id"))


@query(
    "j22_preflight_calibrations",
    "WITH l AS (SELECT DISTINCT layer_id FROM calibrations), r AS (SELECT l.layer_id, p.id AS place_id, c.id AS calibration_id, row_number() OVER (PARTITION BY l.layer_id, p.id ORDER BY (c.east-c.west)*(c.north-c.south), c.updated_at DESC, c.id) AS rn FROM l JOIN places p ON true JOIN calibrations c ON c.layer_id = l.layer_id AND c.active AND p.lat BETWEEN c.south AND c.north AND p.lon BETWEEN c.west AND c.east) SELECT layer_id, place_id, calibration_id FROM r WHERE rn = 1",
    "places", "calibrations",
)
def _(t):
    return spatial.preflight(t("places").select(F.col("id").alias("place_id"), "lat", "lon"), t("calibrations"))


_PRAGUE = ("50.0755e0", "14.4378e0")


@query(
    "e1_navigation_hints",
    f"""WITH p AS (SELECT id, lat, lon, radians(lat) AS p1, radians(50.0755e0) AS p2, radians(14.4378e0 - lon) AS dl FROM places),
b AS (SELECT id, {sql_distance('lat', 'lon', *_PRAGUE)} AS d, (degrees(atan2(sin(dl)*cos(p2), cos(p1)*sin(p2)-sin(p1)*cos(p2)*cos(dl))) + 360.0e0) % 360.0e0 AS bearing FROM p)
SELECT id, {sql_milli('d')} AS distance_mm, {sql_milli('bearing')} AS bearing_mdeg, ['S','SV','V','JV','J','JZ','Z','SZ'][CAST(floor(bearing / 45.0e0 + 0.5e0) AS BIGINT) % 8 + 1] AS label FROM b""",
    "places",
)
def _(t):
    hint = geo.navigation_hint(F.col("lat"), F.col("lon"), 50.0755, 14.4378)
    return t("places").select("id", hint.alias("h")).select("id", milli("h.distance_m").alias("distance_mm"), milli("h.bearing").alias("bearing_mdeg"), "h.label")


_PI = "3.141592653589793e0"
_SHIFT = "20037508.342789244e0"


@query(
    "e7_mercator_and_tiles",
    f"""WITH m AS (SELECT id, lat, lon, lon*{_SHIFT}/180.0e0 AS x, ln(tan((lat+90.0e0)*({_PI}/360.0e0)))/({_PI}/180.0e0)*{_SHIFT}/180.0e0 AS y FROM finds)
SELECT id, {sql_milli('x')} AS x_mm, {sql_milli('y')} AS y_mm, {sql_milli('degrees(atan(sinh(y/6378137.0e0)))*1000')} AS back_lat,
CAST(floor((lon+180.0e0)/360.0e0*16384) AS INT) AS tile_x, CAST(floor((1.0e0-ln(tan(radians(lat))+1.0e0/cos(radians(lat)))/{_PI})/2.0e0*16384) AS INT) AS tile_y FROM m""",
    "finds",
)
def _(t):
    m = t("finds").withColumn("m", geo.to_mercator(F.col("lat"), F.col("lon")))
    back = geo.from_mercator(F.col("m.x"), F.col("m.y"))
    return m.select("id", milli("m.x").alias("x_mm"), milli("m.y").alias("y_mm"), milli(back["lat"] * 1000).alias("back_lat"), geo.tile_x(F.col("lon"), 14).alias("tile_x"), geo.tile_y(F.col("lat"), 14).alias("tile_y"))


@query(
    "e10_tile_bounds",
    f"""WITH s AS (SELECT *, 2*{_SHIFT}/pow(2.0e0, z) AS span FROM tiles)
SELECT z, x, y, {sql_milli(f'x*span-{_SHIFT}')} AS min_x_mm, {sql_milli(f'{_SHIFT}-y*span')} AS max_y_mm, {sql_milli(f'degrees(atan(sinh(({_SHIFT}-y*span)/6378137.0e0)))*1000')} AS north, {sql_milli(f'(x*span-{_SHIFT})/{_SHIFT}*180.0e0*1000.0e0')} AS west, CAST(pow(2,z) AS INT)-1-y AS tms_y FROM s""",
    "tiles",
)
def _(t):
    z, x, y = F.col("z"), F.col("x"), F.col("y")
    m, d = geo.tile_bounds_m(x, y, z), geo.tile_bounds_deg(x, y, z)
    return t("tiles").select("z", "x", "y", milli(m["min_x"]).alias("min_x_mm"), milli(m["max_y"]).alias("max_y_mm"), milli(d["north"] * 1000).alias("north"), milli(d["west"] * 1000).alias("west"), geo.tms_row(y, z).alias("tms_y"))


@query(
    "e14_hilbert_ids",
    """WITH RECURSIVE h AS (SELECT z, x, y, z AS k, CAST(x AS BIGINT) AS cx, CAST(y AS BIGINT) AS cy, CAST((CAST(pow(4, z) AS BIGINT)-1)//3 AS BIGINT) AS d FROM tiles
UNION ALL SELECT z, x, y, k-1, CASE WHEN ry=0 THEN CASE WHEN rx=1 THEN s-1-my ELSE my END ELSE mx END, CASE WHEN ry=0 THEN CASE WHEN rx=1 THEN s-1-mx ELSE mx END ELSE my END, d + s*s*xor(3*rx, ry)
FROM (SELECT *, CAST(pow(2,k-1) AS BIGINT) AS s, cx % CAST(pow(2,k-1) AS BIGINT) AS mx, cy % CAST(pow(2,k-1) AS BIGINT) AS my, CAST(cx >= pow(2,k-1) AS BIGINT) AS rx, CAST(cy >= pow(2,k-1) AS BIGINT) AS ry FROM h WHERE k > 0) q)
SELECT z, x, y, d AS tile_id, z AS back_z, x AS back_x, y AS back_y FROM h WHERE k = 0""",
    "tiles",
)
def _(t):
    ids = tiles.with_ids(t("tiles"))
    return ids.withColumn("b", hilbert.zxy(F.col("tile_id"))).select("z", "x", "y", "tile_id", F.col("b.z").alias("back_z"), F.col("b.x").alias("back_x"), F.col("b.y").alias("back_y"))


@query(
    "a21_ring_areas",
    f"""WITH a AS (SELECT id, (lon+side)-lon AS w, (lat+side)-lat AS h, (lat+lat+(lat+side)+(lat+side))/4 AS m FROM areas) SELECT id, {sql_milli('w*h*(111132.92e0-559.82e0*cos(2*radians(m)))*(111412.84e0*cos(radians(m)))/10000.0e0')} AS milli_ha FROM a""",
    "areas",
)
def _(t):
    return polygons(t("areas")).select(F.col("poly_id").alias("id"), milli(geo.ring_area_ha(F.element_at("rings", 1))).alias("milli_ha"))


@query("a23_ring_bounds", f"SELECT id, {sql_milli('lon*1000')} AS west, {sql_milli('lat*1000')} AS south, {sql_milli('(lon+side)*1000')} AS east, {sql_milli('(lat+side)*1000')} AS north FROM areas", "areas")
def _(t):
    b = polygons(t("areas")).select(F.col("poly_id").alias("id"), geo.ring_bounds(F.col("rings")).alias("b"))
    return b.select("id", *[milli(F.col(f"b.{k}") * 1000).alias(k) for k in ("west", "south", "east", "north")])


@query(
    "g3_polygon_cells",
    "WITH b AS (SELECT id, CAST(floor(lon/0.01e0) AS BIGINT) AS x0, CAST(floor((lon+side)/0.01e0) AS BIGINT) AS x1, CAST(floor(lat/0.01e0) AS BIGINT) AS y0, CAST(floor((lat+side)/0.01e0) AS BIGINT) AS y1 FROM areas) SELECT id AS poly_id, count(*) AS cells, min(cx) AS first_x, max(cy) AS last_y FROM (SELECT id, unnest(range(x0, x1+1)) AS cx, y0, y1 FROM b) JOIN LATERAL (SELECT unnest(range(y0, y1+1)) AS cy) ON true GROUP BY 1",
    "areas",
)
def _(t):
    cells = spatial.polygon_cells(spatial.with_bounds(polygons(t("areas"))))
    return cells.groupBy("poly_id").agg(F.count("*").alias("cells"), F.min("cx").alias("first_x"), F.max("cy").alias("last_y"))


@query(
    "e31_accuracy_circles",
    f"WITH c AS (SELECT track_id, arrival, lat, lon, accuracy_m AS r, unnest(range(0, 49)) AS k FROM fixes WHERE accuracy_m > 1), p AS (SELECT track_id, arrival, lat, lon, lat + r * cos(k * 2 * 3.141592653589793e0 / 48) / 111132.0e0 AS la, lon + r * sin(k * 2 * 3.141592653589793e0 / 48) / (cos(radians(lat)) * 111320.0e0) AS lo FROM c), m AS (SELECT track_id, arrival, count(*) AS corners, sum({sql_distance('lat', 'lon', 'la', 'lo')}) AS d FROM p GROUP BY 1, 2) SELECT f.track_id, f.arrival, CAST(corners AS INT) AS corners, {sql_milli('d')} AS distances_mm FROM fixes f LEFT JOIN m USING (track_id, arrival)",
    "fixes",
)
def _(t):
    # a few large files make few tasks, and a row is 49 distances: rows are spread first
    fixes = t("fixes").select("track_id", "arrival", "lat", "lon", "accuracy_m")
    fixes = fixes.repartition(int(fixes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rings = fixes.withColumn("ring", geo.accuracy_circle(F.col("lat"), F.col("lon"), F.col("accuracy_m"))).withColumn("cos_lat", F.cos(F.radians("lat")))
    there = F.col("ring").isNotNull()
    distances = geo.ring_distances_m(F.col("ring"), F.col("lat"), F.col("lon"), F.col("cos_lat"))
    return rings.select("track_id", "arrival", F.when(there, F.size("ring")).alias("corners"), F.when(there, milli(distances)).alias("distances_mm"))


_SUN = """j AS (SELECT id, lat, lon, 20625 - 10957 - lon / 360.0e0 AS j FROM (SELECT id, lat, lon FROM places UNION ALL SELECT -id, 89.0e0, lon FROM places)),
m AS (SELECT *, radians((357.5291e0 + j * 0.98560028e0) % 360.0e0) AS m FROM j),
e AS (SELECT *, radians((degrees(m) + sin(m) * 1.9148e0 + sin(m * 2) * 0.02e0 + sin(m * 3) * 0.0003e0 + 180.0e0 + 102.9372e0) % 360.0e0) AS ecl FROM m),
s AS (SELECT *, j + 2451545.0e0 + sin(m) * 0.0053e0 - sin(ecl * 2) * 0.0069e0 AS noon, asin(sin(ecl) * sin(radians(23.4397e0))) AS decl FROM e),
h AS (SELECT *, (sin(radians(-0.833e0)) - sin(radians(lat)) * sin(decl)) / (cos(radians(lat)) * cos(decl)) AS ch FROM s),
r AS (SELECT id, CASE WHEN ch BETWEEN -1 AND 1 THEN CAST(trunc((noon - degrees(acos(greatest(-1.0e0, least(1.0e0, ch)))) / 360.0e0 - 2440587.5e0) * 86400000.0e0) AS BIGINT) END AS rise, CASE WHEN ch BETWEEN -1 AND 1 THEN CAST(trunc((noon + degrees(acos(greatest(-1.0e0, least(1.0e0, ch)))) / 360.0e0 - 2440587.5e0) * 86400000.0e0) AS BIGINT) END AS set FROM h)"""


@query("e5_sun_times", f"WITH {_SUN} SELECT id, CAST(floor(rise / 60000.0e0 + 0.5e0) AS BIGINT) AS rise_min, CAST(floor(set / 60000.0e0 + 0.5e0) AS BIGINT) AS set_min, CASE WHEN rise IS NOT NULL THEN CAST(floor((set - rise) / 60000.0e0 + 0.5e0) AS BIGINT) END AS daylight_min FROM r", "places")
def _(t):
    # every place, and one in the far north on its meridian, where the sun does not set
    places = t("places").select("id", "lat", "lon").union(t("places").select(-F.col("id"), F.lit(89.0), "lon"))
    minutes = lambda ms: F.floor(ms / 60_000 + 0.5)
    sun = places.select("id", geo.sun_times(F.col("lat"), F.col("lon"), F.lit(20625)).alias("s"))
    left = F.when(F.col("s").isNotNull(), minutes(geo.daylight_left(F.col("s.set"), F.col("s.rise"))))
    return sun.select("id", minutes(F.col("s.rise")).alias("rise_min"), minutes(F.col("s.set")).alias("set_min"), left.alias("daylight_min"))


@query(
    "e40_heading_differences",
    f"SELECT user_id, count(*) AS n, {sql_milli('max(CASE WHEN d > 180 THEN 360 - d ELSE d END)')} AS widest FROM (SELECT user_id, abs(value % 360.0e0 - (event_id % 360)) AS d FROM events) GROUP BY 1",
)
def _(t):
    d = geo.heading_difference(F.col("value") % 360.0, F.col("event_id") % 360)
    return t("events").groupBy("user_id").agg(F.count("*").alias("n"), milli(F.max(d)).alias("widest"))


@query(
    "e20_calibration_magnitudes",
    f"""WITH p AS (SELECT *, 1605282.7e0 AS px, 6461356.4e0 AS py, cos(radians(degrees(atan(sinh(6461356.4e0/6378137.0e0))))) AS ground FROM calibrations)
SELECT id, {sql_milli('sqrt(abs(a*d-b*c))*1000')} AS scale_ppm, {sql_milli('degrees(atan2(c,a))')} AS rotation_mdeg, abs(degrees(atan2(c,a))) >= 0.05e0 AS turned, abs(sqrt(abs(a*d-b*c)) - 1) >= 0.001e0 AS scaled, {sql_milli('sqrt(pow((a*px+b*py+tx-px)*ground, 2) + pow((c*px+d*py+ty-py)*ground, 2))')} AS shift_mm FROM p""",
    "calibrations",
)
def _(t):
    m = F.struct("a", "b", "tx", "c", "d", "ty")
    found = affine.magnitude(m, F.lit(1605282.7), F.lit(6461356.4))
    return t("calibrations").select("id", milli(affine.scale(m) * 1000).alias("scale_ppm"), milli(F.degrees(affine.rotation(m))).alias("rotation_mdeg"), found["rotation_deg"].isNotNull().alias("turned"), found["scale"].isNotNull().alias("scaled"), milli(found["shift_m"]).alias("shift_mm"))


@query(
    "e16_affine_inverse",
    f"""WITH i AS (SELECT id, a*d-b*c AS det, a, b, c, d, tx, ty FROM calibrations) SELECT id, {sql_milli('d/det*1000000')} AS a, {sql_milli('-b/det*1000000')} AS b, {sql_milli('-(d/det*tx - b/det*ty)')} AS tx, 0 AS off_identity FROM i""",
    "calibrations",
)
def _(t):
    m = F.struct("a", "b", "tx", "c", "d", "ty")
    rows = t("calibrations").select("id", m.alias("m"), affine.inverse(m).alias("i"))
    off = F.when(affine.is_identity(affine.concat(F.col("m"), F.col("i")), 1e-9), 0).otherwise(1)
    return rows.select("id", milli(F.col("i.a") * 1e6).alias("a"), milli(F.col("i.b") * 1e6).alias("b"), milli("i.tx").alias("tx"), off.alias("off_identity"))


_S2 = "(2*20037508.342789244e0)"
_S1 = "20037508.342789244e0"
_PLANNED = f"""one AS (SELECT layer_id, arg_min(a, id) AS a, arg_min(b, id) AS b, arg_min(tx, id) AS tx, arg_min(c, id) AS c, arg_min(d, id) AS d, arg_min(ty, id) AS ty FROM calibrations GROUP BY 1),
i AS (SELECT z, x, y, d/det AS ia, -b/det AS ib, -c/det AS ic, a/det AS id, tx, ty, sqrt(abs(det)) AS s, {_S2}/pow(2.0e0, z) AS span FROM (SELECT t.z, t.x, t.y, o.*, a*d-b*c AS det FROM tiles t JOIN one o ON o.layer_id = concat('layer', CAST(t.x % 25 AS VARCHAR))) q),
k AS (SELECT *, x*span-{_S1} AS x0m, (x+1)*span-{_S1} AS x1m, {_S1}-y*span AS y1m, {_S1}-(y+1)*span AS y0m, greatest(0, least(9, greatest(z-1, least(z+1, z + CAST(floor(ln(s)/ln(2.0e0) + 0.5e0) AS INT))))) AS zoom FROM i),
cs AS (SELECT z, x, y, zoom, unnest([ia*x0m+ib*y1m, ia*x1m+ib*y1m, ia*x1m+ib*y0m, ia*x0m+ib*y0m]) - (ia*tx+ib*ty) AS cx, unnest([ic*x0m+id*y1m, ic*x1m+id*y1m, ic*x1m+id*y0m, ic*x0m+id*y0m]) - (ic*tx+id*ty) AS cy FROM k),
b AS (SELECT z, x, y, zoom, min(cx) AS w, max(cx) AS e, min(cy) AS s, max(cy) AS n, {_S2}/pow(2.0e0, zoom) AS sp, CAST(pow(2, zoom) AS BIGINT) AS side FROM cs GROUP BY z, x, y, zoom),
f AS (SELECT *, CAST(floor((w+{_S1})/sp + 1e-9) AS BIGINT) AS fx0, CAST(floor(({_S1}-n)/sp + 1e-9) AS BIGINT) AS fy0, CAST(ceil((e+{_S1})/sp - 1e-9) AS BIGINT) - 1 AS fx1, CAST(ceil(({_S1}-s)/sp - 1e-9) AS BIGINT) - 1 AS fy1,
CAST(floor(((w+e)/2+{_S1})/sp) AS BIGINT) AS mx, CAST(floor(({_S1}-(s+n)/2)/sp) AS BIGINT) AS my FROM b),
r AS (SELECT z, x, y, zoom, side, greatest(0, least(side-1, fx0)) AS rx0, greatest(0, least(side-1, greatest(fx0, fx1))) AS rx1, greatest(0, least(side-1, fy0)) AS ry0, greatest(0, least(side-1, greatest(fy0, fy1))) AS ry1, greatest(0, least(side-1, mx)) AS mx, greatest(0, least(side-1, my)) AS my,
greatest(fx0, fx1) < 0 OR greatest(fy0, fy1) < 0 OR fx0 > side-1 OR fy0 > side-1 AS outside FROM f),
g AS (SELECT *, (rx1-rx0+1)*(ry1-ry0+1) > 25 AS many FROM r),
want AS (SELECT z, x, y, zoom, many, CASE WHEN many THEN mx ELSE rx0 END AS a0, CASE WHEN many THEN mx ELSE rx1 END AS a1, CASE WHEN many THEN my ELSE ry0 END AS b0, CASE WHEN many THEN my ELSE ry1 END AS b1 FROM g WHERE NOT outside)"""


@query("j21_source_tiles", f"WITH {_PLANNED} SELECT w.z, w.x, w.y, (a1-a0+1)*(b1-b0+1) AS needed, (SELECT count(*) FROM tiles t WHERE t.z = w.zoom AND t.x BETWEEN a0 AND a1 AND t.y BETWEEN b0 AND b1) AS present, many AS clamped FROM want w", "tiles", "calibrations")
def _(t):
    # every tile through the calibration that its row picks; the plan's tiles meet those that are there
    tiles_ = t("tiles").withColumn("layer", F.concat(F.lit("layer"), (F.col("x") % 25).cast("string")))
    m = F.struct("a", "b", "tx", "c", "d", "ty")
    one = t("calibrations").groupBy(F.col("layer_id").alias("layer")).agg(F.min_by(m, "id").alias("m"))
    planned = tiles_.join(spatial.small(one), "layer").withColumn("zoom", affine.source_zoom(F.col("z"), F.col("m"), F.lit(0), F.lit(9)))
    planned = planned.withColumn("p", affine.source_tile_plan(F.col("z"), F.col("x"), F.col("y"), affine.inverse(F.col("m")), F.col("zoom")))
    wanted = planned.select("z", "x", "y", "p.clamped", F.explode("p.tiles").alias("s")).select("z", "x", "y", "clamped", F.col("s.z").alias("sz"), F.col("s.x").alias("sx"), F.col("s.y").alias("sy"))
    there = t("tiles").select(F.col("z").alias("sz"), F.col("x").alias("sx"), F.col("y").alias("sy"), "content")
    found = wanted.hint("merge").join(there.hint("merge"), ["sz", "sx", "sy"], "left")
    return found.groupBy("z", "x", "y").agg(F.count("*").alias("needed"), F.count("content").alias("present"), F.bool_or("clamped").alias("clamped"))


_RES = "(2*20037508.342789244e0/256.0e0/pow(2.0e0, z))"


@query(
    "e22_warp_matrices",
    f"""WITH one AS (SELECT id % 25 AS k, arg_min(a, id) AS a, arg_min(b, id) AS b, arg_min(tx, id) AS tx, arg_min(c, id) AS c, arg_min(d, id) AS d, arg_min(ty, id) AS ty FROM calibrations GROUP BY 1),
j AS (SELECT t.z, t.x, t.y, o.*, {_RES} AS res, x*256*{_RES}-{_S1} AS ox, {_S1}-y*256*{_RES} AS oy FROM tiles t JOIN one o ON o.k = t.x % 25)
SELECT z, x, y, {sql_milli('a*128 - b*128 + (a*ox+b*oy+tx-ox)/res')} AS px, {sql_milli('-c*128 + d*128 + (oy-(c*ox+d*oy+ty))/res')} AS py,
(abs(a-1) <= 1e-12 AND abs(b) <= 1e-12 AND abs(tx) <= 1e-12 AND abs(c) <= 1e-12 AND abs(d-1) <= 1e-12 AND abs(ty) <= 1e-12) OR sqrt(tx*tx+ty*ty) + abs(sqrt(abs(a*d-b*c))-1)*256*res < res*0.25e0 AS negligible FROM j""",
    "tiles", "calibrations",
)
def _(t):
    m = F.struct("a", "b", "tx", "c", "d", "ty")
    one = t("calibrations").groupBy((F.col("id") % 25).alias("k")).agg(F.min_by(m, "id").alias("m"))
    rows = t("tiles").withColumn("k", F.col("x") % 25).join(spatial.small(one), "k")
    w = affine.warp_matrix(F.col("z"), F.col("x"), F.col("y"), F.col("m"), F.col("z"), F.col("x"), F.col("y"))
    centre = affine.apply_matrix(w, F.lit(128.0), F.lit(128.0))
    return rows.select("z", "x", "y", milli(centre["px"]).alias("px"), milli(centre["py"]).alias("py"), affine.negligible(F.col("m"), F.col("z")).alias("negligible"))


@query(
    "e12_box_shapes",
    f"SELECT id, {sql_milli('(west+east)/2*1000')} AS lon, {sql_milli('(south+north)/2*1000')} AS lat, {sql_milli('(east-west)*1000')} AS width, {sql_milli('(east-west)*(north-south)*1000')} AS area, {sql_milli('((west+east)/2-(east-west)*0.6e0)*1000')} AS grown_west, {sql_milli('((south+north)/2+greatest(north-south, 2.0e0)/2)*1000')} AS least_north FROM calibrations",
    "calibrations",
)
def _(t):
    b = geo.box_struct(F.col("west"), F.col("south"), F.col("east"), F.col("north"))
    centre = geo.box_centre(b)
    return t("calibrations").select(
        "id", milli(centre["lon"] * 1000).alias("lon"), milli(centre["lat"] * 1000).alias("lat"), milli(geo.box_width(b) * 1000).alias("width"), milli(geo.box_area(b) * 1000).alias("area"),
        milli(geo.box_expand(b, 1.2)["west"] * 1000).alias("grown_west"), milli(geo.box_at_least(b, 2.0)["north"] * 1000).alias("least_north"),
    )
