"""Queries of the field log: filters, nested joins, orders, statistics, merges, changes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terravane.functions import classify, geo
from terravane.operators import fieldlog, layers, order, spatial
from terravane.plans.helpers import query, sql_distance, sql_milli

T0 = 1600000000000
NOW = T0 + 1900 * 43_200_000


@query("f1_lookup", "SELECT id, track_id FROM finds WHERE track_id = 33 UNION ALL SELECT find_id, NULL FROM find_photos WHERE find_id = 42", "finds", "find_photos")
def _(t):
    a = fieldlog.lookup(t("finds"), "track_id", 33).select("id", "track_id")
    return a.unionByName(fieldlog.lookup(t("find_photos"), "find_id", 42).select(F.col("find_id").alias("id"), F.lit(None).cast("long").alias("track_id")))


@query("f2_gallery", f"SELECT id, category, created_at FROM finds WHERE category IN ('MINCE', 'KNOFLIK') AND created_at BETWEEN {T0} AND {NOW} AND favorite", "finds")
def _(t):
    return fieldlog.gallery(t("finds"), ["MINCE", "KNOFLIK"], T0, NOW, favorites=True).select("id", "category", "created_at")


@query(
    "f3_date_presets",
    f"SELECT 'today' AS preset, count(*) AS n FROM finds WHERE created_at >= {NOW} - {NOW} % 86400000 UNION ALL SELECT '7d', count(*) FROM finds WHERE created_at >= {NOW} - 7*86400000 UNION ALL SELECT '30d', count(*) FROM finds WHERE created_at >= {NOW} - CAST(30 AS BIGINT)*86400000 UNION ALL SELECT 'all', count(*) FROM finds",
    "finds",
)
def _(t):
    finds = t("finds")
    presets = ["today", "7d", "30d", "all"]
    flags = [F.count(F.when(F.coalesce(F.col("created_at") >= fieldlog.since_preset(p, NOW), F.lit(True)), 1)).alias(f"n_{p}") for p in presets]
    return finds.agg(*flags).select(F.explode(F.array(*[F.struct(F.lit(p).alias("preset"), F.col(f"n_{p}").alias("n")) for p in presets])).alias("r")).select("r.*")


@query("f4_places", "SELECT id, type FROM places WHERE type IN ('PLAN', 'SRAZ') AND NOT visited", "places")
def _(t):
    return fieldlog.places_filter(t("places"), ["PLAN", "SRAZ"], unvisited=True).select("id", "type")


@query("f5_viewport", "SELECT id FROM finds WHERE lat BETWEEN 49.5e0 AND 50.25e0 AND lon BETWEEN 13.0e0 AND 15.5e0", "finds")
def _(t):
    return fieldlog.viewport(t("finds"), 13.0, 49.5, 15.5, 50.25).select("id")


@query("f6_areas_by_status", "SELECT id FROM areas WHERE status = 'HOTOVO'", "areas")
def _(t):
    return fieldlog.lookup(t("areas"), "status", "HOTOVO").select("id")


_TRACKS = f"tracks AS (SELECT track_id AS id, min(ts) AS started_at, CASE WHEN track_id % 10 = 0 THEN NULL ELSE max(ts) END AS ended_at, concat('Track ', CAST(track_id AS VARCHAR)) AS name FROM fixes GROUP BY track_id)"


def tracks_of(t):
    fixes = t("fixes")
    return fixes.groupBy(F.col("track_id").alias("id")).agg(F.min("ts").alias("started_at"), F.max("ts").alias("last_at")).select(
        "id", "started_at", F.when(F.col("id") % 10 != 0, F.col("last_at")).alias("ended_at"), F.concat(F.lit("Track "), F.col("id").cast("string")).alias("name")
    )


@query("f7_active_track", f"WITH {_TRACKS} SELECT id, started_at FROM tracks WHERE ended_at IS NULL ORDER BY started_at DESC, id DESC LIMIT 1", "fixes")
def _(t):
    return fieldlog.active_track(tracks_of(t)).select("id", "started_at")


@query("f8_boxes", "SELECT c.id, count(p.id) AS holds FROM calibrations c LEFT JOIN places p ON p.lat BETWEEN c.south AND c.north AND p.lon BETWEEN c.west AND c.east GROUP BY 1", "calibrations", "places")
def _(t):
    boxes = t("calibrations").select(F.col("id").alias("box_id"), "west", "south", "east", "north")
    return spatial.count_in_boxes(t("places"), boxes).withColumnRenamed("box_id", "id")


@query("f15_accuracy_classes", "SELECT CASE WHEN accuracy_m IS NULL THEN 'NONE' WHEN accuracy_m <= 6 THEN 'GOOD' WHEN accuracy_m <= 15 THEN 'OK' ELSE 'POOR' END AS class, count(*) AS n FROM fixes GROUP BY 1", "fixes")
def _(t):
    return t("fixes").groupBy(classify.accuracy_class(F.col("accuracy_m")).alias("class")).agg(F.count("*").alias("n"))


@query("j1_finds_with_photos", "SELECT f.id, count(p.find_id) AS photos, min(p.created_at) AS first_at, max(p.created_at) AS last_at, CAST(coalesce(sum(length(p.uri)), 0) AS BIGINT) AS letters, true AS in_order FROM finds f LEFT JOIN find_photos p ON p.find_id = f.id GROUP BY 1", "finds", "find_photos")
def _(t):
    nested = fieldlog.nested(t("finds").select("id"), t("find_photos"), "id", "find_id", ["created_at", "id", "uri", "is_primary"], "photos")
    of = lambda k: F.when(F.size("photos") > 0, F.element_at("photos", k)["created_at"])
    letters = F.aggregate("photos", F.lit(0).cast("long"), lambda s, p: s + F.length(p["uri"]))
    return nested.groupBy("id").agg(
        F.sum(F.size("photos").cast("long")).alias("photos"), F.min(of(1)).alias("first_at"), F.max(of(-1)).alias("last_at"), F.sum(letters).alias("letters"), F.bool_and(F.array_sort("photos") == F.col("photos")).alias("in_order")
    )


@query("j2_primary_photo", "WITH r AS (SELECT find_id, uri, row_number() OVER (PARTITION BY find_id ORDER BY NOT is_primary, created_at, id, uri) AS rn FROM find_photos) SELECT find_id, uri FROM r WHERE rn = 1", "find_photos")
def _(t):
    return fieldlog.primary_photo(t("find_photos"))


@query("j3_tracks_with_points", f"WITH {_TRACKS} SELECT t.id, count(f.arrival) AS points, sum(f.arrival * 7 % 13) AS checked, min(f.ts) AS first_ts FROM tracks t LEFT JOIN fixes f ON f.track_id = t.id GROUP BY 1", "fixes")
def _(t):
    # small blocks, so that tracks really have several
    nested = fieldlog.nested(tracks_of(t).select("id"), t("fixes"), "id", "track_id", ["ts", "arrival"], "points", most=50)
    checked = F.aggregate("points", F.lit(0).cast("long"), lambda s, p: s + p["arrival"] * 7 % 13)
    first = F.when(F.col("block") == 0, F.element_at("points", 1)["ts"])
    return nested.groupBy("id").agg(F.sum(F.size("points").cast("long")).alias("points"), F.sum(checked).alias("checked"), F.max(first).alias("first_ts"))


@query("j4_sets_with_points", "SELECT set_id AS id, count(*) AS points, CAST(sum(id) AS BIGINT) AS ids, min(id) AS first_id FROM gcp_points GROUP BY 1", "gcp_points")
def _(t):
    points = t("gcp_points")
    nested = fieldlog.nested(points.select(F.col("set_id").alias("id")).distinct(), points, "id", "set_id", ["id"], "points")
    ids = F.aggregate("points", F.lit(0).cast("long"), lambda s, p: s + p["id"])
    return nested.groupBy("id").agg(F.sum(F.size("points").cast("long")).alias("points"), F.sum(ids).alias("ids"), F.min(F.element_at("points", 1)["id"]).alias("first_id"))


@query("j5_detectors_with_presets", "WITH n AS (SELECT detector_id, count(*) AS presets FROM presets GROUP BY 1) SELECT d.id, coalesce(n.presets, 0) AS presets, row_number() OVER (ORDER BY d.is_default DESC, d.created_at, d.id) AS place FROM detectors d LEFT JOIN n ON n.detector_id = d.id", "detectors", "presets")
def _(t):
    nested = fieldlog.nested(t("detectors"), t("presets"), "id", "detector_id", ["created_at", "id"], "presets")
    counts = nested.groupBy("id", "is_default", "created_at").agg(F.sum(F.size("presets").cast("long")).alias("presets"))
    return order.numbered(counts, [F.desc("is_default"), F.col("created_at"), F.col("id")], "place").select("id", "presets", "place")


_LAYERS = """catalogue AS (SELECT concat('layer', CAST(n_nationkey AS VARCHAR)) AS layer_id, n_name AS title, CASE n_regionkey WHEN 0 THEN 'geojson' WHEN 1 THEN 'pmtiles' ELSE 'xyz' END AS kind, n_nationkey AS ord FROM nation),
prefs AS (SELECT concat('layer', CAST(n_nationkey AS VARCHAR)) AS layer_id, n_nationkey % 3 <> 0 AS visible, 0.5e0 AS opacity, 100 - n_nationkey AS user_ord FROM nation WHERE n_nationkey % 2 = 0),
avail AS (SELECT concat('layer', CAST(n_nationkey AS VARCHAR)) AS layer_id, true AS available FROM nation WHERE n_nationkey % 5 <> 0)"""


def _layer_tables(t):
    n = t("nation")
    key = F.concat(F.lit("layer"), F.col("n_nationkey").cast("string")).alias("layer_id")
    catalogue = n.select(key, F.col("n_name").alias("title"), F.when(F.col("n_regionkey") == 0, "geojson").when(F.col("n_regionkey") == 1, "pmtiles").otherwise("xyz").alias("kind"), F.col("n_nationkey").alias("ord"))
    prefs = n.where("n_nationkey % 2 = 0").select(key, (F.col("n_nationkey") % 3 != 0).alias("visible"), F.lit(0.5).alias("opacity"), (100 - F.col("n_nationkey")).alias("user_ord"))
    return catalogue, prefs, n.where("n_nationkey % 5 <> 0").select(key, F.lit(True).alias("available"))


_STATES = f"WITH {_LAYERS}, states AS (SELECT c.layer_id, c.title, c.kind, coalesce(p.visible, false) AS visible, coalesce(p.opacity, 1.0e0) AS opacity, coalesce(a.available, false) AS available, c.layer_id IN (SELECT layer_id FROM calibrations WHERE active) AS calibrated, coalesce(p.user_ord, c.ord) AS position FROM catalogue c LEFT JOIN prefs p USING (layer_id) LEFT JOIN avail a USING (layer_id)) "


@query("j12_layer_states", _STATES + "SELECT * FROM states", "calibrations")
def _(t):
    return layers.layer_states(*_layer_tables(t), t("calibrations"))


@query("f10_usable_overlays", _STATES + "SELECT layer_id, kind, kind IN ('pmtiles') AS is_local, kind = 'xyz' AS is_online FROM states WHERE visible AND available AND kind <> 'geojson'", "calibrations")
def _(t):
    usable = layers.usable_overlays(layers.layer_states(*_layer_tables(t), t("calibrations")))
    return usable.select("layer_id", "kind", classify.is_local(F.col("kind")).alias("is_local"), classify.is_online(F.col("kind")).alias("is_online"))


@query("j13_layer_titles", f"WITH {_LAYERS} SELECT f.id, coalesce(CASE WHEN a.available THEN concat(c.title, '!') END, c.title, f.layer_context_id) AS layer_title FROM finds f LEFT JOIN catalogue c ON c.layer_id = f.layer_context_id LEFT JOIN avail a ON a.layer_id = f.layer_context_id", "finds")
def _(t):
    catalogue, _, available = _layer_tables(t)
    live = catalogue.join(available, "layer_id").select("layer_id", F.concat("title", F.lit("!")).alias("title"))
    return layers.layer_titles(t("finds"), live, catalogue).select("id", "layer_title")


@query(
    "j15_storage",
    f"WITH {_LAYERS}, cache AS (SELECT concat('layer', CAST(x % 40 AS VARCHAR)) AS layer_id, bytes FROM tiles), c AS (SELECT layer_id, CAST(sum(bytes) AS BIGINT) AS cb FROM cache GROUP BY 1), a AS (SELECT layer_id, CAST(sum(updated_at % 1000 + 5000) AS BIGINT) AS ab FROM calibrations GROUP BY 1) SELECT layer_id, coalesce(cb, 0) AS cache_bytes, coalesce(ab, 0) AS archive_bytes, false AS orphan FROM catalogue LEFT JOIN c USING (layer_id) LEFT JOIN a USING (layer_id) UNION ALL SELECT layer_id, cb, 0, true FROM c WHERE layer_id NOT IN (SELECT layer_id FROM catalogue)",
    "tiles", "calibrations",
)
def _(t):
    caches = t("tiles").select(F.concat(F.lit("layer"), (F.col("x") % 40).cast("string")).alias("layer_id"), F.col("bytes").cast("long").alias("bytes"))
    archives = t("calibrations").select("layer_id", (F.col("updated_at") % 1000 + 5000).alias("bytes"))
    return layers.storage(_layer_tables(t)[0], caches, archives)


@query("j18_merged_catalogue", f"WITH {_LAYERS} SELECT layer_id, title FROM catalogue WHERE ord < 10 UNION ALL SELECT layer_id, concat('new ', title) FROM catalogue WHERE ord >= 10", "tiles")
def _(t):
    catalogue = _layer_tables(t)[0]
    current = catalogue.where("ord < 10").select("layer_id", "title")
    return layers.merge_catalogue(current, 3, catalogue.select("layer_id", F.concat(F.lit("new "), "title").alias("title")), 4)


@query(
    "j20_ranked_presets",
    "SELECT id, CASE WHEN terrain = 'LES' AND soil = 'MOKRO' THEN 3 WHEN terrain = 'LES' THEN 2 WHEN soil = 'MOKRO' THEN 1 ELSE 0 END AS score, row_number() OVER (ORDER BY CASE WHEN terrain = 'LES' AND soil = 'MOKRO' THEN 3 WHEN terrain = 'LES' THEN 2 WHEN soil = 'MOKRO' THEN 1 ELSE 0 END DESC, id) AS place, CASE WHEN terrain = 'LES' AND soil = 'MOKRO' THEN 'Sedí terén i stav půdy: les, mokro.' END AS best_reason FROM presets",
    "presets",
)
def _(t):
    ranked = layers.rank_presets(t("presets").withColumn("position", F.col("id")), "LES", "MOKRO")
    placed = order.numbered(ranked, [F.desc("score"), F.col("position")], "place")
    return placed.select("id", "score", "place", F.when(F.col("score") == 3, F.col("reason")).alias("best_reason"))


_NAMES = lambda c, names: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"
_T, _S = _NAMES("terrain", classify.TERRAINS), _NAMES("soil", classify.SOILS)
# The wording.
_REASONS = f"""CASE WHEN st AND ss THEN printf('Sedí terén i stav půdy: %s, %s.', {_T}, {_S}) WHEN st AND ws IS NULL THEN printf('Sedí terén (%s); stav půdy neznáme.', {_T})
WHEN st THEN printf('Sedí terén (%s), ale uložený je na %s.', {_T}, {_S}) WHEN ss AND wt IS NULL THEN printf('Sedí stav půdy (%s); terén jsi nevybral.', {_S})
WHEN ss THEN printf('Sedí stav půdy (%s), ale uložený je na terén %s.', {_S}, {_T}) ELSE printf('Neodpovídá ani terénu, ani stavu půdy — uložený je na %s, %s.', {_T}, {_S}) END"""


@query(
    "e26_preset_reasons",
    f"WITH w(wt, ws) AS (VALUES ('LES', 'MOKRO'), ('LES', NULL), (NULL, 'MOKRO'), (NULL, NULL)), c AS (SELECT id, terrain, soil, wt, ws, coalesce(terrain = wt, false) AS st, coalesce(soil = ws, false) AS ss FROM presets, w) SELECT id, wt AS wanted_terrain, ws AS wanted_soil, {_REASONS} AS reason FROM c",
    "presets",
)
def _(t):
    wanted = [("LES", "MOKRO"), ("LES", None), (None, "MOKRO"), (None, None)]
    of = lambda v: F.lit(v).cast("string")
    found = [F.struct(of(a).alias("wanted_terrain"), of(b).alias("wanted_soil"), classify.preset_reason(F.col("terrain"), F.col("soil"), of(a), of(b)).alias("reason")) for a, b in wanted]
    return t("presets").select("id", F.explode(F.array(*found)).alias("r")).select("id", "r.*")


@query("e28_effective_soil", "SELECT id, CASE WHEN id % 4 = 0 THEN CASE WHEN id % 50 < 20 THEN 'SUCHO' WHEN id % 50 < 35 THEN 'VLHKO' ELSE 'MOKRO' END ELSE soil END AS soil FROM presets", "presets")
def _(t):
    chosen = F.when(F.col("id") % 4 != 0, F.col("soil"))
    return t("presets").select("id", layers.effective_soil(chosen, classify.soil_of_moisture((F.col("id") % 50) / 100.0)).alias("soil"))


_FLAGS, _NUMBERS = ["true", "TRUE", "1", "False", "0", "yes", None], ["12", " 7", "x", "1.5", None, "-3"]


@query(
    "s3_lenient_values",
    "WITH v AS (SELECT o_orderkey AS id, ['true', 'TRUE', '1', 'False', '0', 'yes', NULL][o_orderkey % 7 + 1] AS f, ['12', ' 7', 'x', '1.5', NULL, '-3'][o_orderkey % 6 + 1] AS n FROM orders) SELECT id, coalesce(CASE WHEN lower(f) IN ('true', '1') THEN true WHEN lower(f) IN ('false', '0') THEN false END, id % 2 = 0) AS flag, CASE trim(n) WHEN '12' THEN 12 WHEN '7' THEN 7 WHEN '-3' THEN -3 ELSE -1 END AS whole, coalesce(TRY_CAST(trim(n) AS DOUBLE), 0.5e0) AS number FROM v",
)
def _(t):
    pick = lambda values: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.col("o_orderkey") % len(values) + 1).cast("int"))
    raw = t("orders").select(F.col("o_orderkey").alias("id"), F.to_json(F.struct(pick(_FLAGS).alias("f"), pick(_NUMBERS).alias("n"))).alias("json"))
    value = lambda k: F.get_json_object("json", f"$.{k}")
    flag = F.when(F.col("id") % 2 == 0, classify.lenient_boolean(value("f"), True)).otherwise(classify.lenient_boolean(value("f"), False))
    return raw.select("id", flag.alias("flag"), classify.lenient_number(value("n"), "int", -1).alias("whole"), classify.lenient_number(value("n"), "double", 0.5).alias("number"))


@query("d5_import_counts", "WITH inc AS (SELECT CASE WHEN id % 11 = 0 THEN NULL ELSE id END AS id, CASE WHEN id % 13 = 0 THEN NULL WHEN id % 2 = 0 THEN CAST(id AS VARCHAR) ELSE 'new' || (id // 4) END AS x FROM finds), ok AS (SELECT * FROM inc WHERE id IS NOT NULL AND x IS NOT NULL), fresh AS (SELECT DISTINCT x FROM ok WHERE x NOT IN (SELECT CAST(id AS VARCHAR) FROM finds)) SELECT (SELECT count(*) FROM inc) AS incoming, (SELECT count(*) FROM fresh) AS inserted, (SELECT count(*) FROM ok) - (SELECT count(*) FROM fresh) AS skipped, (SELECT count(*) FROM inc WHERE id IS NULL OR x IS NULL) AS warnings", "finds")
def _(t):
    finds = t("finds")
    existing = finds.select("id", F.col("id").cast("string").alias("external_id"))
    key = F.when(F.col("id") % 13 != 0, F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).otherwise(F.concat(F.lit("new"), F.floor(F.col("id") / 4).cast("string"))))
    incoming = finds.select(F.when(F.col("id") % 11 != 0, F.col("id")).alias("id"), key.alias("external_id"))
    return fieldlog.merge_import(existing, incoming)[1]


@query("o6_places_nearest", f"SELECT id, row_number() OVER (ORDER BY {sql_milli(sql_distance('50.0e0', '15.0e0', 'lat', 'lon'))}, id) AS place FROM places", "places")
def _(t):
    return order.numbered(t("places"), fieldlog.of_places("nearest", 50.0, 15.0), "place").select("id", "place")


@query("o6_places_newest", "SELECT id, row_number() OVER (ORDER BY created_at DESC, id DESC) AS place FROM places", "places")
def _(t):
    return order.numbered(t("places"), fieldlog.of_places("nearest"), "place").select("id", "place")  # no position: the newest first


@query("o6_places_by_type", f"SELECT id, row_number() OVER (ORDER BY list_position({classify.PLACE_TYPES}, CASE WHEN type IN {tuple(classify.PLACE_TYPES)} THEN type ELSE 'ZAJIMAVOST' END), created_at DESC, id DESC) AS place FROM places", "places")
def _(t):
    return order.numbered(t("places"), fieldlog.of_places("type"), "place").select("id", "place")


@query("o2_calibrations_in_order", "SELECT id, row_number() OVER (ORDER BY layer_id, updated_at DESC, id) AS place FROM calibrations", "calibrations")
def _(t):
    return order.numbered(t("calibrations"), fieldlog.of_layers(), "place").select("id", "place")


@query("o2_points_in_order", "SELECT 'track' AS kind, arrival AS id, row_number() OVER (ORDER BY track_id, ts, arrival) AS place FROM fixes UNION ALL SELECT 'set', id, row_number() OVER (ORDER BY set_id, id) FROM gcp_points", "fixes", "gcp_points")
def _(t):
    fixes = order.numbered(t("fixes"), fieldlog.of_points("track_id", "ts", "arrival"), "place").select(F.lit("track").alias("kind"), F.col("arrival").alias("id"), "place")
    sets = order.numbered(t("gcp_points"), fieldlog.of_points("set_id", "id"), "place").select(F.lit("set").alias("kind"), "id", "place")
    return fixes.unionByName(sets)


@query("o3_photos_in_order", "SELECT find_id, id, row_number() OVER (ORDER BY find_id, is_primary DESC, created_at, id, uri) AS place FROM find_photos", "find_photos")
def _(t):
    return order.numbered(t("find_photos"), fieldlog.of_photos(), "place").select("find_id", "id", "place")


@query("o1_newest_finds", "SELECT id, row_number() OVER (ORDER BY created_at DESC, id DESC) AS place FROM finds", "finds")
def _(t):
    return order.numbered(t("finds").select("id", "created_at"), fieldlog.newest_first(), "place").select("id", "place")


@query("a1_find_stats", "SELECT count(*) AS total, coalesce(sum(CAST(favorite AS BIGINT)), 0)::BIGINT AS favorites, min(created_at) AS first_at, max(created_at) AS last_at, max(depth_cm) AS deepest_cm FROM finds", "finds")
def _(t):
    return fieldlog.find_stats(t("finds"))


@query("a2_category_histogram", "SELECT CASE WHEN category = 'NEZNAMA' THEN 'OSTATNI' ELSE category END AS category, count(*) AS n FROM finds GROUP BY 1", "finds")
def _(t):
    return fieldlog.category_histogram(t("finds"))


@query("a4_area_totals", "SELECT sum(area_ha) AS total_ha, coalesce(sum(area_ha) FILTER (WHERE status = 'HOTOVO'), 0.0e0) AS done_ha FROM areas", "areas")
def _(t):
    return fieldlog.area_totals(t("areas"))


@query("a5_row_counts", 'SELECT \'finds\' AS "table", count(*) AS n FROM finds UNION ALL SELECT \'photos\', count(*) FROM find_photos UNION ALL SELECT \'places\', count(*) FROM places', "finds", "find_photos", "places")
def _(t):
    return fieldlog.row_counts({"finds": t("finds"), "photos": t("find_photos"), "places": t("places")})


@query("a27_last_known_fix", "SELECT track_id, max(ts) AS ts, max_by(lat, (ts, lat)) AS lat FROM fixes GROUP BY 1", "fixes")
def _(t):
    return fieldlog.last_known(t("fixes").select("track_id", "ts", "lat"))


_IDS = "SELECT id, 'find-' || created_at || '-' || printf('%.7f', lat) || '-' || printf('%.7f', lon) AS external_id FROM finds"


@query("e29_external_ids", _IDS, "finds")
def _(t):
    return t("finds").select("id", classify.external_id("find", F.col("created_at"), F.col("lat"), F.col("lon")).alias("external_id"))


def _library(t):
    finds = t("finds")
    finds = finds.select("id", classify.external_id("find", F.col("created_at"), F.col("lat"), F.col("lon")).alias("external_id"))
    # what comes in: half of it known under other ids, some ids taken, some free
    incoming = finds.where("id % 2 = 0").select((F.col("id") + 7000).alias("id"), "external_id").unionByName(
        finds.where("id % 3 = 1").select((F.col("id") * 3).alias("id"), F.concat("external_id", F.lit("x")).alias("external_id"))
    )
    return finds, incoming


_IN = f"WITH l AS ({_IDS}), inc AS (SELECT id + 7000 AS id, external_id FROM l WHERE id % 2 = 0 UNION ALL SELECT id * 3, external_id || 'x' FROM l WHERE id % 3 = 1) "


@query("j16_import_new_rows", _IN + "SELECT 'new' AS kind, count(*) AS n FROM inc WHERE external_id NOT IN (SELECT external_id FROM l) UNION ALL SELECT 'known', count(*) FROM inc WHERE external_id IN (SELECT external_id FROM l)", "finds")
def _(t):
    existing, incoming = _library(t)
    new, known = fieldlog.new_rows(incoming, existing), fieldlog.known_rows(incoming, existing)
    return new.agg(F.count("*").alias("n")).select(F.lit("new").alias("kind"), "n").unionByName(known.agg(F.count("*").alias("n")).select(F.lit("known").alias("kind"), "n"))


@query(
    "d5_import_merge",
    _IN
    + """, fresh AS (SELECT external_id, min(id) AS id FROM inc WHERE external_id NOT IN (SELECT external_id FROM l) GROUP BY 1),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY external_id) AS rn, id IN (SELECT id FROM l) AS taken FROM fresh), top AS (SELECT max(id) AS m FROM (SELECT id FROM l UNION ALL SELECT id FROM inc))
SELECT external_id, id FROM k WHERE NOT taken AND rn = 1 UNION ALL SELECT external_id, m + row_number() OVER (ORDER BY id, external_id) FROM k, top WHERE taken OR rn > 1""",
    "finds",
)
def _(t):
    existing, incoming = _library(t)
    return fieldlog.merge_import(existing, incoming)[0].select("external_id", "id")


@query("j17_reparented_photos", "SELECT count(*) AS photos, CAST(sum(find_id) AS BIGINT) AS parents FROM (SELECT f.lowest + 100 AS find_id FROM find_photos p JOIN (SELECT id, min(id) OVER (PARTITION BY created_at, lat, lon) AS lowest FROM finds WHERE id % 2 = 0) f ON f.id = p.find_id)", "finds", "find_photos")
def _(t):
    finds = t("finds").select("id", classify.external_id("find", F.col("created_at"), F.col("lat"), F.col("lon")).alias("external_id"))
    resolved = finds.where("id % 2 = 0").select((F.col("id") + 100).alias("id"), "external_id")
    moved = fieldlog.reparent(t("find_photos"), finds, resolved, "find_id")
    return moved.agg(F.count("*").alias("photos"), F.sum("find_id").alias("parents"))


@query("j19_cascade", "SELECT find_id, count(*) AS n FROM find_photos WHERE find_id % 4 <> 0 OR find_id NOT IN (SELECT id FROM finds) GROUP BY 1", "finds", "find_photos")
def _(t):
    return fieldlog.cascade(t("find_photos"), t("finds").where("id % 4 = 0"), "find_id").groupBy("find_id").agg(F.count("*").alias("n"))


@query("d1_insert", "SELECT count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM (SELECT id FROM places UNION ALL SELECT id + 10000000 FROM places)", "places")
def _(t):
    places = t("places")
    return fieldlog.insert(places, places.withColumn("id", F.col("id") + 10_000_000)).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("d2_update_delete", "SELECT id, CASE WHEN id % 3 = 0 THEN 'renamed' ELSE title END AS title, CASE WHEN id % 3 = 0 THEN true ELSE visited END AS visited FROM places WHERE id % 5 <> 0", "places")
def _(t):
    places = t("places")
    changes = places.where("id % 3 = 0").select("id", F.lit("renamed").alias("title"), F.lit(True).alias("visited"))
    return fieldlog.delete(fieldlog.update(places, changes), places.where("id % 5 = 0")).select("id", "title", "visited")


@query("d4_single_flags", "SELECT find_id, id, uri, rn = 1 AS is_primary FROM (SELECT *, row_number() OVER (PARTITION BY find_id ORDER BY is_primary DESC, created_at, id, uri) AS rn FROM find_photos)", "find_photos")
def _(t):
    return fieldlog.one_primary(t("find_photos")).select("find_id", "id", "uri", "is_primary")


@query("o4_default_detector", "SELECT id, id = 3 AS is_default, row_number() OVER (ORDER BY (id = 3) DESC, created_at, id) AS place FROM detectors", "detectors")
def _(t):
    one = fieldlog.one_default(t("detectors"))
    return one.select("id", "is_default", F.row_number().over(Window.orderBy(F.desc("is_default"), "created_at", "id")).alias("place"))


@query("d6_upgraded_tables", "SELECT 'finds' AS name, count(*) AS n, 0 AS notes FROM finds UNION ALL SELECT 'detectors', 0, 0 UNION ALL SELECT 'places', count(*), 0 FROM places", "finds", "places")
def _(t):
    spark = t("finds").sparkSession
    old = {"finds": t("finds").select("id", "lat", "lon"), "places": t("places").select("id")}
    new = fieldlog.upgrade(old, {"finds": "id long, lat double, lon double, note string", "detectors": "id long, name string, note string", "places": "id long, note string"}, spark)
    out = None
    for name, df in new.items():
        one = df.agg(F.count("*").alias("n"), F.count("note").cast("int").alias("notes")).select(F.lit(name).alias("name"), "n", "notes")
        out = one if out is None else out.unionByName(one)
    return out


@query("x3_merged_collections", "SELECT layer, count(*) AS n FROM (SELECT 'areas' AS layer FROM areas UNION ALL SELECT 'places' FROM places) GROUP BY 1", "areas", "places")
def _(t):
    merged = layers.merged_layers({"areas": t("areas").select("id", "name"), "places": t("places").select("id", "title")})
    return merged.groupBy("layer").agg(F.count("*").alias("n"))


@query("x8_seeded_presets", "SELECT name, count(*) AS n FROM (SELECT name FROM presets UNION ALL SELECT unnest(['a', 'b', 'c'])) GROUP BY 1", "presets", "detectors")
def _(t):
    seeded = fieldlog.seed_presets(t("presets").select("name", "created_at"), ["a", "b", "c"], "NEW", t("detectors"), NOW)
    again = fieldlog.seed_presets(seeded, ["d"], "NATION_3", t("detectors"), NOW)
    return again.groupBy("name").agg(F.count("*").alias("n"))
