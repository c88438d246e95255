"""GeoJSON, GPX, feeds, hourly weather, control points and catalogues: readers to DataFrames and writers to text rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terravane.functions import geo
from terravane.operators.blocks import BLOCK
from terravane.operators.fieldlog import nested

_POINT = "array<double>"
_POLYGON = "array<array<array<double>>>"
_MULTI = "array<array<array<array<double>>>>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc): whole files as text, one row each; for files of a bounded size."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("doc"))


def features(documents: DataFrame, doc: str = "doc") -> DataFrame:
    """The features of collections in a text column: the other columns, feature_ord, type, coordinates (JSON text), properties (map). Malformed documents have none."""
    rest = [c for c in documents.columns if c != doc]
    parsed = documents.withColumn("__p", F.from_json(doc, "struct<type:string,features:array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>>", {"mode": "PERMISSIVE"}))
    each = parsed.select(*rest, F.posexplode("__p.features").alias("feature_ord", "f"))
    return each.select(*rest, "feature_ord", F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


def _ring(points: Column) -> Column:
    """[lon, lat] pairs to structs; points with fewer coordinates are skipped."""
    return F.transform(F.filter(points, lambda p: F.size(p) >= 2), lambda p: F.struct(p[1].alias("lat"), p[0].alias("lon")))


def polygons(documents: DataFrame, doc: str = "doc") -> DataFrame:
    """(…, poly_ord, rings, properties, west, south, east, north): a row for each part of Polygon and MultiPolygon features whose outer ring has three points.

    ``poly_ord`` orders the parts of one document; over several documents, order by their own columns first.
    """
    each = features(documents, doc)
    rest = [c for c in each.columns if c not in ("feature_ord", "type", "coordinates", "properties")]
    parts = F.when(F.col("type") == "MultiPolygon", F.from_json("coordinates", _MULTI)).when(F.col("type") == "Polygon", F.array(F.from_json("coordinates", _POLYGON)))
    each = each.select(*rest, "feature_ord", "properties", F.posexplode(parts).alias("part_ord", "part"))
    rings = F.filter(F.transform("part", _ring), lambda r: F.size(r) >= 3)
    outer = F.size(F.get(F.transform("part", _ring), F.lit(0))) >= 3
    each = each.withColumn("rings", rings).where(outer)
    b = geo.ring_bounds(F.slice("rings", 1, 1))
    return each.select(*rest, (F.col("feature_ord").cast("long") * 2**31 + F.col("part_ord")).alias("poly_ord"), "rings", "properties", *[b[n].alias(n) for n in ("west", "south", "east", "north")])


def points(documents: DataFrame, doc: str = "doc") -> tuple[DataFrame, DataFrame]:
    """(points with lon, lat, altitude; features without two coordinates)."""
    each = features(documents, doc).withColumn("c", F.from_json("coordinates", _POINT))
    good = (F.col("type") == "Point") & (F.size("c") >= 2)
    rest = [c for c in each.columns if c not in ("type", "coordinates", "c")]
    found = each.where(good).select(*rest, F.get("c", F.lit(0)).alias("lon"), F.get("c", F.lit(1)).alias("lat"), F.get("c", F.lit(2)).alias("altitude"))
    return found, each.where(~F.coalesce(good, F.lit(False))).select(*rest, "type", "coordinates")


def point_feature(lat: Column, lon: Column, altitude: Column, properties: Column) -> Column:
    """GeoJSON text of a point; the altitude is a third coordinate where there is one."""
    coordinates = F.when(altitude.isNull(), F.array(lon, lat)).otherwise(F.array(lon, lat, altitude))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), coordinates.alias("coordinates")).alias("geometry"), properties.alias("properties")))


def finds_features(finds: DataFrame, photos: DataFrame, most: int = BLOCK) -> DataFrame:
    """(id, block, feature): finds with their photos nested, newline-delimited GeoJSON when written as text. A find of more than ``most`` photos goes on in further blocks."""
    joined = nested(finds, photos.select("find_id", "created_at", "uri", "is_primary"), "id", "find_id", ["created_at", "uri", "is_primary"], "photos", most)
    properties = F.struct(F.col("id"), F.col("title"), F.col("category"), F.col("created_at").alias("createdAt"), F.col("depth_cm").alias("depthCm"), F.col("favorite"), F.col("photos"))
    altitude = F.col("altitude") if "altitude" in finds.columns else F.lit(None).cast("double")
    return joined.select("id", "block", point_feature(F.col("lat"), F.col("lon"), altitude, properties).alias("feature"))


def places_features(places: DataFrame) -> DataFrame:
    """(id, feature) of places (id, lat, lon, type, title, created_at, visited and, where known, external_id, note, visited_at)."""
    known = {"external_id": "externalId", "note": "note", "visited_at": "visitedAt"}
    properties = F.struct("id", "type", "title", F.col("created_at").alias("createdAt"), "visited", *[F.col(c).alias(n) for c, n in known.items() if c in places.columns])
    return places.select("id", point_feature(F.col("lat"), F.col("lon"), F.lit(None).cast("double"), properties).alias("feature"))


def ring_to_geojson(ring: Column) -> Column:
    """Text of a Polygon with one ring, closed if it was open."""
    first, last = F.element_at(ring, 1), F.element_at(ring, -1)
    closed = F.when((first["lat"] == last["lat"]) & (first["lon"] == last["lon"]), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))
    return F.when(F.size(ring) >= 3, F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(closed, lambda p: F.array(p["lon"], p["lat"]))).alias("coordinates"))))


def geojson_to_ring(text: Column) -> Column:
    """The outer ring of a Polygon's text, open (its closing point left out); null for anything else."""
    parsed = F.from_json(text, f"struct<type:string,coordinates:{_POLYGON}>")
    ring = _ring(F.get(parsed["coordinates"], F.lit(0)))
    first, last = F.get(ring, F.lit(0)), F.element_at(ring, -1)
    opened = F.when((F.size(ring) > 1) & (first["lat"] == last["lat"]) & (first["lon"] == last["lon"]), F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0)))).otherwise(ring)
    return F.when((parsed["type"] == "Polygon") & (F.size(ring) > 0), opened)


def usable_line(points_: DataFrame, key: str = "track_id") -> DataFrame:
    """Points of the keys that have at least two of them: fewer make no line."""
    n = points_.groupBy(key).agg(F.count("*").alias("__n")).where("__n >= 2").select(key)
    return points_.hint("merge").join(n.hint("merge"), key, "left_semi")


def areas_features(areas: DataFrame) -> DataFrame:
    """(id, feature) of areas (id, name, status, area_ha, polygon_geojson); a geometry that is no JSON stays as ``polygonRaw``."""
    parsed = F.try_parse_json("polygon_geojson")
    properties = F.struct("id", "name", "status", F.col("area_ha").alias("areaHa"), F.when(parsed.isNull(), F.col("polygon_geojson")).alias("polygonRaw"))
    return areas.select("id", F.concat(F.lit('{"type":"Feature","geometry":'), F.when(parsed.isNull(), "null").otherwise(F.col("polygon_geojson")), F.lit(',"properties":'), F.to_json(properties), F.lit("}")).alias("feature"))


_HEAD, _TAIL = '{"type":"FeatureCollection","features":[', "]}"


def write_collection(features_: DataFrame, path: str, *order: str, feature: str = "feature") -> None:
    """Writes features (text) as one collection: its files, one behind the other by name, are one valid document, with a feature on each line.

    Files are ranges of ``order``, which has to be one without ties. The first one begins with the head, the last one ends with the tail, and
    all features but the first have a comma before them; nothing is collected. Without features it is an empty collection.
    """
    n = int(features_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = features_.where(F.col(feature).isNotNull()).select(F.lit(1).alias("__part"), *order, F.col(feature).alias("value"))
    first = rows.agg(F.min(F.struct(*order)).alias("__first"))
    lines = rows.join(F.broadcast(first)).withColumn("value", F.concat(F.when(F.struct(*order) == F.col("__first"), "").otherwise(","), F.col("value"))).drop("__first")  # one row
    frame = features_.sparkSession.createDataFrame([(0, _HEAD), (2, _TAIL)], "__part int, value string")
    framed = lines.unionByName(frame, allowMissingColumns=True)
    framed.repartitionByRange(n, "__part", *order).sortWithinPartitions("__part", *order).select("value").write.text(path)


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """(doc): each feature of a collection of ``write_collection`` as a collection of its own, for ``polygons``, ``points`` and ``features``."""
    lines = spark.read.text(path).where(~F.col("value").isin(_HEAD, _TAIL))
    return lines.select(F.concat(F.lit(_HEAD), F.regexp_replace("value", "^,", ""), F.lit(_TAIL)).alias("doc"))


#: Tables that a manifest counts.
COUNTED = ["finds", "photos", "places", "areas", "tracks", "track_points", "calibrations", "gcp_sets", "gcp_points"]


def manifest(tables: dict[str, DataFrame], files: DataFrame | None = None) -> DataFrame:
    """One row: the count of each of COUNTED (0 for a table that is not given), ``missing_photos``: photos whose uri is not among ``files`` (uri), schema and format version."""
    counted = [tables[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in COUNTED if n in tables]
    if files is not None and "photos" in tables:
        lost = tables["photos"].select("uri").hint("merge").join(files.select("uri").distinct().hint("merge"), "uri", "left_anti")
        counted.append(lost.agg(F.count("*").alias("n")).select(F.lit("missing_photos").alias("name"), "n"))
    rows = reduce(DataFrame.unionByName, counted)
    of = lambda n: F.coalesce(F.max(F.when(F.col("name") == n, F.col("n"))), F.lit(0)).alias(n)
    return rows.agg(*map(of, [*COUNTED, "missing_photos"])).select("*", F.lit(2).alias("schema_version"), F.lit(1).alias("format_version"))


def calibration_rows(calibrations: DataFrame) -> DataFrame:
    """(id, row): calibrations as JSON text, with the matrix as an array of six."""
    known = {"external_id": "externalId", "label": "label", "created_at": "createdAt", "updated_at": "updatedAt"}
    row = F.struct("id", F.col("layer_id").alias("layerId"), "west", "south", "east", "north", F.array("a", "b", "tx", "c", "d", "ty").alias("matrix"), "active", *[F.col(c).alias(n) for c, n in known.items() if c in calibrations.columns])
    return calibrations.select("id", F.to_json(row).alias("row"))


def read_calibrations(rows: DataFrame, row: str = "row") -> DataFrame:
    """The same back: (id, layer_id, west, south, east, north, a, b, tx, c, d, ty, active); rows that are no such JSON, or without six numbers, are left out."""
    kind = "id bigint, layerId string, west double, south double, east double, north double, matrix array<double>, active boolean"
    parsed = rows.select(F.from_json(row, kind).alias("r")).where(F.size("r.matrix") == 6)
    return parsed.select("r.id", F.col("r.layerId").alias("layer_id"), *[f"r.{c}" for c in ("west", "south", "east", "north")], *[F.get("r.matrix", F.lit(k)).alias(c) for k, c in enumerate(("a", "b", "tx", "c", "d", "ty"))], "r.active")


def control_sets(sets: DataFrame, points_: DataFrame, most: int = BLOCK) -> DataFrame:
    """Sets with their points nested in order of id, in blocks of at most ``most``."""
    return nested(sets, points_.select("set_id", "id", "src_x", "src_y", "dst_x", "dst_y"), "id", "set_id", ["id"], "points", most)


def control_points_lonlat(points_: DataFrame) -> DataFrame:
    """Control points with their targets in degrees."""
    where = geo.from_mercator(F.col("dst_x"), F.col("dst_y"))
    return points_.select("set_id", "id", F.col("src_x").alias("px"), F.col("src_y").alias("py"), where["lon"].alias("lon"), where["lat"].alias("lat"))


CONTROL = "image string, width int, height int, points array<struct<px:double,py:double,lon:double,lat:double>>"


def validate_control(rows: DataFrame) -> DataFrame:
    """Control-point documents (CONTROL) with ``errors``: an array of codes, empty where the document is good."""
    bad = lambda test: F.exists("points", test)
    n = F.coalesce(F.size("points"), F.lit(0))
    rules = [
        ("NO_IMAGE", F.col("image").isNull()),
        ("BAD_SIZE", ~F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False))),
        ("FEW_POINTS", n < 3),
        ("INCOMPLETE", bad(lambda p: p["px"].isNull() | p["py"].isNull() | p["lon"].isNull() | p["lat"].isNull())),
        ("BAD_LONLAT", bad(lambda p: (F.abs(p["lon"]) > 180) | (F.abs(p["lat"]) > 90))),
        ("OUTSIDE", bad(lambda p: (p["px"] < 0) | (p["py"] < 0) | (p["px"] > F.col("width")) | (p["py"] > F.col("height")))),
    ]
    return rows.withColumn("errors", F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), code) for code, test in rules])))


def _escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def _iso(ms: Column) -> Column:
    """UTC whatever the session's zone is."""
    second = F.floor(ms / 1000)
    part = lambda unit, n: F.lpad((F.floor(second / unit) % n).cast("string"), 2, "0")
    return F.concat(F.date_from_unix_date(F.floor(second / 86_400).cast("int")).cast("string"), F.lit("T"), part(3600, 24), F.lit(":"), part(60, 60), F.lit(":"), part(1, 60), F.lit("Z"))


def _tags(row: Column, names: dict[str, str], there: Sequence[str]) -> Column:
    """Elements dm:name of a struct's fields, where it has them and they are not null."""
    one = lambda c, n: F.coalesce(F.concat(F.lit(f"<dm:{n}>"), row[c].cast("string"), F.lit(f"</dm:{n}>")), F.lit(""))
    return F.concat(F.lit("<extensions>"), *[one(c, n) for c, n in names.items() if c in there], F.lit("</extensions>"))


_TRACK_TAGS = {"id": "id", "started_at": "startedAt", "ended_at": "endedAt", "distance_m": "distanceM", "duration_ms": "durationMs", "point_count": "pointCount"}
_POINT_TAGS = {"ts": "timestamp", "accuracy_m": "accuracyM", "speed_ms": "speedMs"}


def gpx(tracks: DataFrame, points_: DataFrame, exact: bool = False, most: int = BLOCK) -> DataFrame:
    """(track_id, block, gpx): documents of tracks (id, name, started_at, ended_at and more) with their points (ts, id, lat, lon, and altitude, accuracy_m, speed_ms where known) sorted by (ts, id).

    A track of more than ``most`` points goes on in further documents of the same name. ``exact`` keeps all digits and adds the
    extension fields that a round trip needs; else coordinates have 7 decimals, altitudes 2 and times whole seconds, and the
    document's time is the track's ``created_at`` where there is one, else that of its first point.
    """
    columns = ["ts", "id", "lat", "lon", *[c for c in ("altitude", "accuracy_m", "speed_ms") if c in points_.columns]]
    documents = nested(tracks, points_.select("track_id", *columns), "id", "track_id", ["ts", "id"], "p", most)

    def vertex(p: Column) -> Column:
        number = lambda c, digits: p[c].cast("string") if exact else F.format_string(f"%.{digits}f", p[c])
        height = [F.coalesce(F.concat(F.lit("<ele>"), number("altitude", 2), F.lit("</ele>")), F.lit(""))] if "altitude" in columns else []
        height = [F.when(p["altitude"].isNotNull(), height[0]).otherwise("")] if height else []
        extension = [_tags(p, _POINT_TAGS, columns)] if exact else []
        return F.concat(F.lit('<trkpt lat="'), number("lat", 7), F.lit('" lon="'), number("lon", 7), F.lit('">'), *height, F.lit("<time>"), _iso(p["ts"]), F.lit("</time>"), *extension, F.lit("</trkpt>"))

    first = F.get(F.col("p"), F.lit(0))["ts"]
    stamp = F.col("started_at") if exact else F.coalesce(*([F.col("created_at")] if "created_at" in tracks.columns else []), first)
    extra = [_tags(F.struct(*[c for c in _TRACK_TAGS if c in tracks.columns]), _TRACK_TAGS, tracks.columns)] if exact else []
    head = F.lit('<gpx version="1.1" creator="terravane" xmlns="http://www.topografix.com/GPX/1/1" xmlns:dm="urn:dm"><metadata><name>')
    name = _escaped(F.coalesce("name", F.lit("")))
    time = F.coalesce(F.concat(F.lit("<time>"), _iso(stamp), F.lit("</time>")), F.lit(""))
    text = F.concat(head, name, F.lit("</name>"), time, F.lit("</metadata><trk><name>"), name, F.lit("</name>"), *extra, F.lit("<trkseg>"), F.array_join(F.transform("p", vertex), ""), F.lit("</trkseg></trk></gpx>"))
    return documents.select(F.col("id").alias("track_id"), "block", text.alias("gpx"))


_TRK = (
    "struct<trk:array<struct<name:string,extensions:struct<`dm:startedAt`:bigint,`dm:endedAt`:bigint,`dm:distanceM`:double>,"
    "trkseg:array<struct<trkpt:array<struct<_lat:double,_lon:double,ele:double,time:string,extensions:struct<`dm:timestamp`:bigint,`dm:accuracyM`:double,`dm:speedMs`:double>>>>>>>>"
)


def read_gpx(documents: DataFrame, doc: str = "doc") -> tuple[DataFrame, DataFrame]:
    """(tracks, points) of GPX texts, each document's first track: points sorted by time; the extension's times win over ISO ones, else 0. Unreadable documents have none."""
    rest = [c for c in documents.columns if c != doc]
    parsed = documents.select(*rest, F.from_xml(doc, _TRK, {"mode": "PERMISSIVE"}).alias("g")).select(*rest, F.get("g.trk", F.lit(0)).alias("t")).where("t IS NOT NULL")
    all_points = F.flatten(F.transform(F.col("t.trkseg"), lambda s: F.coalesce(s["trkpt"], F.array())))
    stamp = lambda p: F.coalesce(p["extensions"]["dm:timestamp"], F.unix_millis(F.try_to_timestamp(p["time"])), F.lit(0))
    usable = F.filter(all_points, lambda p: p["_lat"].isNotNull() & p["_lon"].isNotNull())
    one = lambda p: F.struct(stamp(p).alias("ts"), p["_lat"].alias("lat"), p["_lon"].alias("lon"), p["ele"].alias("altitude"), p["extensions"]["dm:accuracyM"].alias("accuracy_m"), p["extensions"]["dm:speedMs"].alias("speed_ms"))
    rows = parsed.select(*rest, F.col("t.name").alias("name"), F.col("t.extensions").alias("x"), F.array_sort(F.transform(usable, one)).alias("p"))
    times = F.transform("p", lambda p: p["ts"])
    tracks = rows.select(*rest, "name", F.coalesce("x.`dm:startedAt`", F.array_min(times)).alias("started_at"), F.coalesce("x.`dm:endedAt`", F.array_max(times)).alias("ended_at"), F.coalesce("x.`dm:distanceM`", F.lit(0.0)).alias("distance_m"), F.size("p").alias("point_count"))
    return tracks, rows.select(*rest, F.posexplode("p").alias("ord", "v")).select(*rest, "ord", "v.*")


HOURLY = "struct<hourly:struct<time:array<bigint>,soil_moisture_3_to_9cm:array<double>,precipitation:array<double>>>"


def hourly(documents: DataFrame, doc: str = "doc") -> DataFrame:
    """(…, time, moisture, rain) of weather payloads with parallel arrays; holes stay null."""
    rest = [c for c in documents.columns if c != doc]
    h = documents.select(*rest, F.from_json(doc, HOURLY).alias("w")).select(*rest, "w.hourly.*")
    zipped = F.arrays_zip(F.col("time"), F.col("soil_moisture_3_to_9cm").alias("moisture"), F.col("precipitation").alias("rain"))
    return h.select(*rest, F.explode(zipped).alias("z")).select(*rest, F.col("z.time").alias("time"), F.col("z.moisture").alias("moisture"), F.col("z.rain").alias("rain")).where("time IS NOT NULL")


def paged_features(pages: DataFrame, most: int, page_size: int) -> tuple[DataFrame, DataFrame]:
    """(features, runs) of pages (run, offset, exceeded, features: array): pages by offset up to the first short one, at most ``most`` features of a run; a run is complete if such a page came."""
    w = Window.partitionBy("run").orderBy("offset")
    last = (F.size("features") < page_size) & ~F.coalesce("exceeded", F.lit(False))
    ended = F.coalesce(F.max(last.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    used = pages.withColumn("last", last).withColumn("ended", ended).where("ended = 0")
    before = F.coalesce(F.sum(F.size("features")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = used.withColumn("before", before).select("run", "offset", "before", F.posexplode("features").alias("ord", "feature"))
    found = each.where(F.col("before") + F.col("ord") < most).select("run", "offset", "ord", "feature")
    return found, used.groupBy("run").agg(F.bool_or("last").alias("complete"), F.sum(F.size("features")).alias("features"))


_ENTRY = "struct<title:string,link:array<struct<_href:string,_type:string>>,`georss:box`:string,`georss:polygon`:string>"


def feed_entries(documents: DataFrame, doc: str = "doc") -> DataFrame:
    """(…, title, url, kind, west, south, east, north) of ATOM feeds: files by their ending, nested feeds by their type; boxes from georss, latitude first."""
    rest = [c for c in documents.columns if c != doc]
    e = documents.select(*rest, F.explode(F.from_xml(doc, f"struct<entry:array<{_ENTRY}>>")["entry"]).alias("e"))
    numbers = F.transform(F.split(F.trim(F.coalesce(F.col("e.`georss:box`"), F.col("e.`georss:polygon`"))), r"[\s,]+"), lambda s: s.try_cast("double"))
    lats, lons = F.filter(numbers, lambda v, i: i % 2 == 0), F.filter(numbers, lambda v, i: i % 2 == 1)
    each = e.select(*rest, F.col("e.title").alias("title"), numbers.alias("n"), lats.alias("lats"), lons.alias("lons"), F.explode("e.link").alias("l"))
    url = F.col("l._href")
    kind = F.when(F.lower(url).rlike(r"\.(laz|las|zip|7z)$"), "file").when(F.col("l._type").contains("atom") | F.lower(url).endswith(".xml"), "feed")
    boxed = F.size("n") >= 4
    box = {"west": F.array_min("lons"), "south": F.array_min("lats"), "east": F.array_max("lons"), "north": F.array_max("lats")}
    return each.select(*rest, "title", url.alias("url"), kind.alias("kind"), *[F.when(boxed, v).alias(k) for k, v in box.items()]).where("kind IS NOT NULL")


LAYERS = "version int, layers array<struct<id:string,title:string,kind:string,visible:boolean,opacity:double,minZoom:int,maxZoom:int,attribution:string>>"


def layer_catalogue(rows: DataFrame) -> DataFrame:
    """(version, ord, layer_id, title, kind, visible, opacity, min_zoom, max_zoom, attribution) of catalogue documents (LAYERS), defaults filled in."""
    each = rows.select("version", F.posexplode("layers").alias("ord", "l"))
    default = lambda c, v: F.coalesce(F.col(f"l.{c}"), F.lit(v))
    return each.select(
        "version", "ord", F.col("l.id").alias("layer_id"), F.coalesce("l.title", "l.id").alias("title"), default("kind", "xyz").alias("kind"), default("visible", False).alias("visible"),
        default("opacity", 1.0).alias("opacity"), default("minZoom", 0).alias("min_zoom"), default("maxZoom", 22).alias("max_zoom"), default("attribution", "").alias("attribution"),
    )
