"""Lenient enums, classes, external ids, response bodies and request addresses as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terravane.functions import geo

# The stored names and labels.
FIND_CATEGORIES = ["MINCE", "KNOFLIK", "VOJENSKE", "SPONA", "PRSTEN", "NASTROJ", "SROT", "OSTATNI"]
PLACE_TYPES = ["PLAN", "ZAJIMAVOST", "ZAKAZ", "SRAZ", "PARKOVANI"]
AREA_STATES = ["ROZPRACOVANO", "HOTOVO"]
TERRAINS = {"LES": "les", "LOUKA": "louka", "POLE": "pole", "ZAHRADA": "zahrada", "RUMISTE": "rumiště", "PLAZ": "pláž"}
SOILS = {"SUCHO": "sucho", "VLHKO": "vlhko", "MOKRO": "mokro"}
GOOD_M, OK_M = 6.0, 15.0
DRY_BELOW, WET_FROM = 0.20, 0.35
DAMP_RAIN_MM, WET_RAIN_MM = 3.0, 15.0
LEAST_TILE_BYTES, MOST_TILE_BYTES = 400, 8 * 1024 * 1024
LOCAL_KINDS, ONLINE_KINDS = ["pmtiles", "mbtiles", "geojson"], ["wms", "wmts", "xyz", "arcgis"]
AXIS_SWAPPED = ["EPSG:4326", "EPSG:2065", "EPSG:5513"]


def decode(name: Column, valid: list[str], default: str) -> Column:
    """The stored name if it is known, else the default; never null."""
    return F.when(name.isin(valid), name).otherwise(F.lit(default))


def lenient_boolean(text: Column, default: bool = False) -> Column:
    low = F.lower(text.cast("string"))
    return F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False).otherwise(F.lit(default))


def lenient_number(text: Column, kind: str, default=None) -> Column:
    return F.coalesce(F.expr("null").cast(kind) if text is None else text.try_cast(kind), F.lit(default).cast(kind))


def accuracy_class(accuracy_m: Column) -> Column:
    return F.when(accuracy_m.isNull(), "NONE").when(accuracy_m <= GOOD_M, "GOOD").when(accuracy_m <= OK_M, "OK").otherwise("POOR")


def soil_of_moisture(m: Column) -> Column:
    return F.when(m < DRY_BELOW, "SUCHO").when(m < WET_FROM, "VLHKO").otherwise("MOKRO")


def soil_of_rain(mm: Column) -> Column:
    return F.when(mm < DAMP_RAIN_MM, "SUCHO").when(mm < WET_RAIN_MM, "VLHKO").otherwise("MOKRO")


def soil_estimate(moisture: Column, rain_mm: Column) -> Column:
    """From the moisture if it is a finite number from 0 on, else from the rain, else null."""
    usable = lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf"))
    return F.when(usable(moisture), soil_of_moisture(moisture)).when(usable(rain_mm), soil_of_rain(rain_mm))


def preset_score(terrain: Column, soil: Column, wanted_terrain: Column, wanted_soil: Column) -> Column:
    same_terrain, same_soil = F.coalesce(terrain == wanted_terrain, F.lit(False)), F.coalesce(soil == wanted_soil, F.lit(False))
    return F.when(same_terrain & same_soil, 3).when(same_terrain, 2).when(same_soil, 1).otherwise(0)


def preset_reason(terrain: Column, soil: Column, wanted_terrain: Column, wanted_soil: Column) -> Column:
    """One line in Czech on what fits and what does not."""
    label = lambda c, names: F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), c)
    t, s = label(terrain, TERRAINS), label(soil, SOILS)
    score = preset_score(terrain, soil, wanted_terrain, wanted_soil)
    # The wording.
    return (
        F.when(score == 3, F.format_string("Sedí terén i stav půdy: %s, %s.", t, s))
        .when((score == 2) & wanted_soil.isNull(), F.format_string("Sedí terén (%s); stav půdy neznáme.", t))
        .when(score == 2, F.format_string("Sedí terén (%s), ale uložený je na %s.", t, s))
        .when((score == 1) & wanted_terrain.isNull(), F.format_string("Sedí stav půdy (%s); terén jsi nevybral.", s))
        .when(score == 1, F.format_string("Sedí stav půdy (%s), ale uložený je na terén %s.", s, t))
        .otherwise(F.format_string("Neodpovídá ani terénu, ani stavu půdy — uložený je na %s, %s.", t, s))
    )


def external_id(kind: str, created_at: Column, *more: Column) -> Column:
    """Content-derived identity; ``find`` and ``place`` take lat, lon, ``photo`` the uri's last part, others their own text or nothing."""
    if kind in ("find", "place"):
        return F.format_string(f"{kind}-%d-%.7f-%.7f", created_at, *more)
    if kind == "photo":
        return F.format_string("photo-%d-%s", created_at, F.substring_index(more[0], "/", -1))
    return F.format_string("-".join([kind, "%d", *["%s"] * len(more)]), created_at, *more)


def is_local(kind: Column) -> Column:
    return kind.isin(LOCAL_KINDS)


def is_online(kind: Column) -> Column:
    return kind.isin(ONLINE_KINDS)


def is_raster(kind: Column) -> Column:
    return kind != "geojson"


def tile_valid(z: Column, x: Column, y: Column, data: Column, max_zoom: int = 26) -> Column:
    side = F.pow(F.lit(2.0), z)
    return z.between(0, max_zoom) & (x >= 0) & (y >= 0) & (x < side) & (y < side) & (F.coalesce(F.octet_length(data), F.lit(0)) > 0)


def tile_cacheable(n_bytes: Column) -> Column:
    return n_bytes.between(LEAST_TILE_BYTES, MOST_TILE_BYTES)


def image_type(data: Column) -> Column:
    """By the first bytes: jpg, png, gif, webp, or none."""
    head = F.hex(F.substring(data, 1, 4))
    return F.when(head.startswith("FFD8FF"), "jpg").when(head == "89504E47", "png").when(head == "47494638", "gif").when(head == "52494646", "webp").otherwise("none")


def body_findings(kind: Column, body: Column) -> Column:
    """struct(class, detail) of a response's text by the type of its source: class OK or BAD_BODY, and why, as a code with what the body says.

    As it is specified, only the first 4,096 characters are searched for marks of services; JSON is read whole. Details: NOT_JSON,
    SERVICE_ERROR: message, LAYER: name, METADATA, EXCEPTION: text, CAPABILITIES, NO_CAPABILITIES, FEED, NO_FEED, NO_IMAGE,
    EMPTY_TILE: bytes, TILE: bytes, RECEIVED.
    """
    head = F.substring(body, 1, 4096)
    low = F.lower(head)
    bytes_ = F.octet_length(body).cast("string")
    said = lambda code, text: F.concat(F.lit(f"{code}: "), text)
    answer = lambda ok, detail: F.struct(F.lit("OK" if ok else "BAD_BODY").alias("class"), (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail"))
    field = lambda path: F.nullif(F.get_json_object(body, path), F.lit(""))
    error, name = F.get_json_object(body, "$.error"), F.coalesce(field("$.name"), field("$.mapName"), field("$.serviceDescription"))
    service = (
        F.when(F.try_parse_json(body).isNull(), answer(False, "NOT_JSON"))
        .when(error.isNotNull(), answer(False, said("SERVICE_ERROR", F.coalesce(F.get_json_object(body, "$.error.message"), error))))
        .when(name.isNotNull(), answer(True, said("LAYER", F.substring(name, 1, 60))))
        .otherwise(answer(True, "METADATA"))
    )
    image = F.hex(F.substring(body.cast("binary"), 1, 4)).rlike("^(FFD8|89504E47)")
    tile = F.when(~image, answer(False, "NO_IMAGE")).when(F.octet_length(body) <= LEAST_TILE_BYTES, answer(False, said("EMPTY_TILE", bytes_))).otherwise(answer(True, said("TILE", bytes_)))
    either = lambda test, yes, no: F.when(test, answer(True, yes)).otherwise(answer(False, no))
    text = F.trim(F.regexp_extract(head, ">([^<>]{5,120})<", 1))
    return (
        F.when(kind == "arcgis-rest", service)
        .when(low.contains("serviceexception") | low.contains("exceptionreport"), answer(False, said("EXCEPTION", F.when(text == "", "?").otherwise(text))))
        .when(kind.isin("wmts", "arcgis-wmts"), either(low.contains("capabilities"), "CAPABILITIES", "NO_CAPABILITIES"))
        .when(kind == "wms", either(low.contains("wms_capabilities") | low.contains("wmt_ms_capabilities"), "CAPABILITIES", "NO_CAPABILITIES"))
        .when(kind == "atom", either(low.contains("<feed") | low.contains("atom"), "FEED", "NO_FEED"))
        .when(kind == "xyz", tile)
        .otherwise(answer(True, "RECEIVED"))
    )


def body_class(kind: Column, body: Column) -> Column:
    """OK or BAD_BODY for a response's text by the type of its source."""
    return body_findings(kind, body)["class"]


def _query(pairs: list[tuple[str, Column | str]], encode: bool = False) -> Column:
    parts = [F.concat(F.lit(f"{k}="), F.url_encode(v) if encode and isinstance(v, Column) else v if isinstance(v, Column) else F.lit(v)) for k, v in pairs]
    return F.concat_ws("&", *parts)


def _joined(base: Column, query: Column) -> Column:
    return F.concat(base, F.when(base.endswith("?"), "").when(base.contains("?"), "&").otherwise("?"), query)


def xyz_url(template: Column, z: Column, x: Column, y: Column, subdomains: str = "abc") -> Column:
    names = F.array(*map(F.lit, subdomains)) if subdomains else F.array(F.lit(""))
    at = F.element_at(names, ((x + y) % max(len(subdomains), 1) + 1).cast("int"))
    out = template
    for key, value in (("{z}", z.cast("string")), ("{x}", x.cast("string")), ("{y}", y.cast("string")), ("{-y}", geo.tms_row(y, z).cast("string")), ("{s}", at)):
        out = F.replace(out, F.lit(key), value)
    return out


def wmts_rest_url(template: Column, z: Column, x: Column, y: Column, layer: str, matrix_set: str = "GoogleMapsCompatible") -> Column:
    out = xyz_url(template, z, x, y)
    for key, value in (("{layer}", layer), ("{tilematrixset}", matrix_set), ("{style}", "default")):
        out = F.replace(out, F.lit(key), F.lit(value))
    return out


def wmts_kvp_url(base: Column, z: Column, x: Column, y: Column, layer: str, image: str = "image/jpeg", matrix_set: str = "GoogleMapsCompatible") -> Column:
    return _joined(base, _query([("SERVICE", "WMTS"), ("REQUEST", "GetTile"), ("VERSION", "1.0.0"), ("LAYER", layer), ("STYLE", "default"), ("TILEMATRIXSET", matrix_set), ("TILEMATRIX", z.cast("string")), ("TILEROW", y.cast("string")), ("TILECOL", x.cast("string")), ("FORMAT", image)]))


def wms_url(base: Column, west: Column, south: Column, east: Column, north: Column, layers: str, crs: str = "EPSG:3857", version: str = "1.3.0", image: str = "image/png", size: int = geo.TILE_PIXELS) -> Column:
    """Axes are swapped for the systems whose 1.3.0 order is latitude first."""
    order = (south, west, north, east) if version >= "1.3.0" and crs.upper() in AXIS_SWAPPED else (west, south, east, north)
    box = F.format_string("%.9f,%.9f,%.9f,%.9f", *order)
    return _joined(base, _query([("SERVICE", "WMS"), ("REQUEST", "GetMap"), ("VERSION", version), ("LAYERS", layers), ("STYLES", ""), ("CRS" if version >= "1.3.0" else "SRS", crs), ("BBOX", box), ("WIDTH", str(size)), ("HEIGHT", str(size)), ("FORMAT", image), ("TRANSPARENT", "FALSE")]))


def export_url(base: Column, west: Column, south: Column, east: Column, north: Column, image: str = "png", size: int = geo.TILE_PIXELS) -> Column:
    root = F.regexp_replace(F.regexp_replace(base, "/+$", ""), "/export$", "")
    box = F.format_string("%.6f,%.6f,%.6f,%.6f", west, south, east, north)
    return F.concat(root, F.lit("/export?"), _query([("bbox", box), ("bboxSR", "3857"), ("imageSR", "3857"), ("size", f"{size},{size}"), ("format", image), ("transparent", "false"), ("f", "image")]))


def warp_method(n_points: Column) -> Column:
    return F.when(n_points >= 6, "tps").when(n_points >= 3, "polynomial").otherwise("too_few")
