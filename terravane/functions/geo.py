"""Geodesy and Web Mercator as Column expressions; every function takes Columns (or numbers) and returns a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_RADIUS_M = 6371008.8
ORIGIN_SHIFT = 20037508.342789244
MAX_LATITUDE = 85.05112878
TILE_PIXELS = 256
COMPASS = ["S", "SV", "V", "JV", "J", "JZ", "Z", "SZ"]
EDGE = 1e-9


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def distance_m(lat1, lon1, lat2, lon2) -> Column:
    """Haversine distance in metres."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    return F.atan2(F.sqrt(a), F.sqrt(1 - a)) * (2 * EARTH_RADIUS_M)


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing from north, 0 to 360."""
    p1, p2, dl = F.radians(_c(lat1)), F.radians(_c(lat2)), F.radians(_c(lon2) - _c(lon1))
    y = F.sin(dl) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def compass_label(bearing) -> Column:
    """One of eight labels; halves round up."""
    eighth = F.floor(F.pmod(_c(bearing), F.lit(360.0)) / 45.0 + 0.5) % 8
    return F.element_at(F.array(*map(F.lit, COMPASS)), (eighth + 1).cast("int"))


def heading_difference(a, b) -> Column:
    """Angle between two headings, 0 to 180."""
    d = F.pmod(_c(a) - _c(b), F.lit(360.0))
    return F.least(d, 360.0 - d)


def navigation_hint(lat, lon, to_lat, to_lon) -> Column:
    """struct(distance_m, bearing, label) to a target."""
    bearing = bearing_deg(lat, lon, to_lat, to_lon)
    return F.struct(distance_m(lat, lon, to_lat, to_lon).alias("distance_m"), bearing.alias("bearing"), compass_label(bearing).alias("label"))


def sun_times(lat, lon, epoch_day) -> Column:
    """struct(rise, set) in epoch milliseconds by a public low-precision approximation; null in polar day and night."""
    lat, lon = _c(lat), _c(lon)
    j = _c(epoch_day) - 10957 - lon / 360.0
    m = F.radians((F.lit(357.5291) + j * 0.98560028) % 360.0)
    centre = F.sin(m) * 1.9148 + F.sin(m * 2) * 0.02 + F.sin(m * 3) * 0.0003
    ecliptic = F.radians((F.degrees(m) + centre + 180.0 + 102.9372) % 360.0)
    transit = j + 2451545.0 + F.sin(m) * 0.0053 - F.sin(ecliptic * 2) * 0.0069
    declination = F.asin(F.sin(ecliptic) * F.sin(F.radians(F.lit(23.4397))))
    cos_hour = (F.sin(F.radians(F.lit(-0.833))) - F.sin(F.radians(lat)) * F.sin(declination)) / (F.cos(F.radians(lat)) * F.cos(declination))
    hour = F.degrees(F.acos(cos_hour)) / 360.0
    millis = lambda day: ((day - 2440587.5) * 86_400_000.0).cast("long")
    return F.when(cos_hour.between(-1.0, 1.0), F.struct(millis(transit - hour).alias("rise"), millis(transit + hour).alias("set")))


def daylight_left(sunset, now) -> Column:
    return F.greatest(F.lit(0).cast("long"), _c(sunset) - _c(now))


def to_mercator(lat, lon) -> Column:
    """struct(x, y) in EPSG:3857 metres; the latitude is clamped."""
    lat = F.greatest(F.least(_c(lat), F.lit(MAX_LATITUDE)), F.lit(-MAX_LATITUDE))
    x = _c(lon) * ORIGIN_SHIFT / 180.0
    y = F.log(F.tan((lat + 90.0) * (3.141592653589793 / 360.0))) / (3.141592653589793 / 180.0) * ORIGIN_SHIFT / 180.0
    return F.struct(x.alias("x"), y.alias("y"))


def from_mercator(x, y) -> Column:
    """struct(lat, lon)."""
    lat = F.degrees(F.atan(F.sinh(_c(y) / EQUATOR_RADIUS)))
    return F.struct(lat.alias("lat"), (_c(x) / ORIGIN_SHIFT * 180.0).alias("lon"))


EQUATOR_RADIUS = 6378137.0


def resolution(z) -> Column:
    """Metres of a pixel."""
    return F.lit(2 * ORIGIN_SHIFT / TILE_PIXELS) / F.pow(F.lit(2.0), _c(z))


def tile_span(z) -> Column:
    return F.lit(2 * ORIGIN_SHIFT) / F.pow(F.lit(2.0), _c(z))


def _side(z) -> Column:
    return F.pow(F.lit(2.0), _c(z)).cast("long")


def tile_x(lon, z) -> Column:
    n = _side(z)
    return F.greatest(F.lit(0).cast("long"), F.least(n - 1, F.floor((_c(lon) + 180.0) / 360.0 * n))).cast("int")


def tile_y(lat, z) -> Column:
    n = _side(z)
    lat = F.greatest(F.least(_c(lat), F.lit(MAX_LATITUDE)), F.lit(-MAX_LATITUDE))
    r = F.radians(lat)
    unit = (1.0 - F.log(F.tan(r) + 1.0 / F.cos(r)) / 3.141592653589793) / 2.0
    return F.greatest(F.lit(0).cast("long"), F.least(n - 1, F.floor(unit * n))).cast("int")


def tile_bounds_m(x, y, z) -> Column:
    """struct(min_x, min_y, max_x, max_y) in metres."""
    x, y, span = _c(x), _c(y), tile_span(z)
    return F.struct(
        (x * span - ORIGIN_SHIFT).alias("min_x"), (F.lit(ORIGIN_SHIFT) - (y + 1) * span).alias("min_y"), ((x + 1) * span - ORIGIN_SHIFT).alias("max_x"), (F.lit(ORIGIN_SHIFT) - y * span).alias("max_y")
    )


def tile_bounds_deg(x, y, z) -> Column:
    """struct(west, south, east, north) in degrees."""
    b = tile_bounds_m(x, y, z)
    low, high = from_mercator(b["min_x"], b["min_y"]), from_mercator(b["max_x"], b["max_y"])
    return F.struct(low["lon"].alias("west"), low["lat"].alias("south"), high["lon"].alias("east"), high["lat"].alias("north"))


def pixel_of_mercator(x, y, z) -> Column:
    """struct(px, py) of the whole world's picture at a zoom."""
    return F.struct(((_c(x) + ORIGIN_SHIFT) / resolution(z)).alias("px"), ((F.lit(ORIGIN_SHIFT) - _c(y)) / resolution(z)).alias("py"))


def mercator_of_pixel(px, py, z) -> Column:
    return F.struct((_c(px) * resolution(z) - ORIGIN_SHIFT).alias("x"), (F.lit(ORIGIN_SHIFT) - _c(py) * resolution(z)).alias("y"))


def tile_range(west, south, east, north, z) -> Column:
    """struct(x0, y0, x1, y1) of the tiles that a box covers; a tile that it only touches at an edge is left out."""
    n = _side(z)
    fx = lambda lon: (_c(lon) + 180.0) / 360.0 * n
    lat_unit = lambda lat: (1.0 - F.log(F.tan(F.radians(lat)) + 1.0 / F.cos(F.radians(lat))) / 3.141592653589793) / 2.0 * n
    clamp = lambda lat: F.greatest(F.least(_c(lat), F.lit(MAX_LATITUDE)), F.lit(-MAX_LATITUDE))
    inside = lambda v: F.greatest(F.lit(0).cast("long"), F.least(n - 1, v)).cast("int")
    x0, y0 = inside(F.floor(fx(west) + EDGE)), inside(F.floor(lat_unit(clamp(north)) + EDGE))
    x1, y1 = inside(F.ceil(fx(east) - EDGE) - 1), inside(F.ceil(lat_unit(clamp(south)) - EDGE) - 1)
    return F.struct(x0.alias("x0"), y0.alias("y0"), F.greatest(x0, x1).alias("x1"), F.greatest(y0, y1).alias("y1"))


def tms_row(y, z) -> Column:
    return F.pow(F.lit(2.0), _c(z)).cast("int") - 1 - _c(y)


def box_contains(west, south, east, north, lat, lon) -> Column:
    return _c(lat).between(_c(south), _c(north)) & _c(lon).between(_c(west), _c(east))


def boxes_intersect(a: dict, b: dict) -> Column:
    """Edges count. Both are mappings of west, south, east, north to Columns."""
    return (_c(a["west"]) <= b["east"]) & (_c(b["west"]) <= a["east"]) & (_c(a["south"]) <= b["north"]) & (_c(b["south"]) <= a["north"])


def box_struct(west, south, east, north) -> Column:
    return F.struct(_c(west).alias("west"), _c(south).alias("south"), _c(east).alias("east"), _c(north).alias("north"))


def box_centre(box: Column) -> Column:
    """struct(lat, lon)."""
    return F.struct(((box["south"] + box["north"]) / 2).alias("lat"), ((box["west"] + box["east"]) / 2).alias("lon"))


def box_width(box: Column) -> Column:
    return box["east"] - box["west"]


def box_area(box: Column) -> Column:
    """Square degrees."""
    return box_width(box) * (box["north"] - box["south"])


def box_expand(box: Column, factor) -> Column:
    """The box grown about its centre by a factor."""
    cx, cy = (box["west"] + box["east"]) / 2, (box["south"] + box["north"]) / 2
    w, h = (box["east"] - box["west"]) * factor / 2, (box["north"] - box["south"]) * factor / 2
    return box_struct(cx - w, cy - h, cx + w, cy + h)


def box_at_least(box: Column, degrees) -> Column:
    """The box grown about its centre to at least this width and height."""
    cx, cy = (box["west"] + box["east"]) / 2, (box["south"] + box["north"]) / 2
    w, h = F.greatest(box["east"] - box["west"], _c(degrees)) / 2, F.greatest(box["north"] - box["south"], _c(degrees)) / 2
    return box_struct(cx - w, cy - h, cx + w, cy + h)


def ring_area_ha(ring: Column) -> Column:
    """Shoelace area of an array of struct(lat, lon) in a local frame at the mean latitude and the first point; under three points: 0."""
    n = F.size(ring)
    mean = F.aggregate(ring, F.lit(0.0), lambda s, p: s + p["lat"]) / n
    by_lat = F.lit(111_132.92) - F.cos(F.radians(mean) * 2) * 559.82
    by_lon = F.cos(F.radians(mean)) * 111_412.84
    following = F.concat(F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(ring, F.lit(1), F.lit(1)))
    # products of whole coordinates are large and nearly cancel out
    origin = F.get(ring, F.lit(0))
    east, north = lambda p: p["lon"] - origin["lon"], lambda p: p["lat"] - origin["lat"]
    doubled = F.aggregate(F.zip_with(ring, following, lambda p, q: east(p) * north(q) - east(q) * north(p)), F.lit(0.0), lambda s, x: s + x)
    return F.when(n >= 3, F.abs(doubled * by_lat * by_lon) / 2.0 / 10_000.0).otherwise(F.lit(0.0))


def _directions(corners: int) -> Column:
    """An array of (cos, sin) of a circle's corners + 1 directions: constants, worked out once for a plan."""
    step = 2 * 3.141592653589793 / corners
    return F.array(*[F.struct(F.cos(F.lit(k) * step).alias("cos"), F.sin(F.lit(k) * step).alias("sin")) for k in range(corners + 1)])


def accuracy_circle(lat, lon, accuracy_m, corners: int = 48) -> Column:
    """Closed ring of corners + 1 points at the accuracy's distance; null at a metre or less."""
    lat, lon, r = _c(lat), _c(lon), _c(accuracy_m).cast("double")

    def point(d: Column) -> Column:
        return F.struct((lat + r * d["cos"] / 111_132.0).alias("lat"), (lon + r * d["sin"] / (F.cos(F.radians(lat)) * 111_320.0)).alias("lon"))

    return F.when(r > 1.0, F.transform(_directions(corners), point))


def ring_distances_m(ring, lat, lon, cos_lat) -> Column:
    """Sum of ``distance_m`` from a point to those of a ring, each step worked out once; ``cos_lat`` is the cosine of ``lat``, best a column of its own."""
    lat, lon, cos_lat = _c(lat), _c(lon), _c(cos_lat)
    halves = F.transform(_c(ring), lambda p: F.struct(F.sin(F.radians(p["lat"] - lat) / 2).alias("y"), F.sin(F.radians(p["lon"] - lon) / 2).alias("x"), F.cos(F.radians(p["lat"])).alias("c")))
    squares = F.transform(halves, lambda h: h["y"] * h["y"] + cos_lat * h["c"] * h["x"] * h["x"])
    return F.aggregate(squares, F.lit(0.0), lambda s, a: s + F.atan2(F.sqrt(a), F.sqrt(1 - a)) * (2 * EARTH_RADIUS_M))


def ring_bounds(rings: Column) -> Column:
    """struct(west, south, east, north) of all points of an array of rings; null without points."""
    points = F.flatten(rings)
    lats, lons = F.transform(points, lambda p: p["lat"]), F.transform(points, lambda p: p["lon"])
    return F.when(F.size(points) > 0, box_struct(F.array_min(lons), F.array_min(lats), F.array_max(lons), F.array_max(lats)))
