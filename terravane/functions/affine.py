"""Affine transforms as struct(a, b, tx, c, d, ty): x' = a x + b y + tx, y' = c x + d y + ty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terravane.functions import geo

SINGULAR = 1e-12
NAMES = ["a", "b", "tx", "c", "d", "ty"]
# Fixed values of what counts as a change at all.
ROTATION_NOTED_DEG, SCALE_NOTED = 0.05, 0.001
NEGLIGIBLE_PIXELS = 0.25
MAX_SOURCE_TILES = 25


def transform(*values) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).alias(n) for n, v in zip(NAMES, values, strict=True)])


def identity() -> Column:
    return transform(1.0, 0.0, 0.0, 0.0, 1.0, 0.0)


def apply_x(t: Column, x, y) -> Column:
    return t["a"] * x + t["b"] * y + t["tx"]


def apply_y(t: Column, x, y) -> Column:
    return t["c"] * x + t["d"] * y + t["ty"]


def determinant(t: Column) -> Column:
    return t["a"] * t["d"] - t["b"] * t["c"]


def scale(t: Column) -> Column:
    return F.sqrt(F.abs(determinant(t)))


def rotation(t: Column) -> Column:
    """Radians."""
    return F.atan2(t["c"], t["a"])


def is_identity(t: Column, most: float = 1e-12) -> Column:
    near = [F.abs(t[n] - one) <= most for n, one in zip(NAMES, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), strict=True)]
    return near[0] & near[1] & near[2] & near[3] & near[4] & near[5]


def inverse(t: Column) -> Column:
    """Null if the transform is singular."""
    det = determinant(t)
    a, b, c, d = t["d"] / det, -t["b"] / det, -t["c"] / det, t["a"] / det
    found = transform(a, b, -(a * t["tx"] + b * t["ty"]), c, d, -(c * t["tx"] + d * t["ty"]))
    return F.when(F.abs(det) > SINGULAR, found)


def concat(first: Column, then: Column) -> Column:
    """The transform that applies ``first`` and then ``then``."""
    return transform(
        then["a"] * first["a"] + then["b"] * first["c"],
        then["a"] * first["b"] + then["b"] * first["d"],
        then["a"] * first["tx"] + then["b"] * first["ty"] + then["tx"],
        then["c"] * first["a"] + then["d"] * first["c"],
        then["c"] * first["b"] + then["d"] * first["d"],
        then["c"] * first["tx"] + then["d"] * first["ty"] + then["ty"],
    )


def similarity(pivot_x, pivot_y, dx, dy, rotation_rad, factor) -> Column:
    """Turn and scale about a pivot, then shift."""
    c, s = F.cos(rotation_rad) * factor, F.sin(rotation_rad) * factor
    return transform(c, -s, pivot_x + dx - (c * pivot_x - s * pivot_y), s, c, pivot_y + dy - (s * pivot_x + c * pivot_y))


def magnitude(t: Column, pivot_x, pivot_y) -> Column:
    """struct(shift_m, rotation_deg, scale): the shift in ground metres at the pivot; rotation and scale null where not worth noting."""
    ground = F.cos(F.radians(geo.from_mercator(F.lit(0.0), pivot_y)["lat"]))
    shift = F.hypot((apply_x(t, pivot_x, pivot_y) - pivot_x) * ground, (apply_y(t, pivot_x, pivot_y) - pivot_y) * ground)
    turned = F.degrees(rotation(t))
    return F.struct(
        shift.alias("shift_m"), F.when(F.abs(turned) >= ROTATION_NOTED_DEG, turned).alias("rotation_deg"), F.when(F.abs(scale(t) - 1.0) >= SCALE_NOTED, scale(t)).alias("scale")
    )


def source_zoom(out_z: Column, t: Column, min_zoom, max_zoom) -> Column:
    """The zoom to read from: nudged by the scale by one at most, and clamped to the archive's."""
    s = scale(t)
    delta = F.when(s > 1e-9, F.floor(F.log(s) / F.log(F.lit(2.0)) + 0.5)).otherwise(F.lit(0)).cast("int")
    nudged = F.greatest(out_z - 1, F.least(out_z + 1, out_z + delta))
    low, high = F.least(min_zoom, max_zoom), F.greatest(min_zoom, max_zoom)
    return F.greatest(low, F.least(high, nudged)).cast("int")


def source_corners(z, x, y, inverse_t: Column) -> Column:
    """array of struct(x, y): the tile's four corners through the inverse."""
    b = geo.tile_bounds_m(x, y, z)
    corners = [("min_x", "max_y"), ("max_x", "max_y"), ("max_x", "min_y"), ("min_x", "min_y")]
    return F.array(*[F.struct(apply_x(inverse_t, b[i], b[j]).alias("x"), apply_y(inverse_t, b[i], b[j]).alias("y")) for i, j in corners])


def source_tile_plan(z, x, y, inverse_t: Column, zoom: Column) -> Column:
    """struct(tiles: array<struct(z, x, y)>, clamped): the tiles that the corners' box covers; the centre one alone if there are too many.

    The corners and the box go through ``transform`` over arrays of one, so that each is worked out once for a row.
    """
    span, n = geo.tile_span(zoom), F.pow(F.lit(2.0), zoom).cast("long")
    fx = lambda v: (v + geo.ORIGIN_SHIFT) / span
    fy = lambda v: (F.lit(geo.ORIGIN_SHIFT) - v) / span
    inside = lambda v: F.greatest(F.lit(0).cast("long"), F.least(n - 1, v))
    one = lambda i, j: F.struct(zoom.alias("z"), i.cast("int").alias("x"), j.cast("int").alias("y"))

    def box(corners: Column) -> Column:
        xs, ys = F.transform(corners, lambda p: p["x"]), F.transform(corners, lambda p: p["y"])
        return F.struct(F.array_min(xs).alias("w"), F.array_max(xs).alias("e"), F.array_min(ys).alias("s"), F.array_max(ys).alias("n"))

    def ranges(b: Column) -> Column:
        x0, y0 = F.floor(fx(b["w"]) + geo.EDGE), F.floor(fy(b["n"]) + geo.EDGE)
        x1, y1 = F.greatest(x0, F.ceil(fx(b["e"]) - geo.EDGE) - 1), F.greatest(y0, F.ceil(fy(b["s"]) - geo.EDGE) - 1)
        cx, cy = inside(F.floor(fx((b["w"] + b["e"]) / 2))), inside(F.floor(fy((b["s"] + b["n"]) / 2)))
        outside = (x1 < 0) | (y1 < 0) | (x0 > n - 1) | (y0 > n - 1)
        return F.struct(inside(x0).alias("x0"), inside(y0).alias("y0"), inside(x1).alias("x1"), inside(y1).alias("y1"), cx.alias("cx"), cy.alias("cy"), outside.alias("outside"))

    def plan(r: Column) -> Column:
        many = (r["x1"] - r["x0"] + 1) * (r["y1"] - r["y0"] + 1) > MAX_SOURCE_TILES
        x1, y1 = F.when(many, r["x0"]).otherwise(r["x1"]), F.when(many, r["y0"]).otherwise(r["y1"])
        grid = F.flatten(F.transform(F.sequence(r["y0"], y1), lambda j: F.transform(F.sequence(r["x0"], x1), lambda i: one(i, j))))
        tiles = F.when(r["outside"], F.array().cast("array<struct<z:int,x:int,y:int>>")).when(many, F.array(one(r["cx"], r["cy"]))).otherwise(grid)
        return F.struct(tiles.alias("tiles"), (~r["outside"] & many).alias("clamped"))

    steps = F.array(source_corners(z, x, y, inverse_t))
    for f in (box, ranges, plan):
        steps = F.transform(steps, f)
    return F.element_at(steps, 1)


def warp_matrix(z, x, y, t: Column, src_zoom, src_x, src_y) -> Column:
    """array of six doubles from source pixels to the tile's pixels."""
    b, out_res, src_res, span = geo.tile_bounds_m(x, y, z), geo.resolution(z), geo.resolution(src_zoom), geo.tile_span(src_zoom)
    ox, oy = src_x * span - geo.ORIGIN_SHIFT, F.lit(geo.ORIGIN_SHIFT) - src_y * span
    k = src_res / out_res
    return F.array(
        t["a"] * k, -t["b"] * k, (apply_x(t, ox, oy) - b["min_x"]) / out_res, -t["c"] * k, t["d"] * k, (b["max_y"] - apply_y(t, ox, oy)) / out_res
    )


def apply_matrix(m: Column, px, py) -> Column:
    return F.struct((m[0] * px + m[1] * py + m[2]).alias("px"), (m[3] * px + m[4] * py + m[5]).alias("py"))


def negligible(t: Column, z) -> Column:
    """Whether shift and scale move no pixel of a tile by NEGLIGIBLE_PIXELS."""
    res = geo.resolution(z)
    moved = F.hypot(t["tx"], t["ty"]) + F.abs(scale(t) - 1.0) * geo.TILE_PIXELS * res
    return is_identity(t) | (moved < res * NEGLIGIBLE_PIXELS)
