"""Ids of map tiles along Hilbert curves, one pyramid of zooms after the other: bit arithmetic in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_ZOOM = 26


def _before(z: Column) -> Column:
    """Ids of all lower zooms: (4^z - 1) / 3."""
    return ((F.pow(F.lit(4.0), z) - 1) / 3).cast("long")


def tile_id(z: Column, x: Column, y: Column) -> Column:
    """Null outside the zoom's grid or the zooms 0 to MAX_ZOOM."""
    one = F.lit(1).cast("long")
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def level(s: Column, k: Column) -> Column:
        side = F.call_function("shiftleft", one, k)
        right, up = (s["x"].bitwiseAND(side) > 0).cast("long"), (s["y"].bitwiseAND(side) > 0).cast("long")
        d = s["d"] + side * side * (right * 3).bitwiseXOR(up)
        # the quadrant's turn: mirrored if right and not up, swapped if not up
        flip = (up == 0) & (right == 1)
        x1 = F.when(flip, side - 1 - s["x"].bitwiseAND(side - 1)).otherwise(s["x"].bitwiseAND(side - 1))
        y1 = F.when(flip, side - 1 - s["y"].bitwiseAND(side - 1)).otherwise(s["y"].bitwiseAND(side - 1))
        return F.struct(F.when(up == 0, y1).otherwise(x1).alias("x"), F.when(up == 0, x1).otherwise(y1).alias("y"), d.alias("d"))

    levels = F.when(z > 0, F.sequence(z.cast("int") - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    side = F.pow(F.lit(2.0), z)
    fits = z.between(0, MAX_ZOOM) & (x >= 0) & (y >= 0) & (x < side) & (y < side)
    return F.when(fits, _before(z) + F.aggregate(levels, start, level, lambda s: s["d"]))


def zxy(tile: Column) -> Column:
    """struct(z, x, y) of an id; null for negative ids and ids past MAX_ZOOM."""
    zooms = F.sequence(F.lit(0), F.lit(MAX_ZOOM + 1))
    z = F.size(F.filter(zooms, lambda k: _before(k) <= tile)) - 1
    rest = tile - _before(z)
    start = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), rest.alias("d"))

    def level(s: Column, k: Column) -> Column:
        side = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        right = F.call_function("shiftright", s["d"], F.lit(1)).bitwiseAND(F.lit(1).cast("long"))
        up = s["d"].bitwiseXOR(right).bitwiseAND(F.lit(1).cast("long"))
        flip = (up == 0) & (right == 1)
        x1 = F.when(flip, side - 1 - s["x"]).otherwise(s["x"])
        y1 = F.when(flip, side - 1 - s["y"]).otherwise(s["y"])
        x2, y2 = F.when(up == 0, y1).otherwise(x1), F.when(up == 0, x1).otherwise(y1)
        return F.struct((x2 + side * right).alias("x"), (y2 + side * up).alias("y"), F.call_function("shiftright", s["d"], F.lit(2)).alias("d"))

    levels = F.when(z > 0, F.sequence(F.lit(0), z - 1)).otherwise(F.array().cast("array<int>"))
    found = F.aggregate(levels, start, level)
    return F.when((tile >= 0) & (z <= MAX_ZOOM), F.struct(z.alias("z"), found["x"].cast("int").alias("x"), found["y"].cast("int").alias("y")))
