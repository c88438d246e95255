"""Least-squares fits of map calibrations by set of control points: sums and closed forms, no Python workers.

Points are (set_id, id, src_x, src_y, dst_x, dst_y). Sums are taken on coordinates centred by set, so that metres of
millions don't cost digits; a set's mean is joined back for that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.functions import affine, geo

#: A set's points count as collinear below this share of their spread; a similarity's spread has an absolute bound.
COLLINEAR, LEAST_SPREAD = 1e-12, 1e-12
# Fixed value: the box of a set without points.
COUNTRY = (12.0, 48.5, 18.9, 51.1)


def _centred(points: DataFrame) -> DataFrame:
    names = ["src_x", "src_y", "dst_x", "dst_y"]
    means = points.groupBy("set_id").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in names])
    return points.join(means, "set_id").select("set_id", "n", *[f"m_{c}" for c in names], *[(F.col(c) - F.col(f"m_{c}")).alias(c) for c in names])


def sums(points: DataFrame) -> DataFrame:
    """Per set: n, the means, and the centred second moments."""
    products = {"xx": ("src_x", "src_x"), "xy": ("src_x", "src_y"), "yy": ("src_y", "src_y"), "xu": ("src_x", "dst_x"), "yu": ("src_y", "dst_x"), "xv": ("src_x", "dst_y"), "yv": ("src_y", "dst_y")}
    firsts = [F.first(c).alias(c) for c in ("n", "m_src_x", "m_src_y", "m_dst_x", "m_dst_y")]
    return _centred(points).groupBy("set_id").agg(*firsts, *[F.sum(F.col(a) * F.col(b)).alias(k) for k, (a, b) in products.items()])


def translation() -> Column:
    return affine.transform(1.0, 0.0, F.col("m_dst_x") - F.col("m_src_x"), 0.0, 1.0, F.col("m_dst_y") - F.col("m_src_y"))


def _about_means(a: Column, b: Column, c: Column, d: Column) -> Column:
    tx = F.col("m_dst_x") - (a * F.col("m_src_x") + b * F.col("m_src_y"))
    ty = F.col("m_dst_y") - (c * F.col("m_src_x") + d * F.col("m_src_y"))
    return affine.transform(a, b, tx, c, d, ty)


def similarity() -> Column:
    """Null under two points or without spread."""
    spread = F.col("xx") + F.col("yy")
    alpha, beta = (F.col("xu") + F.col("yv")) / spread, (F.col("xv") - F.col("yu")) / spread
    return F.when((F.col("n") >= 2) & (spread >= LEAST_SPREAD), _about_means(alpha, -beta, beta, alpha))


def full_affine() -> Column:
    """Null under three points or where they are collinear."""
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    solve = lambda p, q: ((p * F.col("yy") - q * F.col("xy")) / det, (q * F.col("xx") - p * F.col("xy")) / det)
    a, b = solve(F.col("xu"), F.col("yu"))
    c, d = solve(F.col("xv"), F.col("yv"))
    enough = det > COLLINEAR * F.greatest(F.col("xx") * F.col("yy"), F.lit(1e-300))
    return F.when((F.col("n") >= 3) & enough, _about_means(a, b, c, d))


def fit(points: DataFrame, how: str = "best") -> DataFrame:
    """(set_id, n, transform): ``translation``, ``similarity``, ``affine``, ``best`` (affine from three points, else similarity) or ``editor``.

    ``editor``: a shift from one point, a similarity from two, an affine from three.
    """
    n = F.col("n")
    kinds = {
        "translation": translation(),
        "similarity": similarity(),
        "affine": full_affine(),
        "best": F.coalesce(full_affine(), similarity()),
        "editor": F.when(n >= 3, F.coalesce(full_affine(), similarity())).when(n == 2, similarity()).otherwise(translation()),
    }
    return sums(points).select("set_id", "n", kinds[how].alias("transform"))


def residuals(points: DataFrame, fits: DataFrame) -> DataFrame:
    """(set_id, id, residual) of each point under its set's fit."""
    t = F.col("transform")
    dx = affine.apply_x(t, F.col("src_x"), F.col("src_y")) - F.col("dst_x")
    dy = affine.apply_y(t, F.col("src_x"), F.col("src_y")) - F.col("dst_y")
    return points.join(fits.where("transform IS NOT NULL"), "set_id").select("set_id", "id", F.hypot(dx, dy).alias("residual"))


def rmse(points: DataFrame, fits: DataFrame) -> DataFrame:
    """(set_id, rmse); 0 for a set without points."""
    r = residuals(points, fits)
    by_set = r.groupBy("set_id").agg(F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rmse"))
    return fits.select("set_id").join(by_set, "set_id", "left").select("set_id", F.coalesce("rmse", F.lit(0.0)).alias("rmse"))


def extent(points: DataFrame, sets: DataFrame, factor: float = 1.2, least_deg: float = 0.02) -> DataFrame:
    """(set_id, box) of a set's targets in degrees, grown; the country's box for a set without points."""
    where = geo.from_mercator(F.col("dst_x"), F.col("dst_y"))
    bounds = points.select("set_id", where["lat"].alias("lat"), where["lon"].alias("lon")).groupBy("set_id").agg(F.min("lon").alias("w"), F.min("lat").alias("s"), F.max("lon").alias("e"), F.max("lat").alias("n"))
    box = geo.box_at_least(geo.box_expand(geo.box_struct(F.col("w"), F.col("s"), F.col("e"), F.col("n")), factor), least_deg)
    country = geo.box_struct(*map(float, COUNTRY))
    return sets.select("set_id").hint("merge").join(bounds.select("set_id", box.alias("box")).hint("merge"), "set_id", "left").select("set_id", F.coalesce("box", country).alias("box"))
