"""Registration of queries with their SQL, and pieces that both sides share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.operators.store import ship
from terravane.plans.derived import table, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *derived: str):
    """Registers a function of tables: it gets a reader ``t(name)``. ``sql`` is DuckDB SQL over the ``derived`` tables."""

    def register(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(lambda n: table(spark, sf_dir, n))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = with_tables(sql, *derived) if derived else sql
        return f

    return register


def milli(c: Column | str) -> Column:
    """A double as whole thousandths, so that the last bits of the engines' functions don't matter."""
    return F.floor((F.col(c) if isinstance(c, str) else c) * 1000.0 + 0.5).cast("long")


def sql_milli(x: str) -> str:
    return f"CAST(floor(({x}) * 1000.0e0 + 0.5e0) AS BIGINT)"


def sql_distance(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"(sin(radians({lat2} - {lat1}) / 2) * sin(radians({lat2} - {lat1}) / 2) + cos(radians({lat1})) * cos(radians({lat2})) * sin(radians({lon2} - {lon1}) / 2) * sin(radians({lon2} - {lon1}) / 2))"
    return f"(2 * 6371008.8e0 * atan2(sqrt({a}), sqrt(1 - {a})))"


def square_rings() -> Column:
    """Rings of a derived area: its square, and the hole where it has one."""
    lat, lon, side = F.col("lat"), F.col("lon"), F.col("side")

    def square(south: Column, west: Column, s: Column) -> Column:
        p = lambda a, b: F.struct(a.alias("lat"), b.alias("lon"))
        return F.array(p(south, west), p(south, west + s), p(south + s, west + s), p(south + s, west))

    hole = square(lat + side / 4, lon + side / 4, side / 2)
    return F.when(F.col("holed"), F.array(square(lat, lon, side), hole)).otherwise(F.array(square(lat, lon, side)))


def polygons(areas: DataFrame) -> DataFrame:
    """Derived areas as polygons."""
    return areas.select(F.col("id").alias("poly_id"), F.col("id").alias("poly_ord"), square_rings().alias("rings"), F.create_map(F.lit("uan"), F.col("uan")).alias("properties"))


#: Edges (poly_id, ring, ax, ay, bx, by as lon, lat) of the derived areas, for brute force.
SQL_EDGES = """squares AS (SELECT id, 0 AS ring, lat AS s, lon AS w, side FROM areas UNION ALL SELECT id, 1, lat + side / 4, lon + side / 4, side / 2 FROM areas WHERE holed),
edges AS (SELECT id, ring, s AS alat, w AS alon, s AS blat, w + side AS blon FROM squares UNION ALL SELECT id, ring, s, w + side, s + side, w + side FROM squares
UNION ALL SELECT id, ring, s + side, w + side, s + side, w FROM squares UNION ALL SELECT id, ring, s + side, w, s, w FROM squares)"""
#: Pairs (point, polygon) by counting crossings of every ring of every polygon: no grid.
SQL_INSIDE = (
    SQL_EDGES
    + """, crossed AS (SELECT f.id AS point_id, e.id AS poly_id, e.ring, count(*) FILTER (WHERE (e.blon > f.lon) <> (e.alon > f.lon) AND f.lat < e.blat + (e.alat - e.blat) / (e.alon - e.blon) * (f.lon - e.blon)) % 2 AS odd
FROM finds f JOIN edges e ON true GROUP BY 1, 2, 3),
inside AS (SELECT point_id, poly_id FROM crossed GROUP BY 1, 2 HAVING max(CASE WHEN ring = 0 THEN odd ELSE 0 END) = 1 AND max(CASE WHEN ring = 1 THEN odd ELSE 0 END) = 0)"""
)
