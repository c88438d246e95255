"""Field-log tables derived from the star-schema tables: one SELECT for each, in SQL that Spark and DuckDB both run.

Coordinates come from integer keys in double arithmetic, so that both engines get the same bits. ``{name}`` stands for a
table; in Spark it is a DataFrame, in DuckDB a view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_LAT = "48.4e0 + ({k} * 7919 % 28000) / 10000.0e0"
_LON = "11.9e0 + ({k} * 104729 % 71000) / 10000.0e0"
T0 = 1600000000000


def _at(k: str) -> str:
    return f"{_LAT.format(k=k)} AS lat, {_LON.format(k=k)} AS lon"


SELECTS = {
    "finds": f"""SELECT o_orderkey AS id, {_at('o_orderkey')}, {T0} + (o_orderkey * 7 % 2000) * 43200000 AS created_at,
        concat('Find ', CAST(o_orderkey AS VARCHAR(20))) AS title,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'MINCE' WHEN '2-HIGH' THEN 'KNOFLIK' WHEN '3-MEDIUM' THEN 'VOJENSKE' WHEN '4-NOT SPECIFIED' THEN 'NEZNAMA' ELSE 'OSTATNI' END AS category,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 60 AS INT) END AS depth_cm,
        o_orderkey % 7 = 0 AS favorite, concat('layer', CAST(o_orderkey % 30 AS VARCHAR(20))) AS layer_context_id,
        CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 200 ELSE NULL END AS track_id
        FROM {{orders}}""",
    "find_photos": f"""SELECT l_orderkey AS find_id, l_orderkey * 100000 + l_partkey AS id, concat('/p/', CAST(l_partkey AS VARCHAR(20)), '.jpg') AS uri,
        {T0} + (l_partkey * 31 % 1000) * 60000 AS created_at, l_linenumber = 2 AS is_primary FROM {{lineitem}}""",
    "places": f"""SELECT c_custkey AS id, {_at('(c_custkey + 17)')}, {T0} + (c_custkey * 13 % 1500) * 3600000 AS created_at, c_name AS title,
        CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'PLAN' WHEN 'MACHINERY' THEN 'ZAKAZ' WHEN 'BUILDING' THEN 'SRAZ' WHEN 'FURNITURE' THEN 'PARKOVANI' ELSE 'JINE' END AS type,
        c_custkey % 4 = 0 AS visited FROM {{customer}}""",
    # squares of several sizes; every third one with a square hole
    "areas": f"""SELECT s_suppkey AS id, s_name AS name, 0.04e0 + (s_suppkey % 7) * 0.03e0 AS side, {_at('(s_suppkey * 31 + 5)')}, s_suppkey % 3 = 0 AS holed,
        CASE WHEN s_suppkey % 2 = 0 THEN 'HOTOVO' ELSE 'ROZPRACOVANO' END AS status, concat('UAN ', CAST(s_suppkey % 4 AS VARCHAR(20))) AS uan,
        {T0} + s_suppkey * 86400000 AS created_at, (s_suppkey % 50) * 0.5e0 AS area_ha FROM {{supplier}}""",
    "calibrations": f"""SELECT s_suppkey AS id, concat('layer', CAST(s_nationkey AS VARCHAR(20))) AS layer_id,
        48.0e0 + (s_suppkey * 7919 % 20000) / 10000.0e0 AS south, 11.5e0 + (s_suppkey * 104729 % 40000) / 10000.0e0 AS west,
        51.2e0 - (s_suppkey % 11) * 0.1e0 AS north, 19.2e0 - (s_suppkey % 13) * 0.2e0 AS east,
        1.0e0 + (s_suppkey % 5) * 0.001e0 AS a, (s_suppkey % 3) * 0.002e0 AS b, (s_suppkey % 40) * 3.5e0 AS tx, -(s_suppkey % 3) * 0.002e0 AS c, 1.0e0 + (s_suppkey % 5) * 0.001e0 AS d, (s_suppkey % 30) * -2.5e0 AS ty,
        {T0} + (s_suppkey % 9) * 1000 AS updated_at, s_suppkey % 4 <> 0 AS active FROM {{supplier}}""",
    "gcp_points": """SELECT p_size AS set_id, p_partkey AS id, CAST(p_partkey * 37 % 1999 AS DOUBLE) AS src_x, CAST(p_partkey * 53 % 1777 AS DOUBLE) AS src_y,
        1.03e0 * (p_partkey * 37 % 1999) - 0.07e0 * (p_partkey * 53 % 1777) + 250.0e0 + (p_partkey % 10 - 4.5e0) * 0.1e0 AS dst_x,
        0.05e0 * (p_partkey * 37 % 1999) + 0.98e0 * (p_partkey * 53 % 1777) - 410.0e0 + (p_partkey % 7 - 3.0e0) * 0.1e0 AS dst_y FROM {part}""",
    "detectors": f"""SELECT n_nationkey AS id, n_name AS name, {T0} + n_nationkey * 5000 AS created_at, n_nationkey = 3 AS is_default FROM {{nation}}""",
    "presets": f"""SELECT p_partkey AS id, p_partkey % 25 AS detector_id, p_name AS name, {T0} + (p_partkey * 11 % 900) * 1000 AS created_at,
        CASE p_partkey % 6 WHEN 0 THEN 'LES' WHEN 1 THEN 'LOUKA' WHEN 2 THEN 'POLE' WHEN 3 THEN 'ZAHRADA' WHEN 4 THEN 'RUMISTE' ELSE 'PLAZ' END AS terrain,
        CASE p_size % 3 WHEN 0 THEN 'SUCHO' WHEN 1 THEN 'VLHKO' ELSE 'MOKRO' END AS soil FROM {{part}}""",
    # one walk for each user: small steps, some standing, some spikes, some bad accuracies and repeated times
    "fixes": f"""SELECT user_id AS track_id, event_id AS arrival,
        49.0e0 + user_id * 0.01e0 + (event_id % 977) * 0.00011e0 + CASE WHEN event_id % 41 = 0 THEN 0.05e0 ELSE 0.0e0 END AS lat,
        14.0e0 + user_id * 0.01e0 + (event_id * 7 % 13) * 0.00002e0 AS lon,
        CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(floor(value) % 60 AS DOUBLE) END AS accuracy_m,
        {T0} + (event_id - event_id % 2) * 15000 - CASE WHEN event_id % 53 = 0 THEN 9000000 ELSE 0 END AS ts FROM {{events}}""",
    "tiles": """SELECT z, x, y, (x - x % 4) * 1000 + (y - y % 4) + z * 1000000 AS content, 400 + (x * 7 + y * 3) % 90 AS bytes FROM (
        SELECT DISTINCT 9 AS z, CAST(o_orderkey * 7919 % 160 AS INT) AS x, CAST(o_orderkey * 131 % 120 AS INT) AS y FROM {orders}
        UNION ALL SELECT DISTINCT 8 AS z, CAST(o_orderkey * 7919 % 80 AS INT) AS x, CAST(o_orderkey * 131 % 60 AS INT) AS y FROM {orders}) t""",
    "responses": f"""SELECT event_id AS id, concat('host', CAST(user_id % 20 AS VARCHAR(20))) AS host, {T0} + event_id * 700 AS at_ms,
        CASE WHEN event_type = 'error' OR value < 120 THEN 429 ELSE 200 END AS status, CASE WHEN event_id % 9 = 0 THEN event_id % 400 ELSE NULL END AS retry_after_s, CAST(floor(value * 100) AS BIGINT) AS bytes FROM {{events}}""",
    "hours": """SELECT user_id AS place, 1700000000 + event_id * 3600 AS time, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value / 1000.0e0 END AS moisture,
        CASE WHEN event_id % 5 = 0 THEN NULL ELSE value / 100.0e0 END AS rain FROM {events}""",
    "dem": """SELECT CAST(floor(o_orderkey / 100) AS INT) AS row, CAST(o_orderkey % 100 AS INT) AS col,
        CAST((o_orderkey * 7919 % 500) AS DOUBLE) / 50.0e0 + CAST(floor(o_orderkey / 100) AS DOUBLE) * 0.3e0 AS z FROM {orders}""",
    "points_cloud": """SELECT l_orderkey % 120 + (l_partkey % 10) / 10.0e0 AS x, l_suppkey % 50 + (l_linenumber % 10) / 10.0e0 AS y, l_quantity AS z FROM {lineitem}""",
}


def sources(select: str) -> set[str]:
    return set(re.findall(r"\{(\w+)\}", select))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, or one of the given ones by its own name."""
    if name not in SELECTS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    select = SELECTS[name]
    return spark.sql(select, **{s: table(spark, sf_dir, s) for s in sources(select)})


def with_tables(body: str, *names: str) -> str:
    """DuckDB SQL: ``body`` behind the derived tables that it names."""
    ctes = ", ".join(f"{n} AS ({re.sub(r'[{}]', '', SELECTS[n])})" for n in names)
    recursive = "RECURSIVE " if "RECURSIVE" in body[:40] else ""
    rest = body.removeprefix("WITH RECURSIVE ").removeprefix("WITH ")
    joined = ", " + rest if rest != body else " " + body
    return f"WITH {recursive}{ctes}{joined}"
