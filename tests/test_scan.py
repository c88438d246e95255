"""Ordered scans of hot keys in ranges, against windows over the whole key and against brute force."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from terravane.operators import fieldlog, layers, scan, tiles, tracks


@pytest.fixture(scope="module")
def hot(spark):
    rng = random.Random(3)
    rows = [(7 if k % 3 else rng.choice([None, 1, 2, 3]), k, rng.choice([None, None, None, k]), k % 11) for k in range(6000)]
    return spark.createDataFrame(rows, "key long, at long, seen long, n long").repartition(5).cache()


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_leads_make_ranges_like_the_whole_key(hot):
    w = Window.partitionBy("key").orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    wanted = hot.select("key", "at", F.lag("at").over(w).alias("lag"), F.last("seen", ignorenulls=True).over(upto).alias("last"), F.sum("n").over(upto).alias("sum"))
    wanted = {r["at"]: tuple(r) for r in wanted.collect()}
    led = scan.steps_from(hot, ["key"], ["at"], ["at", "n"])
    assert {r["at"]: (r["prev_at"], r["has_prev_"]) for r in led.collect()} == {at: (r[2], r[2] is not None) for at, r in wanted.items()}
    assert {r["at"]: r["last"] for r in scan.last_known(hot, ["key"], ["at"], {"last": F.col("seen")}).collect()} == {at: r[3] for at, r in wanted.items()}
    assert {r["at"]: r["sum"] for r in scan.running_sum(hot, ["key"], ["at"], F.col("n"), "sum").collect()} == {at: r[4] for at, r in wanted.items()}


def test_no_key_at_all(hot):
    out = scan.running_sum(hot, [], ["at"], F.lit(1), "place")
    assert all(r["place"] == r["at"] + 1 for r in out.collect())


def test_a_hot_key_goes_to_many_ranges(spark, hot):
    parts = scan.in_ranges(hot, ["key"], ["at"]).groupBy("key", "__range").count().collect()
    of_hot = [r["count"] for r in parts if r["key"] == 7]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(of_hot) >= n // 2 and max(of_hot) <= 1.5 * 6000 / n
    for df in (tracks.steps(hot.selectExpr("key AS track_id", "at AS ts", "at AS id", "0D AS lat", "0D AS lon")), layers.running_soil(hot.selectExpr("key AS place", "at AS time", "CAST(seen AS DOUBLE) AS moisture", "CAST(n AS DOUBLE) AS rain"))):
        plan = [line for line in _plan(df).split("\n") if "Window [" in line and "__range" not in line and "span" not in line]
        # the windows that are left are over one row for each range of a key
        assert all("__last" in line or "seen" in line or "moisture" in line for line in plan) and df.count() == 6000


def test_streaks_of_a_hot_host(spark):
    rng = random.Random(9)
    rows = [("hot" if k % 3 else f"h{k % 4}", k, 500 * (k // 2), rng.choice([200, 429, 429, 503, None]), rng.choice([None, 1, 900])) for k in range(3000)]
    rows += [("only", 5000 + k, 10**6 + k, 429, None) for k in range(400)]  # a streak longer than a range
    table = spark.createDataFrame(rows, "host string, id long, at_ms long, status int, retry_after_s int").repartition(6)
    streak, wanted = {}, {}
    for host, k, at, status, asked in rows:
        streak[host] = streak.get(host, 0) + 1 if status in (429, 503) else 0
        until = at + max(min(300_000, 2000 * 2 ** min(streak[host] - 1, 20)), min(300_000, (asked or 0) * 1000)) if streak[host] else None
        wanted[k] = (streak[host], until)
    assert {r["id"]: (r["streak"], r["blocked_until"]) for r in layers.blocked_until(table).collect()} == wanted


def test_soil_over_borders(spark):
    rng = random.Random(10)
    rows = [(1 if k % 3 else 2, 1_700_000_000 + 3600 * k, rng.choice([None, None, rng.random()]), rng.choice([None, rng.random()])) for k in range(700)]
    table = spark.createDataFrame(rows, "place long, time long, moisture double, rain double").repartition(4)
    for r in layers.running_soil(table).collect():
        own = [x for x in rows if x[0] == r["place"] and x[1] <= r["time"]]
        assert r["moisture"] == next((x[2] for x in reversed(own) if x[2] is not None), None)
        assert abs(r["rain_mm"] - sum(x[3] or 0 for x in own if x[1] >= r["time"] - layers.RAIN_DAYS_S)) < 1e-9


def test_a_run_over_very_many_ids(spark):
    runs = spark.createDataFrame([(5, 10**12, "long"), (10**12 + 9, 3, "short")], "tile_id long, run_length long, content string")
    asked = [4, 5, 6, 10**6, 10**11 + 7, 10**12 + 4, 10**12 + 5, 10**12 + 9, 10**12 + 11, 10**12 + 12]
    wanted = [None, "long", "long", "long", "long", "long", None, "short", "short", None]
    found = tiles.lookup(spark.createDataFrame([(i,) for i in asked], "tile_id long"), runs)
    assert {r["tile_id"]: r["content"] for r in found.collect()} == dict(zip(asked, wanted))
    assert "explode" not in _plan(found).lower()  # a run stays one row


def test_ids_of_64_bits_are_numbered(spark):
    rng = random.Random(12)
    old = sorted({rng.getrandbits(62) for _ in range(500)})
    existing = spark.createDataFrame([(i, f"e{i}") for i in old], "id long, external_id string")
    incoming = spark.createDataFrame([(i, f"n{i}") for i in old], "id long, external_id string").repartition(5)  # all ids are taken
    rows, counts = fieldlog.merge_import(existing, incoming)
    assert sorted(r["id"] for r in rows.collect()) == [old[-1] + 1 + k for k in range(500)]
    assert counts.first()["inserted"] == 500
    lines = [line for line in _plan(rows).split("\n") if "Window [" in line and "windowspecdefinition(" in line]
    assert all("sum(__rows" in line for line in lines if "windowspecdefinition(__range" in line and "row_number" not in line)


def test_marks_of_a_hot_track(spark):
    rng = random.Random(13)
    fixes = [(1 if k % 4 else 2, k, 1000 * (k // 2), float(k), 0.0) for k in range(1200)]
    marks = [(rng.choice([1, 2, 3]), k, rng.randint(-500, 620_000)) for k in range(300)]
    f = spark.createDataFrame(fixes, "track_id long, arrival long, ts long, lat double, lon double").repartition(3)
    m = spark.createDataFrame(marks, "track_id long, mark_id long, ts long").repartition(3)
    for r in tracks.marks_at_fixes(m, f).collect():
        own = max(((x[2], x[1], x[3]) for x in fixes if x[0] == r["track_id"] and x[2] <= r["ts"]), default=(None, None, None))
        assert (r["fix_ts"], r["lat"]) == (own[0], own[2])
