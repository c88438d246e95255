"""Global orders: places are right, and no window holds all rows."""

import os
import random

import pytest
from pyspark.sql import functions as F

from terravane.operators import order
from terravane.plans import registry

SF = "/root/testdata/sf0.001"


def test_numbered(spark):
    rng = random.Random(3)
    rows = [(k, None if k % 50 == 0 else rng.randrange(4)) for k in range(3000)]  # few distinct values
    df = spark.createDataFrame(rows, "id long, x long").repartition(7)
    found = {r["id"]: r["place"] for r in order.numbered(df, [F.desc("x"), F.col("id")], "place").collect()}
    wanted = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert found == {r[0]: k + 1 for k, r in enumerate(wanted)}
    assert order.numbered(df.where("id < 0"), [F.desc("x"), F.col("id")], "place").count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["o1_newest_finds", "o6_places_nearest", "j20_ranked_presets"])
def test_places_need_no_window_over_all_rows(spark, name):
    import duckdb

    df = registry.QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "row_number()" in line]
    assert windows and all("[__range#" in line for line in windows)
    db = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events pages".split():
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = db.sql(registry.ORACLES[name])
    at = [rel.columns.index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[k] for k in at)) for r in rel.fetchall())
