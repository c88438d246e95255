"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import os

import pytest

from terravane.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events pages".split()
#: The quick ones here; the rest is compared by the driver at a larger size.
NAMES = ["j6_point_in_polygon", "j8_finds_by_area", "j9_best_calibration", "j14_finds_near_places", "e14_hilbert_ids", "w2_recorded_tracks", "w4_directory_runs", "w12_directory_lookup", "a12_affine_fits", "d5_import_merge", "t12_marks_at_fixes", "s6_gpx_round_trip", "r2_hillshade", "f8_boxes", "s8_plain_gpx", "t2_trails", "e26_preset_reasons", "j21_source_tiles"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_is_its_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    rel = db.sql(registry.ORACLES[name])
    order = [rel.columns.index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[k] for k in order)) for r in rel.fetchall())
