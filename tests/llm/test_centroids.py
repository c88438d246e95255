"""Clustering by heaps of bounds against full comparison in Python's integers."""

import hashlib
import math
import random

import numpy as np

from terravane.llm import centroids

ROWS = "vec_id long, embedding array<double>, cluster string, distance double"


def _brute(vectors, k, rounds, seed, dims, scale):
    kept = [(i, [math.floor(x * scale) for x in v]) for i, v in vectors if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    now = [v for _, v in start]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(now)) for _, v in kept]

    for _ in range(rounds):
        own = assign()
        for j in range(len(now)):
            members = [v for (_, v), (_, c) in zip(kept, own) if c == j]
            if members:
                now[j] = [sum(x) // len(members) for x in zip(*members)]
    return sorted(((i, c, min(d, centroids.LONGEST)) for (i, _), (d, c) in zip(kept, assign())), key=repr), now


def _check(spark, vectors, monkeypatch=None, **how):
    how = {"k": 8, "rounds": 10, "seed": 3, "dims": 64, "scale": 1024} | how
    table = spark.createDataFrame([(i, v, "x", 0.5) for i, v in vectors], ROWS).repartition(3)
    found, now, measured = centroids.assign(table, **how)
    rows = sorted(((r["id"], r["cluster"], r["distance"]) for r in found.collect()), key=repr)
    assert (rows, now) == _brute(vectors, **how)
    return rows, measured


def test_rows_of_all_kinds(spark, monkeypatch):
    monkeypatch.setattr(centroids, "BLOCK", 50)
    rng = random.Random(1)
    vectors = [(k, [rng.gauss(k % 5, 0.6) for _ in range(64)]) for k in range(240)]
    vectors += [(300, None), (301, []), (302, [0.0] * 63), (303, [0.0] * 63 + [None]), (304, [0.0] * 63 + [math.inf]), (305, [math.nan] * 64), (306, [0.0] * 65)]
    vectors += [(None, [0.5] * 64), (7, vectors[7][1]), (8, vectors[0][1])] + [(400 + k, [1.0] * 64) for k in range(120)]  # a group of equal vectors
    rows, measured = _check(spark, vectors)
    assert len(rows) == 363 and measured[0] == 363


def test_ties_small_tables_and_empty_clusters(spark):
    corners = [(k, [float(k % 2), float(k // 2 % 2)]) for k in range(40)]  # every distance is shared
    _check(spark, corners, dims=2, k=3)
    _check(spark, [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 0.0])], dims=2)  # fewer vectors than centroids, equal ones
    _check(spark, [(1, [-0.0001, 2.0])], dims=2, k=1)
    assert centroids.cluster(spark.createDataFrame([], ROWS)).count() == 0
    assert centroids.cluster(spark.createDataFrame([(1, [1.0], "x", 0.5)], ROWS)).collect() == []


def test_large_components_stay_whole(spark):
    rng = random.Random(2)
    for size in (1e4, 1e5, 1e6):  # in doubles, in 64-bit integers, in Python's
        _check(spark, [(k, [rng.uniform(-size, size) for _ in range(4)]) for k in range(60)], dims=4, k=4)


def test_few_vectors_are_measured_again(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(0, 3, (8, 16))
    vectors = [(k, (middles[k % 8] + rng.normal(0, 0.4, 16)).tolist()) for k in range(2000)]
    _, measured = _check(spark, vectors, dims=16, k=8)
    assert measured[0] == 2000 and sum(measured[1:]) < 0.5 * 2000 * (len(measured) - 1)


def test_the_query_columns(spark):
    table = spark.createDataFrame([(k, [k / 3, 1.0]) for k in range(30)], "vec_id int, embedding array<float>")
    rows = centroids.cluster(table, dims=2, k=3).collect()
    of = {r["cluster"]: r for r in rows}
    for j, r in of.items():
        assert r["cluster_inertia"] == sum(x["distance"] for x in rows if x["cluster"] == j) and r["inertia"] == sum(x["distance"] for x in rows)
