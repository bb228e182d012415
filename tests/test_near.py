"""Pairs within a distance, and sums over them, against every pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tellurion.functions import measure
from tellurion.operators import aggregates as agg
from tellurion.operators import joins, near


def spread_points(n, seed):
    """Scattered points with a crowd, some in one place, some at high latitudes."""
    rng = np.random.default_rng(seed)
    xy = rng.random((n, 2)) * [40, 30] + [80, 20]
    xy[: n // 4] = [100, 30] + rng.random((n // 4, 2)) * 0.5
    xy[n // 4 : n // 4 + 5] = [101, 31]
    xy[-n // 10 :, 1] = rng.uniform(-86, 86, n // 10)
    return xy


def distances(a, b):
    return measure.rhumb_distance(a[:, None, 0], a[:, None, 1], b[None, :, 0], b[None, :, 1], "meters")


@pytest.mark.parametrize("radius", [1.0, 60_000.0, 900_000.0])
def test_pairs_and_means(spark, monkeypatch, radius):
    """Crowds are dealt in blocks; heights that are null have weight but no height."""
    monkeypatch.setattr(near, "BLOCK", 16)
    a, b = spread_points(120, 1), spread_points(200, 2)
    d = distances(a, b)
    left = spark.createDataFrame([(f"t{i}", float(x), float(y)) for i, (x, y) in enumerate(a)] + [("none", None, 1.0)], "id string, lon double, lat double")
    right = spark.createDataFrame([(j, float(x), float(y), None if j % 7 == 0 else float(j)) for j, (x, y) in enumerate(b)], "sid long, rlon double, rlat double, z double")
    got = {(r["id"], r["sid"]): r["distance"] for r in joins.within_distance(left, right, radius).collect()}
    want = {(f"t{i}", int(j)): d[i, j] for i, j in zip(*np.nonzero(d <= radius), strict=True)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-2 for k in want)
    means = agg.idw(right.select(F.col("rlon").alias("lon"), F.col("rlat").alias("lat"), "z"), left, "id", "z", radius)
    means = {r["id"]: r["z"] for r in means.collect()}
    assert means.keys() == {k for k, _ in want}
    for i in range(len(a)):
        j = np.flatnonzero(d[i] <= radius)
        if not len(j):
            continue
        same, tall = [k for k in j if d[i, k] < 1e-9 and k % 7], [k for k in j if d[i, k] >= 1e-9 and k % 7]
        away = [k for k in j if d[i, k] >= 1e-9]
        hope = np.mean(same) if same else sum(k / d[i, k] for k in tall) / sum(1 / d[i, k] for k in away) if tall else None
        assert means[f"t{i}"] == hope if hope is None else abs(means[f"t{i}"] - hope) < 1e-4


def test_weights_and_moran(spark):
    """The index without a table of pairs is that with one; weights of a row add up to one."""
    xy = spread_points(150, 3)
    rows = spark.createDataFrame([(f"p{i}", float(x), float(y), float((i * 37) % 11)) for i, (x, y) in enumerate(xy)], "id string, lon double, lat double, v double")
    for binary in (True, False):
        w = agg.distance_weight(rows, "id", 500_000.0, binary=binary)
        assert all(abs(r["s"] - 1) < 1e-9 for r in w.groupBy("i").agg(F.sum("w").alias("s")).collect())
    w = agg.distance_weight(rows, "id", 500_000.0)
    assert w.count() == (distances(xy, xy) <= 500_000.0).sum() - len(xy)
    one, two = agg.moran_index(rows, w, "id", "v").first(), agg.moran_within(rows, "id", "v", 500_000.0).first()
    assert all(abs(one[c] - two[c]) < 1e-9 for c in ("index", "expected", "variance", "z", "p"))


def test_snapping_by_growing_circles(spark):
    """Scattered points and a crowded reference: the nearest position within the tolerance, found in circles that grow."""
    a, b = spread_points(80, 4)[:70], spread_points(300, 5)[:260]
    from tellurion.functions import geodesic as geo
    from tellurion.functions import types as T

    i, j = np.meshgrid(np.arange(len(a)), np.arange(len(b)), indexing="ij")
    d = geo.inverse(a[i.ravel(), 0], a[i.ravel(), 1], b[j.ravel(), 0], b[j.ravel(), 1])[0].reshape(i.shape)
    left = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(a)], "id long, lon double, lat double")
    right = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(b)], "sid long, x double, y double").select("sid", T.point("x", "y").alias("geom"))
    for tolerance in (0.0, 300_000.0):
        got = {r["id"]: (r["x"], r["y"]) for r in joins.snap_points(left, right, "id", "sid", tolerance).collect()}
        for k in range(len(a)):
            n = int(d[k].argmin())
            assert np.allclose(got[k], b[n] if d[k, n] <= tolerance else a[k], atol=1e-12)
