"""Prepared areas against a ray cast over whole rings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tellurion.operators import planar as pl
from tellurion.operators import prepared as pr


def areas(spark, shapes):
    rows = [(k, {"kind": "MultiPolygon", "parts": [[[{"x": float(x), "y": float(y)} for x, y in r] for r in part] for part in parts]}) for k, parts in shapes.items()]
    return spark.createDataFrame(rows, "zone long, geom struct<kind:string,parts:array<array<array<struct<x:double,y:double>>>>>")


def star(n, mx, my, size, seed):
    rng = np.random.default_rng(seed)
    t = np.linspace(0, 2 * np.pi, n, endpoint=False)
    r = size * (0.5 + 0.5 * rng.random(n))
    return pl.closed(np.stack([mx + r * np.cos(t), my + r * np.sin(t)], axis=1))


def box(x, y, w, h):
    return np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)], float)


def even_odd(parts, pts):
    segs = np.concatenate([np.concatenate([r[:-1], r[1:]], axis=1) for part in parts for r in part])
    odd = np.zeros(len(pts), bool)
    for ax, ay, bx, by in segs:
        hit = (ay > pts[:, 1]) != (by > pts[:, 1])
        with np.errstate(all="ignore"):
            odd ^= hit & (pts[:, 0] < ax + (bx - ax) * (pts[:, 1] - ay) / (by - ay))
    return odd


SHAPES = {
    1: [[star(3000, 110.0, 30.0, 2.0, 1)]],
    2: [[star(400, 111.0, 30.5, 0.7, 2), pl.closed(star(60, 111.0, 30.5, 0.2, 3))]],
    3: [[box(108, 28, 6, 5), box(109, 29, 1, 1)], [box(113, 27, 3, 3)]],
    4: [[box(110.25, 30.25, 0.5, 0.5)]],
    5: [[np.array([(109, 31), (111, 31.5), (113, 31), (111, 33), (109, 31)], float)]],
}


def test_same_as_rays(spark):
    rng = np.random.default_rng(9)
    pts = np.concatenate([rng.random((4000, 2)) * [9, 8] + [107.5, 26], rng.random((1500, 2)) * 0.6 + [110.2, 30.2]])
    own = spark.createDataFrame([(i, float(x), float(y), "mine") for i, (x, y) in enumerate(pts)] + [(-1, None, 3.0, "null")], "id long, lon double, lat double, level string")
    made = pr.prepare(areas(spark, SHAPES), "zone")
    got = {(r["id"], r["zone"]) for r in pr.contained(own, made, "zone").collect()}
    want = {(int(i), k) for k, parts in SHAPES.items() for i in np.flatnonzero(even_odd(parts, pts))}
    assert got == want
    assert pr.contained(own, made, "zone").columns == ["id", "lon", "lat", "level", "zone"]


def test_few_edges_are_asked(spark):
    """A star of twenty thousand corners: a point in a boundary cell meets a few edges, and most cells are inner."""
    made = pr.prepare(areas(spark, {1: [[star(20000, 110.0, 30.0, 2.0, 5)]], 2: [[box(100, 20, 8, 8)]]}), "zone")
    row = made.edge.filter("id = 1").agg(F.avg(F.size("edges")).alias("mean"), F.count(F.lit(1)).alias("n")).first()
    assert row["mean"] < 60 and row["n"] <= 40000
    assert made.inner.filter("id = 1").count() > 200


@pytest.mark.parametrize("ignore,hits", [(False, {0, 1, 2, 3}), (True, {3})])
def test_boundary(spark, ignore, hits):
    own = spark.createDataFrame([(0, 110.25, 30.5), (1, 110.25, 30.25), (2, 110.5, 30.75), (3, 110.5, 30.5), (4, 110.76, 30.5)], "id long, lon double, lat double")
    out = pr.contained(own, pr.prepare(areas(spark, {4: SHAPES[4]}), "zone"), "zone", ignore_boundary=ignore)
    assert {r["id"] for r in out.collect()} == hits


def test_no_areas(spark):
    own = spark.createDataFrame([(0, 110.25, 30.5)], "id long, lon double, lat double")
    assert pr.contained(own, pr.prepare(areas(spark, SHAPES).limit(0), "zone"), "zone").count() == 0


def test_points_at_the_rounding_of_an_edge(spark, tmp_path):
    """Customers so near a pentagon's edge that only the ray's own rounding tells their side, and points at a flat edge's height."""
    from tellurion.operators.joins import points_in_regions
    from tellurion.plans import views as V

    spark.createDataFrame([(k, f"n{k}", 0) for k in range(25)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(k, 0.0, 0, "s") for k in (40195, 59685, 79175, 1570, 82840)], "c_custkey long, c_acctbal double, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    points, zones = V.customer_pt(spark, str(tmp_path)), V.pentagons(spark, str(tmp_path))
    same = lambda df: sorted(tuple(r) for r in df.select("id", "zone").collect())
    assert same(pr.contained(points, pr.prepare(zones, "zone"), "zone")) == same(points_in_regions(points, zones))
    flat = {k: [[np.array(ring, float)[::way]]] for k, (ring, way) in enumerate((r, w) for r in ([(0, 1), (5, 1), (6, 3), (0, 3), (0, 1)], [(0, 1), (5, 1), (6, -1), (0, -1), (0, 1)], [(0, 0), (2, 0), (2, 1), (5, 1), (5, 2), (0, 2), (0, 0)]) for w in (1, -1))}
    pts = [(x / 8, y / 4) for x in range(-4, 56) for y in range(-8, 16)]
    own = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pts)], "id long, lon double, lat double")
    zones = areas(spark, flat)
    assert same(pr.contained(own, pr.prepare(zones, "zone"), "zone")) == same(points_in_regions(own, zones))
