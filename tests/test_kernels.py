"""Kernels over batches, distances between tables, and options, against plain computations."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tellurion.functions import crs, helpers, measure
from tellurion.functions import geodesic as geo
from tellurion.functions import types as T
from tellurion.functions import udfs as u
from tellurion.operators import geodetic as g
from tellurion.operators import joins, tables
from tellurion.plans import views as V

SF = "/root/testdata/sf0.001"


def geoms():
    ring = np.array([[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]], float)
    hole = np.array([[0.5, 0.5], [0.5, 1], [1, 1], [1, 0.5], [0.5, 0.5]], float)
    return [("Polygon", [[ring, hole]]), None, ("LineString", [[ring[:3]]]), ("MultiPolygon", [[ring], [ring + 5, hole + 5]]), ("Point", [[ring[:1]]]), ("MultiPoint", [])]


def same(a, b):
    return (a is None) == (b is None) and (a is None or (a[0] == b[0] and len(a[1]) == len(b[1]) and all(len(p) == len(q) and all(np.array_equal(x, y) for x, y in zip(p, q, strict=True)) for p, q in zip(a[1], b[1], strict=True))))


@pytest.mark.parametrize(("lo", "n"), [(0, 6), (1, 3), (2, 4), (5, 1), (6, 0)])
def test_batches_survive_arrow(lo, n):
    """Geometries to Arrow and back, slices of a larger array included."""
    arr = u.Batch.from_geoms(geoms()).arrow()
    assert arr.type == u.ARROW and all(map(same, u.Batch.of(arr).geoms(), geoms()))
    cut = arr.slice(lo, n)
    assert all(map(same, u.Batch.of(cut).geoms(), geoms()[lo : lo + n]))
    again = u.Batch.of(pa.concat_arrays([cut, arr]))
    assert len(again.geoms()) == n + 6 and all(map(same, again.geoms()[n:], geoms()))


def test_measures_of_batches():
    b = u.Batch.from_geoms(geoms())
    area, length = u._area(b), u._length(b)
    for v, a, s in zip(geoms(), area, length, strict=True):
        if v is None:
            continue
        assert a == pytest.approx(geo.area(v[1]) if "Polygon" in v[0] else 0.0, rel=1e-12)
        assert s == pytest.approx(0.0 if "Point" in v[0] else sum(geo.inverse(r[:-1, 0], r[:-1, 1], r[1:, 0], r[1:, 1])[0].sum() for p in v[1] for r in p), rel=1e-12)


def test_nulls_and_empty_tables(spark):
    rows = spark.range(3).select("id", F.when(F.col("id") != 1, T.point(F.col("id") + 110.0, F.lit(30.0))).alias("g"), F.when(F.col("id") != 2, F.lit(1000.0)).alias("d"))
    out = {r["id"]: r for r in rows.select("id", u.buffer("g", F.col("d")).alias("b"), u.translate("g", F.col("d"), F.lit(90.0)).alias("t"), u.geodesic_area("g").alias("a"), u.circle(F.col("id") + 100.0, F.lit(20.0), F.col("d")).alias("c")).collect()}
    assert [out[i]["b"] is None for i in range(3)] == [False, True, True] == [out[i]["t"] is None for i in range(3)]
    assert [out[i]["c"] is None for i in range(3)] == [False, False, True] and [out[i]["a"] for i in range(3)] == [0.0, None, 0.0]
    assert rows.limit(0).select(u.buffer("g", F.col("d")), u.validate("g"), u.geodesic_length("g")).collect() == []


def test_buffer_options(spark):
    line = ("LineString", [[np.array([[110.0, 30.0], [112.0, 31.0], [113.0, 30.5]])]])
    s = geo.inverse(110, 30, 112, 31)[0] + geo.inverse(112, 31, 113, 30.5)[0]
    want = 2 * 5000 * s + math.pi * 5000**2
    areas = {}
    for edges in ("planar", "geodesic"):
        for method in ("geodesic", "projected"):
            areas[edges, method] = geo.area(g.densified(g.buffer(line, 5000.0, edges=edges, method=method))[1])
            assert areas[edges, method] == pytest.approx(want, rel=0.01)
    coarse = g.buffer(line, 5000.0, steps=2, tolerance=5.0)
    assert len(g.rings(coarse)[0]) < len(g.rings(g.buffer(line, 5000.0))[0])
    with pytest.raises(ValueError, match="no such"):
        g.buffer(line, 1.0, method="round")
    # In another system: the circle about a shifted point, shifted.
    one = spark.range(1).select(T.point(F.lit(116.4), F.lit(39.9)).alias("g"))
    x, y = (float(v) for v in crs.convert(np.float64(116.4), np.float64(39.9), "GCJ-02", "WGS84"))
    ring = one.select(u.buffer("g", 1000.0, steps=4, crs="GCJ-02").alias("b")).first()["b"]["parts"][0][0]
    back = [crs.convert(np.float64(p["x"]), np.float64(p["y"]), "GCJ-02", "WGS84") for p in ring]
    assert len(ring) == 17 and max(abs(geo.inverse(x, y, float(a), float(b))[0] - 1000) for a, b in back) < 1e-3


def test_pivots(spark):
    rows = V.streets(spark, SF).limit(5)
    turned = u.rotate(u.rotate(F.col("geom"), F.lit(40.0), (100.0, 35.0)), F.lit(-40.0), (100.0, 35.0))
    grown = u.scale(u.scale(F.col("geom"), F.lit(2.0), (100.0, 35.0)), F.lit(0.5), (100.0, 35.0))
    for r in rows.select(T.positions_of(F.col("geom")).alias("a"), T.positions_of(turned).alias("b"), T.positions_of(grown).alias("c")).collect():
        for p, q, s in zip(r["a"], r["b"], r["c"], strict=True):
            assert (q["x"], q["y"]) == pytest.approx((p["x"], p["y"]), abs=1e-9)
            assert (s["x"], s["y"]) == pytest.approx((p["x"], p["y"]), abs=1e-9)


def street_arrays(spark):
    return {r["id"]: np.array([(p["x"], p["y"]) for p in r["geom"]["parts"][0][0]]) for r in V.streets(spark, SF).collect()}


def sampled(line, x, y, n=400):
    """Least distance from a point to dense samples of a line, and half a step."""
    s, az, _ = geo.inverse(line[:-1, 0], line[:-1, 1], line[1:, 0], line[1:, 1])
    px, py, _ = geo.direct(line[:-1, :1], line[:-1, 1:], az[:, None], s[:, None] * np.linspace(0, 1, n + 1))
    return geo.inverse(px, py, x, y)[0].min(), s.max() / n / 2


def test_nearest_line(spark):
    """Every supplier against dense samples of every street."""
    streets = street_arrays(spark)
    out = joins.nearest_line(V.supplier_pt(spark, SF), V.streets(spark, SF), "sid", "id", x="rlon", y="rlat", start=20_000.0).collect()
    points = {r["sid"]: (r["rlon"], r["rlat"]) for r in V.supplier_pt(spark, SF).collect()}
    assert {r["sid"] for r in out} == set(points)
    for r in out:
        best = min(sampled(v, *points[r["sid"]], 40)[0] for v in streets.values())
        own, step = sampled(streets[r["id"]], *points[r["sid"]])
        assert r["distance"] <= best + 1e-6 and own - step - 1 <= r["distance"] <= own + 1e-6
        assert geo.inverse(r["x"], r["y"], *points[r["sid"]])[0] == pytest.approx(r["distance"], abs=1e-6)


def test_nearest_point_to_line(spark):
    line = np.array([(80.0, 20.0), (100.0, 35.0), (130.0, 50.0)])
    pts = V.customer_pt(spark, SF).collect()
    got = joins.nearest_point_to_line(V.customer_pt(spark, SF), T.line_string(T.ring(line.tolist())), "id").first()
    d = {r["id"]: sampled(line, r["lon"], r["lat"], 800)[0] for r in pts}
    assert got["distance"] <= min(d.values()) + 1e-6 and d[got["id"]] == pytest.approx(got["distance"], rel=0.05, abs=3000)


def test_nearest_k_is_complete(spark):
    """Widening circles against all distances, from a start that holds nothing."""
    a, b = V.customer_pt(spark, SF).collect(), V.supplier_pt(spark, SF).collect()
    want = {r["id"]: sorted((float(measure.rhumb_distance(np.float64(r["lon"]), np.float64(r["lat"]), np.float64(s["rlon"]), np.float64(s["rlat"]), "meters")), s["sid"]) for s in b)[:3] for r in a}
    got = {}
    for r in joins.nearest_k(V.customer_pt(spark, SF), V.supplier_pt(spark, SF), "id", "sid", 3).collect():
        got.setdefault(r["id"], {})[r["rank"]] = (r["distance"], r["sid"])
    for i, w in want.items():
        assert [got[i][k][1] for k in (1, 2, 3)] == [s for _, s in w] and [got[i][k][0] for k in (1, 2, 3)] == pytest.approx([d for d, _ in w], abs=1e-5)


def test_snap_to_segments(spark):
    streets = V.streets(spark, SF).filter("id < 3")
    mid = {k: v[:2].mean(0) for k, v in street_arrays(spark).items() if k < 3}
    pts = spark.createDataFrame([(k, float(p[0]), float(p[1]) + 0.001) for k, p in mid.items()] + [(99, 10.0, 10.0)], "id long, lon double, lat double")
    out = {r["id"]: r for r in joins.snap_points(pts, streets.withColumnRenamed("id", "street"), "id", "street", 2000.0).collect()}
    assert not out[99]["moved"] and (out[99]["x"], out[99]["y"]) == (10.0, 10.0)
    for k, p in mid.items():
        assert out[k]["moved"] and sampled(street_arrays(spark)[k], out[k]["x"], out[k]["y"], 20000)[0] < 20
        assert geo.inverse(out[k]["x"], out[k]["y"], *p)[0] < 2000


def test_network_ends(spark):
    deg = 1 / 111_000
    lines = [(1, [(0, 0), (1, 0)]), (2, [(0.5, 1), (0.5, 50 * deg)]), (3, [(0.2, -1), (0.2, 30 * deg)]), (4, [(0.8, 1), (0.8, 0.5)])]
    df = spark.createDataFrame([(k, [{"x": float(x), "y": float(y)} for x, y in v]) for k, v in lines], "id long, p array<struct<x:double,y:double>>").select("id", T.line_string(F.col("p")).alias("geom"))
    out = {(r["code"], r["line"]): r["distance"] for r in tables.network_ends(df, "id", max_undershoot=100.0, max_overshoot=100.0, size=0.5).collect()}
    assert set(out) == {("undershoot", 2), ("undershoot", 3), ("overshoot", 3)}
    assert out["undershoot", 2] == pytest.approx(50, abs=1) and out["overshoot", 3] == pytest.approx(30, abs=1)


def test_masked_grids_and_interpolation(spark):
    box = (100.0, 30.0, 101.0, 31.0)
    mask = spark.range(1).select(T.polygon(F.array(T.ring([(100.0, 30.0), (100.5, 30.0), (100.5, 30.5), (100.0, 30.5), (100.0, 30.0)]))).alias("geom"))
    for kind in ("square", "hex", "triangle", "point"):
        every = tables.grid(spark, box, 20_000.0, kind).count()
        some = tables.grid_masked(spark, box, 20_000.0, mask, kind).count()
        assert 0 < some < every * 0.6, kind
    pts = spark.createDataFrame([(100.1 + 0.1 * i, 30.1 + 0.1 * j, float(i + j)) for i in range(8) for j in range(8)], "lon double, lat double, v double")
    out = tables.interpolate(pts, box, 20_000.0, "v", 30_000.0).collect()
    assert len(out) > 10 and all(0 <= r["z"] <= 14 for r in out) and len({(r["i"], r["j"]) for r in out}) == len(out)
    corner = min(out, key=lambda r: (r["i"], r["j"]))
    assert corner["z"] < 4


def test_invariants(spark):
    one = spark.range(1)
    assert one.select(helpers.get_coord(T.point(F.lit(1.0), F.lit(2.0))).alias("p")).first()["p"]["y"] == 2.0
    assert one.select(helpers.contains_number(F.array(F.lit(1.0), F.lit(2.0)))).first()[0] and not one.select(helpers.contains_number(F.array(F.lit(1.0), F.lit(float("nan"))))).first()[0]
    assert one.select(helpers.validate_bbox(F.array(*map(F.lit, (1.0, 2.0, 3.0, 4.0)))).alias("b")).first()["b"] == [1.0, 2.0, 3.0, 4.0]
    for bad in (helpers.validate_bbox(F.array(F.lit(1.0))), helpers.get_coord(T.line_string(T.ring([(0, 0), (1, 1)]))), helpers.require_kind(T.point(F.lit(1.0), F.lit(2.0)), "Polygon")):
        with pytest.raises(Exception, match="not a|a box has"):
            one.select(bad).collect()


def test_feet_of_long_and_short_segments():
    rng = np.random.default_rng(3)
    a = rng.uniform((70, -60), (130, 60), (40, 2))
    b = a + rng.normal(0, 1, (40, 2)) * 10.0 ** rng.uniform(-4, 1, (40, 1))
    p = a + rng.normal(0, 3, (40, 2))
    x, y, d, t = geo.feet(*a.T, *b.T, *p.T)
    for k in range(40):
        near, step = sampled(np.array([a[k], b[k]]), *p[k], 5000)
        assert near - step - 1e-6 <= d[k] <= near + 1e-6


def test_transform_keeps_shapes(spark):
    rows = V.pentagons(spark, SF).select("geom", crs.transform(crs.transform(F.col("geom"), "WGS84", "EPSG:4549"), "EPSG:4549", "WGS84").alias("back"))
    for r in rows.collect():
        for p, q in zip(r["geom"]["parts"][0][0], r["back"]["parts"][0][0], strict=True):
            assert (p["x"], p["y"]) == pytest.approx((q["x"], q["y"]), abs=1e-8)
