"""Joins and clusters on data that is spread unevenly, against brute force, with the rows that they list."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tellurion.functions import crs, measure
from tellurion.functions import types as T
from tellurion.operators import joins, tables


def squares(spark, rows):
    df = spark.createDataFrame([tuple(map(float, r[1:])) + (r[0],) for r in rows], "x0 double, y0 double, w double, zone long")
    x, y, w = F.col("x0"), F.col("y0"), F.col("w")
    return df.select("zone", T.polygon(F.array(T.ring([(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]))).alias("geom"))


ZONES = [(i, 100 + i % 10 * 0.02, 30 + i // 10 * 0.02, 0.015) for i in range(60)] + [(100, 98, 28, 15.0), (101, 100.05, 30.01, 0.3)]


def test_one_region_far_larger(spark):
    """A region a thousand times as wide as the others is listed in four cells at most."""
    zones = squares(spark, ZONES).withColumn("box", T.bbox(F.col("geom")))
    rows = joins.listed(zones, "box", joins.level_of(F.col("box")), ("m", "cx", "cy"))
    assert rows.groupBy("zone").count().agg(F.max("count")).first()[0] <= 4
    assert len(joins.levels_in_use(rows.select("m"))) == 3


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_levels_change_no_result(spark, how):
    rng = np.random.default_rng(1)
    pts = [(i, float(x), float(y), "kept") for i, (x, y) in enumerate(rng.random((300, 2)) * [0.4, 0.2] + [99.9, 29.95])] + [(900, 5.0, 5.0, "far"), (901, None, 30.0, "null"), (902, 110.0, 40.0, "large only")]
    points = spark.createDataFrame(pts, "id long, lon double, lat double, _px string")
    inside = {(p, z) for p, x, y, _ in pts if x is not None for z, a, b, w in ZONES if a <= x <= a + w and b <= y <= b + w}
    out = joins.points_in_regions(points, squares(spark, ZONES), how=how)
    assert "_px" in out.columns and not any(c.startswith("__") for c in out.columns)
    hit = {p for p, _ in inside}
    if how == "left_semi":
        assert sorted(r["id"] for r in out.collect()) == sorted(hit)
    elif how == "left_anti":
        assert sorted(r["id"] for r in out.collect()) == sorted(p[0] for p in pts if p[0] not in hit)
    else:
        want = sorted([*inside, *((p[0], -1) for p in pts if how == "left" and p[0] not in hit)])
        assert sorted((r["id"], -1 if r["zone"] is None else r["zone"]) for r in out.collect()) == want


def test_no_regions(spark):
    points = spark.createDataFrame([(1, 2.0, 3.0)], "id long, lon double, lat double")
    none = squares(spark, ZONES).limit(0)
    assert [joins.points_in_regions(points, none, how=h).count() for h in ("inner", "left", "left_semi", "left_anti")] == [0, 1, 0, 1]


def test_boxes_of_all_sizes(spark):
    rng = np.random.default_rng(4)
    boxes = [(i, float(x), float(y), float(w)) for i, (x, y, w) in enumerate(zip(*(rng.random((2, 120)) * 10), 10.0 ** rng.uniform(-3, 1, 120), strict=True))]
    df = spark.createDataFrame(boxes, "id long, x double, y double, w double").select("id", F.struct(F.col("x").alias("xmin"), F.col("y").alias("ymin"), (F.col("x") + F.col("w")).alias("xmax"), (F.col("y") + F.col("w")).alias("ymax")).alias("box"))
    got = [tuple(r) for r in joins.boxes_join(df.toDF("a", "lbox"), df.toDF("b", "rbox"), 0.01).select("a", "b").collect()]
    want = {(i, j) for i, x, y, w in boxes for j, u, v, s in boxes if x <= u + s and u <= x + w and y <= v + s and v <= y + w}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("k", [1, 5])
def test_neighbours_of_a_cluster_and_a_far_point(spark, monkeypatch, k):
    """Two thousand points within ten metres and one far off: as many pairs as targets times a few, not their square."""
    rng = np.random.default_rng(2)
    pts = np.concatenate([rng.random((2000, 2)) * 1e-4 + [110, 35], [[75.0, 20.0]], np.repeat([[111.0, 36.0]], 40, axis=0)])
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "pid long, rlon double, rlat double")
    targets = points.select(F.col("pid").alias("id"), F.col("rlon").alias("lon"), F.col("rlat").alias("lat"))
    landed = []
    keep = joins.land

    def counted(df):
        out = keep(df)
        if "tid" in out.columns:
            landed.append(out.agg(F.sum("m")).first()[0])
        return out

    monkeypatch.setattr(joins, "land", counted)
    out = joins.nearest_k(targets, points, "id", "pid", k)
    got = {}
    for r in out.collect():
        got.setdefault(r["id"], []).append((r["rank"], r["pid"]))
    assert len(got) == len(pts) and all(len(v) == k for v in got.values())
    # What the last round keeps is what is measured.
    assert landed[-1] <= 60 * k * len(pts)
    some = [0, 7, 1999, 2000, 2001, 2040]
    pairs = targets.filter(F.col("id").isin(some)).crossJoin(points).withColumn("d", measure.rhumb_distance(F.col("lon"), F.col("lat"), F.col("rlon"), F.col("rlat"), "meters"))
    every = {}
    for r in pairs.select("id", "pid", "d").collect():
        every.setdefault(r["id"], []).append((r["d"], r["pid"]))
    for i in some:
        assert [p for _, p in sorted(got[i])] == [p for _, p in sorted(every[i])[:k]], i


def test_neighbours_of_few(spark):
    targets = spark.createDataFrame([(1, 10.0, 10.0), (2, None, 1.0)], "id long, lon double, lat double")
    points = spark.createDataFrame([(5, 11.0, 10.0), (4, 11.0, 10.0), (6, None, None)], "pid long, rlon double, rlat double")
    assert [(r["id"], r["pid"], r["rank"]) for r in joins.nearest_k(targets, points, "id", "pid", 3).orderBy("rank").collect()] == [(1, 4, 1), (1, 5, 2)]
    assert joins.nearest_point(targets, points.limit(0), "id", "pid").count() == 0


def plain_dbscan(p, radius, least):
    near = ((p[:, None] - p[None]) ** 2).sum(2) <= radius * radius
    core = near.sum(1) >= least
    label = np.full(len(p), -1)
    k = 0
    for i in range(len(p)):
        if core[i] and label[i] < 0:
            todo = [i]
            label[i] = k
            while todo:
                j = todo.pop()
                for m in np.flatnonzero(near[j] & core & (label < 0)):
                    label[m] = k
                    todo.append(m)
            k += 1
    for i in np.flatnonzero(~core):
        own = label[near[i] & core]
        label[i] = own.min() if len(own) else -1
    return [("core" if c else "edge" if n >= 0 else "noise", None if n < 0 else int(n)) for c, n in zip(core, label, strict=True)]


@pytest.mark.parametrize("seed,least", [(0, 3), (1, 5), (2, 2)])
def test_dbscan(spark, seed, least):
    rng = np.random.default_rng(seed)
    p = np.concatenate([rng.normal(0, 0.002, (120, 2)) + [110, 30], rng.normal(0, 0.006, (80, 2)) + [110.03, 30.01], rng.random((60, 2)) * 0.1 + [109.97, 29.97], [[110.0, 30.0]] * 4])
    lon0 = (p[:, 0].min() + p[:, 0].max()) / 2
    plane = np.stack(crs.tmerc_forward(p[:, 0], p[:, 1], lon0), axis=1)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "id long, lon double, lat double")
    got = {r["id"]: (r["role"], r["cluster"]) for r in tables.dbscan(df, "id", 400.0, least).collect()}
    assert got == dict(enumerate(plain_dbscan(plane, 400.0, least)))


def test_dbscan_of_one_crowded_cell(spark, monkeypatch):
    """Thousands of points in one cell list rows in proportion; nothing and a point by itself work too."""
    rng = np.random.default_rng(7)
    p = np.concatenate([rng.random((4000, 2)) * 1e-5 + [110, 30], [[110.001, 30.0], [112.0, 31.0]]])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "id long, lon double, lat double")
    most, keep = [], tables.land

    def counted(df):
        out = keep(df)
        most.append(out.count())
        return out

    monkeypatch.setattr(tables, "land", counted)
    got = tables.dbscan(df, "id", 500.0).groupBy("role", "cluster").count().collect()
    assert {(r["role"], r["cluster"]): r["count"] for r in got} == {("core", 0): 4001, ("noise", None): 1}
    assert max(most) <= 15 * len(p)
    assert tables.dbscan(df.limit(0), "id", 500.0).count() == 0
    assert [r["role"] for r in tables.dbscan(df.filter("id = 4001"), "id", 500.0).collect()] == ["noise"]
