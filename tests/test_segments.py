"""Segments that meet cell by cell, and bounds of distances to them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tellurion.functions import geodesic as geo
from tellurion.operators import joins, segments
from tellurion.plans.queries import QUERIES, SQL


def lines(spark, rows):
    kind = "id long, geom struct<kind:string,parts:array<array<array<struct<x:double,y:double>>>>>"
    return spark.createDataFrame([(i, {"kind": "LineString", "parts": [[[{"x": float(x), "y": float(y)} for x, y in r]]]}) for i, r in rows], kind)


def customers(spark, folder, keys):
    spark.createDataFrame([(k, 1.0, 0, "s") for k in keys], "c_custkey long, c_acctbal double, c_nationkey int, c_mktsegment string").write.parquet(f"{folder}/customer.parquet")


@pytest.mark.parametrize("name", ["line_intersect", "network_issues"])
def test_ties_and_overlaps_as_in_sql(spark, tmp_path, name):
    """Places whose seventh decimal is a five, and two streets that lie on each other."""
    import duckdb

    customers(spark, tmp_path, [92, 25521, 141, 9306, 27838, 148, 7997, 164, 20693, 82, 35582])
    db = duckdb.connect()
    db.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    want = sorted(tuple(r) for r in db.execute(SQL[name]).fetchall())
    assert sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()) == want


def test_same_as_every_pair(spark, monkeypatch):
    """Lines of all lengths with a crowd in one place, dealt in blocks, and ids that aren't numbers."""
    monkeypatch.setattr(segments, "BLOCK", 8)
    rng = np.random.default_rng(4)
    at, size = rng.random((240, 2)) * 12 + [100, 20], 10.0 ** rng.uniform(-4, 1, 240)
    at[:80], size[:80] = [105, 25] + rng.random((80, 2)) * 0.02, 0.02
    rows = [(i, p + s * (rng.random((3, 2)) - 0.5)) for i, (p, s) in enumerate(zip(at, size, strict=True))]
    want = set()
    for a, one in rows:
        for b, two in rows[a + 1 :]:
            s, t = (np.concatenate([r[:-1], r[1:]], axis=1) for r in (one, two))
            want |= {(a, b, round(x, 9), round(y, 9)) for x, y in zip(*segments._meet(s, t, "touching")[2:], strict=True)}
    df = lines(spark, rows)
    for kind in (F.col("id"), F.lpad(F.col("id").cast("string"), 4, "0")):
        a = segments.flat(df.select(kind.alias("a"), "geom"), "geom", "a")
        met = segments.meetings(a, a.withColumnRenamed("a", "b"), ["a"], ["b"], 0.01, less=(["a"], ["b"]))
        got = [(int(r["a"]), int(r["b"]), round(r["x"], 9), round(r["y"], 9)) for r in met.collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_bounds_hold():
    """Great circles bound geodesics from both sides at any length and latitude."""
    rng = np.random.default_rng(8)
    n = 4000
    ax, ay = rng.uniform(-100, 100, n), rng.uniform(-88, 88, n)
    reach = 10.0 ** rng.uniform(-6, 1.3, n)
    bx, by = ax + reach * rng.uniform(-1, 1, n), np.clip(ay + reach * rng.uniform(-1, 1, n), -89, 89)
    px, py = (ax + bx) / 2 + reach * rng.uniform(-2, 2, n), np.clip((ay + by) / 2 + reach * rng.uniform(-2, 2, n), -89, 89)
    least, most = joins.segment_bounds(ax, ay, bx, by, px, py)
    d = geo.feet(ax, ay, bx, by, px, py)[2]
    assert (least <= d).all() and (d <= most).all()
    close = reach < 1
    assert (most[close] - least[close] <= 0.021 * d[close] + 0.03 * 111e3 * reach[close] + 4).all()


def test_ends_meet_what_is_near_them(spark):
    """A line that a thousand others cross: its ends are held against the few about them."""
    rows = [(0, [(100.0, 20.0), (110.0, 20.0)])] + [(k, [(100.0 + k * 0.01, 19.9), (100.0 + k * 0.01, 20.1)]) for k in range(1, 1000)]
    ends = spark.createDataFrame([(0, 100.0, 20.0), (0, 110.0, 20.0)], "line long, x double, y double")
    near = joins.overshoots(ends, lines(spark, rows), "id", 2500.0, 0.05, "proper").groupBy("x").count().collect()
    assert sorted((r["x"], r["count"]) for r in near) == [(100.0, 2), (110.0, 2)]
