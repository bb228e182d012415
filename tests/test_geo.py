"""Closed forms, invariants and round trips of the spatial operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tellurion.functions import crs
from tellurion.functions import geodesic as geo
from tellurion.functions import helpers, measure, shapes, units
from tellurion.functions import types as T
from tellurion.operators import delaunay, joins
from tellurion.operators import geodetic as g
from tellurion.operators import planar as pl


def square(x0, y0, x1, y1):
    return "Polygon", [[np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]], float)]]


def area(x):
    """With planar edges, which is how results are meant."""
    return geo.area(g.densified(x)[1]) if x else 0.0


def test_geodesic_scalars():
    assert geo.inverse(-73.78, 40.64, 103.99, 1.36)[0] == pytest.approx(15347512.94051294, abs=1e-6)
    assert geo.inverse(116.4, 39.9, 121.47, 31.23)[0] == pytest.approx(1065615.457, abs=1e-3)
    assert geo.inverse(0, 0, 180, 0)[0] == pytest.approx(20003931.4586, abs=1e-3)
    assert geo.inverse(0, 0, 1, 0)[0] == pytest.approx(math.radians(1) * 6378137)
    assert geo.area(square(0, 0, 1, 1)[1]) == pytest.approx(12308778361.469452, rel=1e-11)


def test_geodesic_round_trip():
    rng = np.random.default_rng(2)
    a = [rng.uniform(-180, 180, 500), rng.uniform(-89, 89, 500), rng.uniform(-180, 180, 500), rng.uniform(-89, 89, 500)]
    s, z, _ = geo.inverse(*a)
    x, y, _ = geo.direct(a[0], a[1], z, s)
    assert geo.inverse(x, y, a[2], a[3])[0].max() < 1e-5


def test_planar_measures(spark):
    line = T.line_string(T.ring([(116.4, 39.9), (117, 40), (118, 40.5)]))
    poly = T.polygon(F.array(T.ring([(116, 39), (117, 39), (117, 40), (116, 40), (116, 39)])))
    row = spark.range(1).select(measure.length(line, "meters").alias("l"), measure.area(poly).alias("a"), measure.rhumb_distance(F.lit(116.4), F.lit(39.9), F.lit(121.47), F.lit(31.23), "meters").alias("d"), measure.rhumb_bearing(F.lit(116.4), F.lit(39.9), F.lit(121.47), F.lit(31.23)).alias("b")).first()
    assert row["l"] == pytest.approx(154055.838, abs=1e-2) and row["a"] == pytest.approx(9549520094.03, rel=1e-9)
    assert row["d"] == pytest.approx(1065733.567, abs=1e-2) and row["b"] == pytest.approx(154.50443, abs=1e-5)


@pytest.mark.parametrize("name", ["GCJ-02", "baidu", "EPSG:4549", "EPSG:4528", "EPSG:32650", "web mercator"])
def test_crs_round_trip(name):
    rng = np.random.default_rng(0)
    lon, lat = rng.uniform(115, 121, 200), rng.uniform(20, 50, 200)
    x, y = crs.convert(*crs.convert(lon, lat, "WGS84", name), name, "WGS84")
    assert np.abs(x - lon).max() < 1e-9 and np.abs(y - lat).max() < 1e-9


def test_crs_names():
    assert crs.gauss_kruger_crs(120.3).name == "EPSG:4549" and crs.gauss_kruger_crs(120.3, 3, True).name == "EPSG:4528"
    assert crs.utm_crs(116.4, 39.9).name == "EPSG:32650" and crs.normalize_crs("amap").name == "GCJ02"
    with pytest.raises(ValueError):
        crs.normalize_crs("nowhere")


def test_units(spark):
    row = spark.range(1).select(units.convert_length(F.lit(1.0), "miles", "kilometers"), units.convert_length(F.lit(1.0), "nauticalmiles", "meters"), units.convert_area(F.lit(10000.0), "meters", "hectares"), units.azimuth_to_bearing(F.lit(270.0))).first()
    assert [round(v, 4) for v in row] == [1.6093, 1852.0, 1.0, -90.0]
    with pytest.raises(Exception, match="positive"):
        spark.range(1).select(units.convert_length(F.lit(-1.0))).collect()


def test_overlay_identities():
    a, b = square(120, 30, 121, 31), square(120.5, 30.5, 121.5, 31.5)
    u, i, d, x = g.union(a, b), g.intersect(a, b), g.difference(a, b), g.xor(a, b)
    assert abs(area(u) + area(i) - area(g.densified(a)) - area(g.densified(b))) / area(u) < 1e-6
    assert area(d) + area(i) == pytest.approx(area(g.densified(a)), rel=1e-6) and area(x) == pytest.approx(area(u) - area(i), rel=1e-6)
    assert len(i[1][0][0]) == 5 and g.intersect(a, square(130, 30, 131, 31)) is None
    holed = pl.difference(square(0, 0, 4, 4)[1], square(1, 1, 2, 2)[1])
    assert pl.area(holed) == 15 and len(holed[0]) == 2


def test_buffer():
    c = g.buffer(("Point", [[np.array([[120.0, 30.0]])]]), 1000)
    assert area(c) == pytest.approx(math.pi * 1e6, rel=2e-3)
    s = square(120, 30, 120.01, 30.01)
    grown, shrunk = g.buffer(s, 100.0), g.buffer(s, -100.0)
    edge = geo.inverse(s[1][0][0][:-1, 0], s[1][0][0][:-1, 1], s[1][0][0][1:, 0], s[1][0][0][1:, 1])[0].sum()
    assert area(grown) == pytest.approx(area(s) + edge * 100 + math.pi * 1e4, rel=1e-3)
    assert area(shrunk) == pytest.approx(area(s) - edge * 100 + 4e4, rel=1e-3)
    assert g.buffer(square(120, 30, 120.001, 30.001), -500) is None


def test_relations():
    p = "Polygon"
    sq = lambda *v: square(*v)[1]
    assert pl.relate(p, sq(0, 0, 4, 4), p, sq(1, 1, 2, 2)) == "212FF1FF2"
    assert pl.relate(p, sq(0, 0, 1, 1), p, sq(1, 0, 2, 1)) == "FF2F11212"
    assert pl.relate(p, sq(0, 0, 2, 2), p, sq(1, 1, 3, 3)) == "212101212"
    assert pl.relate("LineString", [[np.array([[-1, 1], [3, 1.0]])]], p, sq(0, 0, 2, 2)) == "101FF0212"


def test_relation_names(spark):
    m = lambda text, name, a=2, b=2: spark.range(1).select(shapes.boolean_relation(F.lit(text), name, a, b)).first()[0]
    assert m("212FF1FF2", "contains") and m("212FF1FF2", "covers") and not m("212FF1FF2", "within") and m("FF2F11212", "touches")
    assert m("212101212", "overlap") and m("101FF0212", "crosses", 1, 2) and m("2FFF1FFF2", "equal") and m("FF2FF1212", "disjoint")
    assert spark.range(1).select(shapes.relate_pattern(F.lit("212FF1FF2"), "T*****FF*")).first()[0]


def test_validity():
    bow = "Polygon", [[np.array([[0, 0], [2, 2], [2, 0], [0, 2], [0, 0]], float)]]
    assert "self-intersection" in {c for c, *_ in g.validate(bow)} and len(g.unkinked(bow)) == 2
    assert g.validate(square(0, 0, 1, 1)) == []
    turned = "Polygon", [[square(0, 0, 1, 1)[1][0][0][::-1]]]
    assert [c for c, *_ in g.validate(turned)] == ["wrong-winding"] and "rewound" in g.make_valid(turned)[1]


def test_lines():
    line = np.array([[116, 40], [117, 40], [117, 41]], float)
    point, d, at, k = g.nearest_on_line(line, (116.5, 40.2))
    assert k == 0 and d == pytest.approx(float(geo.inverse(*point, 116.5, 40.2)[0]), abs=1e-6)
    total = g._measures(line)[0][-1]
    assert sum(g._measures(c)[0][-1] for c in g.line_chunk(line, 30000)) == pytest.approx(total, abs=1e-3)
    assert g._measures(g.line_slice_along(line, 50000, 20000))[0][-1] == pytest.approx(30000, abs=1e-3)
    assert g.point_to_polygon(square(120, 30, 121, 31), (120.5, 30.5)) < 0
    zig = np.stack([np.linspace(120, 120.1, 200), 30 + 4.5e-6 * (-1.0) ** np.arange(200)], axis=1)
    assert len(g.rings(g.simplified(("LineString", [[zig]]), 5.0))[0]) < 10 and len(g.rings(g.simplified(("LineString", [[zig]]), 0.05))[0]) > 100


def test_sets():
    p = np.random.default_rng(0).random((200, 2))
    tri, hull = delaunay.delaunay(p), pl.convex_hull(p)
    assert len(tri) == 2 * 200 - 2 - (len(hull) - 1)
    holed = pl.difference(square(0, 0, 4, 4)[1], square(1, 1, 2, 2)[1])
    assert sum(abs(pl.ring_sum(t)) for t in pl.tesselate(holed[0])) == pytest.approx(15)
    wall = square(120.15, 29.9, 120.2, 30.1)
    path = g.shortest_path((120, 30), (120.4, 30), [wall], 2000)
    assert geo.inverse(path[:-1, 0], path[:-1, 1], path[1:, 0], path[1:, 1])[0].sum() > 1.02 * geo.inverse(120, 30, 120.4, 30)[0]
    assert len(g.shortest_path((120, 31), (120.4, 31), [wall], 2000)) == 2


def test_point_in_polygon_boundary(spark):
    poly = T.polygon(F.array(T.ring([(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)])))
    at = lambda x, y, i=False: spark.range(1).select(shapes.point_in_polygon(F.lit(float(x)), F.lit(float(y)), poly, i)).first()[0]
    assert at(1, 1) and at(2, 1) and not at(2, 1, True) and not at(3, 1)


def test_joins_plan_no_nested_loop(spark):
    pts = helpers.random_points(spark, 50, (0, 0, 10, 10))
    zones = spark.range(4).select(F.col("id").alias("zone"), T.polygon(F.array(T.ring([(0, 0), (5, 0), (5, 5), (0, 5), (0, 0)]))).alias("geom"))
    plan = joins.points_in_regions(pts, zones)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_tables(spark):
    from tellurion.operators import tables as tb

    cells = spark.range(12).select(F.col("id").alias("fid"), (F.col("id") % 2).alias("p"), T.polygon(F.array(F.array(*[T.position(120 + (F.col("id") + a) * 0.01, F.lit(30 + b)) for a, b in ((0, 0.0), (1, 0.0), (1, 0.01), (0, 0.01), (0, 0.0))]))).alias("geom"))
    whole = tb.union_by(cells, None).select(F.size("geom.parts"), F.size(T.positions_of(F.col("geom")))).first()
    assert tuple(whole) == (1, 5)
    assert [tuple(r) for r in tb.dissolve(cells, "p").select("p", "fid", F.size("geom.parts")).orderBy("p").collect()] == [(0, 0, 6), (1, 1, 6)]
    assert tb.coverage_overlaps(cells, "fid").count() == 0 and tb.coverage_gaps(cells, "fid").count() == 0
    ring = [(0.005 * math.cos(k * math.pi / 4), 0.005 * math.sin(k * math.pi / 4)) for k in range(8)]
    pts = [(k, 120 + c + x, 30 + y) for c in (0, 0.1) for k, (x, y) in enumerate(ring, 10 * int(c * 10))] + [(99, 120.5, 30.5)]
    roles = {r["id"]: (r["role"], r["cluster"]) for r in tb.dbscan(spark.createDataFrame(pts, "id long, lon double, lat double"), "id", 500.0).collect()}
    assert roles[99] == ("noise", None) and {c for r, c in roles.values() if c is not None} == {0, 1}


def test_streaming_geofence(spark, tmp_path):
    from tellurion.plans import views as V
    from tellurion.streaming.geofence import zone_counts

    sf = "/root/testdata/sf0.001"
    x, y = V.pt("event_id")
    rows = V.table(spark, sf, "events")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")).select("ts", x.alias("lon"), y.alias("lat"))
    query = zone_counts(stream, V.zones(spark, sf)).writeStream.format("memory").queryName("fence").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    want = zone_counts(rows.select("ts", x.alias("lon"), y.alias("lat")), V.zones(spark, sf))
    assert sorted(map(tuple, spark.table("fence").collect())) == sorted(map(tuple, want.collect()))


def test_geojson(spark):
    from tellurion.sources import geojson as gj

    doc = '{"type":"FeatureCollection","features":[{"type":"Feature","id":7,"properties":{"a":1},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}},{"type":"Feature","properties":null,"geometry":{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1,2,3]},{"type":"LineString","coordinates":[[0,0],[1,1]]}]}}]}'
    rows = gj.parse_features(spark.createDataFrame([(doc,)], "value string")).select("fid", "member", "id", gj.to_geojson(F.col("geom")).alias("g")).collect()
    assert [(r["fid"], r["member"], r["id"]) for r in rows] == [(0, 0, "7"), (1, 0, None), (1, 1, None)]
    assert rows[1]["g"] == '{"type":"Point","coordinates":[1.0,2.0]}'


def test_oracles(spark):
    """Every query with SQL, on the smallest tables."""
    import glob
    import os

    import duckdb

    from tellurion.plans.queries import QUERIES, SQL

    con = duckdb.connect()
    for f in glob.glob("/root/testdata/sf0.001/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    for name, sql in SQL.items():
        a, b = QUERIES[name](spark, "/root/testdata/sf0.001"), con.execute(sql)
        cols = [d[0] for d in b.description]
        assert sorted(a.columns) == sorted(cols), name
        key = lambda row: tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in row)
        assert sorted(map(str, map(key, (tuple(r[c] for c in cols) for r in a.collect())))) == sorted(map(str, map(key, b.fetchall()))), name
