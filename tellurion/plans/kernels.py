"""More registered queries over the kernels, each with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from tellurion.functions import crs, helpers, measure, shapes
from tellurion.functions import types as T
from tellurion.functions import udfs as u
from tellurion.operators import aggregates as agg
from tellurion.operators import contours, delaunay, joins, networks, prepared, tables
from tellurion.plans import geosql as G
from tellurion.plans import views as V
from tellurion.plans.queries import IN_PENTAGON, _NODES, _ZONE, _positions, query, r, rs, s_panels
from tellurion.plans.views import CUSTOMER, PENTAGONS, STREETS, SUPPLIER, TRACKS, ZONES
from tellurion.session import spread

# Along lines: each segment's geodesic length, where it begins on its line, and the line's whole length.
_ALONG = f"""{TRACKS}, e AS (SELECT user_id, i, px AS lon1, py AS lat1, qx AS lon2, qy AS lat2 FROM ts), {G.inverse('e', 'gi')},
cum AS MATERIALIZED (SELECT *, coalesce(sum(s12) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c0, sum(s12) OVER (PARTITION BY user_id ORDER BY i) AS c1, sum(s12) OVER (PARTITION BY user_id) AS total FROM gi)"""


def s_spot(want: str, name: str) -> str:
    """Tables that end in ``name``: want(user_id, k, d) with x and y, at distance d along each line; d is below the line's length."""
    return f"""{name}_o AS (SELECT w.*, c.lon1, c.lat1, c.az1 AS az, w.d - c.c0 AS s FROM {want} w JOIN cum c ON c.user_id = w.user_id AND w.d >= c.c0 AND w.d < c.c1), {G.direct(f'{name}_o', name)}"""


@query("along", f"WITH {_ALONG}, want AS (SELECT DISTINCT user_id, 0 AS k, 500000.0::DOUBLE AS d FROM cum), {s_spot('want', 'spot')} SELECT user_id, {rs('x')} AS x, {rs('y')} AS y FROM spot")
def along(spark, sf):
    return V.tracks(spark, sf).select("user_id", u.along(F.col("geom"), F.lit(500_000.0)).alias("p")).select("user_id", r(F.col("p.x")).alias("x"), r(F.col("p.y")).alias("y"))


def _pieces(sql_want: str) -> str:
    """Cuts of lines at (user_id, k, lo, hi), with the positions between, in order."""
    return f"""WITH {_ALONG}, pc AS MATERIALIZED ({sql_want}), want AS (SELECT user_id, k, lo AS d FROM pc UNION SELECT user_id, k + 1, hi FROM pc WHERE hi < total), {s_spot('want', 'spot')},
last AS (SELECT user_id, max_by(lon2, i) AS x, max_by(lat2, i) AS y FROM gi GROUP BY user_id),
v AS (SELECT pc.user_id, pc.k, lo AS d, 0 AS o, spot.x, spot.y FROM pc JOIN spot ON spot.user_id = pc.user_id AND spot.k = pc.k AND spot.d = lo
  UNION ALL SELECT pc.user_id, pc.k, c0, 1, lon1, lat1 FROM pc JOIN cum ON cum.user_id = pc.user_id AND c0 > lo + 1e-9 AND c0 < hi - 1e-9
  UNION ALL SELECT pc.user_id, pc.k, hi, 2, coalesce(spot.x, last.x), coalesce(spot.y, last.y) FROM pc JOIN last USING (user_id) LEFT JOIN spot ON spot.user_id = pc.user_id AND spot.d = hi AND spot.k = pc.k + 1)
SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY k, o = 2, d) - 1)::INT AS i, {rs('x', 5)} AS x, {rs('y', 5)} AS y FROM v"""


def _line_query(name: str, sql: str, *args):
    @query(name, sql)
    def f(spark, sf):
        out = getattr(u, name)(F.col("geom"), *[F.lit(float(a)) for a in args])
        rows = _positions(spread(V.tracks(spark, sf)).select("user_id", out.alias("geom")), "user_id", F.col("geom"))
        return rows.select("user_id", "i", r(F.col("x"), 5).alias("x"), r(F.col("y"), 5).alias("y"))


_line_query("line_slice_along", _pieces("SELECT DISTINCT user_id, 0 AS k, 1000.0::DOUBLE AS lo, least(500000.0::DOUBLE, total) AS hi, total FROM cum"), 1000, 500000)


@query("line_chunk", _pieces("SELECT user_id, k, k * 400000.0::DOUBLE AS lo, least((k + 1) * 400000.0::DOUBLE, total) AS hi, total FROM (SELECT user_id, total, unnest(range(ceil(total / 400000 - 1e-12)::BIGINT)) AS k FROM (SELECT DISTINCT user_id, total FROM cum))"))
def line_chunk(spark, sf):
    rows = u.line_chunk_positions(spread(V.tracks(spark, sf)), "user_id", 400_000.0)
    return rows.select("user_id", "i", r(F.col("x"), 5).alias("x"), r(F.col("y"), 5).alias("y"))



@query("line_slice", f"WITH {STREETS} SELECT id, (i - 1)::INT AS i, {rs('x')} AS x, {rs('y')} AS y FROM sv WHERE i > 0")
def line_slice(spark, sf):
    """From each street's bend to its end."""
    ps = T.positions_of(F.col("geom"))
    b, e = F.element_at(ps, 2), F.element_at(ps, 3)
    rows = spread(V.streets(spark, sf)).select("id", u.line_slice(F.col("geom"), b["x"], b["y"], e["x"], e["y"]).alias("g"))
    return _positions(rows, "id", F.col("g")).select("id", "i", r(F.col("x")).alias("x"), r(F.col("y")).alias("y"))


@query("line_split")
def line_split(spark, sf):
    """Each street cut by the next pentagon's edge, as numbers of pieces and positions."""
    cut = T.line_string(T.ring([(F.element_at(T.positions_of(F.col("geom")), 2)["x"], 0.0), (F.element_at(T.positions_of(F.col("geom")), 2)["x"] - 0.4, 89.0)]))
    g = u.line_split(F.col("geom"), cut)
    return spread(V.streets(spark, sf)).select("id", g.alias("g")).select("id", F.size("g.parts").alias("parts"), F.size(T.positions_of(F.col("g"))).alias("positions"))


@query("transform", f"WITH {TRACKS} SELECT user_id, i::INT AS i, {rs('6378137::DOUBLE * radians(x)', 4)} AS x, {rs('6378137::DOUBLE * ln(tan(pi() / 4 + radians(y) / 2))', 4)} AS y FROM t")
def transform(spark, sf):
    """Whole tracks to another system."""
    rows = V.tracks(spark, sf).select("user_id", crs.transform(F.col("geom"), "WGS84", "EPSG:3857").alias("g"))
    return _positions(rows, "user_id", F.col("g")).select("user_id", "i", r(F.col("x"), 4).alias("x"), r(F.col("y"), 4).alias("y"))


@query("snap_round", f"""WITH {TRACKS}, m AS (SELECT user_id, i, round(6378137::DOUBLE * radians(x) / 50000) * 50000 AS x, round(6378137::DOUBLE * ln(tan(pi() / 4 + radians(y) / 2)) / 50000) * 50000 AS y FROM t),
b AS (SELECT *, lag(x) OVER w AS bx, lag(y) OVER w AS by_ FROM m WINDOW w AS (PARTITION BY user_id ORDER BY i))
SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY i) - 1)::INT AS i, {rs('degrees(x / 6378137::DOUBLE)')} AS x, {rs('degrees(2 * atan(exp(y / 6378137::DOUBLE)) - pi() / 2)')} AS y FROM b WHERE bx IS NULL OR bx <> x OR by_ <> y""")
def snap_round(spark, sf):
    """To a lattice of 50 km in the Mercator plane."""
    rows = V.tracks(spark, sf).select("user_id", shapes.snap_round(F.col("geom"), 50_000.0, crs.to_mercator, crs.from_mercator).alias("g"))
    return _positions(rows, "user_id", F.col("g")).select("user_id", "i", r(F.col("x")).alias("x"), r(F.col("y")).alias("y"))


# Relations of neighbouring zones.
_NEXT = "SELECT a.zone AS a, b.zone AS b, abs(a.zone % 5 - b.zone % 5) AS di, abs(a.zone // 5 - b.zone // 5) AS dj FROM z a JOIN z b ON a.zone < b.zone"
_MATRIX = "CASE WHEN di + dj = 1 THEN 'FF2F11212' WHEN di = 1 AND dj = 1 THEN 'FF2F01212' ELSE 'FF2FF1212' END"


@query("relations", f"""WITH {ZONES}, n AS ({_NEXT}), k AS (SELECT a, b, {_MATRIX} AS matrix FROM n)
SELECT a, b, matrix, matrix[5] <> 'F' AS touches, matrix[5] = 'F' AS disjoint, matrix[5] <> 'F' AS intersects, false AS overlaps, false AS contains, matrix[5] = '1' AS edge FROM k""")
def relations(spark, sf):
    """Every pair of zones by a matrix, its named relations, and a pattern for a common edge."""
    one = V.zones(spark, sf).select("zone", "geom", F.lit(1).alias("k"))
    rows = spread(one.toDF("a", "g", "k").join(one.toDF("b", "h", "k"), "k").filter("a < b").select("a", "b", u.relate(F.col("g"), F.col("h")).alias("matrix")))
    named = {n: shapes.boolean_relation(F.col("matrix"), n, 2, 2).alias(n) for n in ("touches", "disjoint", "intersects", "overlaps", "contains")}
    return rows.select("a", "b", "matrix", *named.values(), shapes.relate_pattern(F.col("matrix"), "F***1****").alias("edge"))


_SHIFT = "(zone * 0.6::DOUBLE)"


@query("boolean_intersects", f"""WITH {ZONES}, {PENTAGONS}, x AS (SELECT a.zone, a.px AS ax, a.py AS ay, a.qx - a.px AS sx, a.qy - a.py AS sy, b.px + {_SHIFT.replace('zone', 'b.zone')} AS cx, b.py AS cy, b.qx - b.px AS tx, b.qy - b.py AS ty FROM pe a JOIN pe b ON a.zone = b.zone),
w AS (SELECT *, sx * ty - sy * tx AS d FROM x), f AS (SELECT zone, ((cx - ax) * ty - (cy - ay) * tx) / nullif(d, 0) AS u, ((cx - ax) * sy - (cy - ay) * sx) / nullif(d, 0) AS v FROM w)
SELECT zone, coalesce(bool_or(u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1), false) AS meets FROM f GROUP BY zone""")
def boolean_intersects(spark, sf):
    """Each pentagon with itself moved east, the farther the greater its number."""
    moved = T.map_positions(F.col("geom"), lambda p: T.position(p["x"] + F.col("zone") * 0.6, p["y"]))
    return V.pentagons(spark, sf).select("zone", u.boolean_intersects(F.col("geom"), moved).alias("meets"))


@query("boolean_point_on_line", f"WITH {TRACKS} SELECT DISTINCT user_id, true AS first, false AS far FROM t")
def boolean_point_on_line(spark, sf):
    p = F.element_at(T.positions_of(F.col("geom")), 1)
    on = lambda x, y: u.boolean_point_on_line(F.col("geom"), x, y, F.lit(0.01))
    return spread(V.tracks(spark, sf)).select("user_id", on(p["x"], p["y"]).alias("first"), on(F.lit(60.0), F.lit(5.0)).alias("far"))


@query("boolean_parallel", f"WITH {STREETS} SELECT id, true AS same, false AS turned FROM cp")
def boolean_parallel(spark, sf):
    return V.streets(spark, sf).select("id", u.boolean_parallel(F.col("geom"), F.col("geom")).alias("same"), u.boolean_parallel(F.col("geom"), u.rotate(F.col("geom"), F.lit(45.0))).alias("turned"))


@query("point_on_feature", f"WITH {ZONES} SELECT zone, true AS inside FROM z")
def point_on_feature(spark, sf):
    rows = V.pentagons(spark, sf).withColumn("p", u.point_on_feature(F.col("geom")))
    return rows.select("zone", shapes.point_in_polygon(F.col("p.x"), F.col("p.y"), F.col("geom")).alias("inside"))


@query("polygon_tangents", f"""WITH {ZONES}, {PENTAGONS}, e AS (SELECT zone, 100.0::DOUBLE AS lon1, 5.0::DOUBLE AS lat1, px AS lon2, py AS lat2 FROM pe), {G.inverse('e', 'gi')}
SELECT zone, arg_min(lon2, az1) AS left_x, arg_min(lat2, az1) AS left_y, arg_max(lon2, az1) AS right_x, arg_max(lat2, az1) AS right_y FROM gi GROUP BY zone""")
def polygon_tangents(spark, sf):
    """Seen from a point south of all zones."""
    t = T.positions_of(u.polygon_tangents(F.col("geom"), F.lit(100.0), F.lit(5.0)))
    rows = V.pentagons(spark, sf).select("zone", F.element_at(t, 1).alias("l"), F.element_at(t, 2).alias("r"))
    return rows.select("zone", F.col("l.x").alias("left_x"), F.col("l.y").alias("left_y"), F.col("r.x").alias("right_x"), F.col("r.y").alias("right_y"))


# Bow ties: a zone's corners joined crosswise, in halves that meet in the middle.
def _bow_ties(spark, sf):
    b = T.bbox(F.col("geom"))
    ring = T.ring([(b["xmin"], b["ymin"]), (b["xmax"], b["ymax"]), (b["xmax"], b["ymin"]), (b["xmin"], b["ymax"]), (b["xmin"], b["ymin"])])
    return V.zones(spark, sf).select("zone", T.geometry("Polygon", F.array(F.array(ring))).alias("geom"))


_TIE = f"""{ZONES}, c AS (SELECT zone, x0, y0, x1, y1, (x0 + x1) / 2 AS mx, (y0 + y1) / 2 AS my FROM z),
ed AS (SELECT zone, unnest([0, 0, 0, 1, 1, 1]) AS half, unnest([x0, mx, x0, x1, x1, mx]) AS px, unnest([y0, my, y1, y0, y1, my]) AS py, unnest([mx, x0, x0, x1, mx, x1]) AS qx, unnest([my, y1, y0, y1, my, y0]) AS qy FROM c)"""


@query("kinks", f"WITH {_TIE} SELECT zone, {rs('mx')} AS x, {rs('my')} AS y FROM c")
def kinks(spark, sf):
    return _positions(_bow_ties(spark, sf).select("zone", u.kinks(F.col("geom")).alias("g")), "zone", F.col("g")).select("zone", r(F.col("x")).alias("x"), r(F.col("y")).alias("y"))


@query("unkink", f"WITH {_TIE}, {_NODES}, {s_panels('ed')}, h AS (SELECT zone, half, abs(sum(wt * {_ZONE} * radians(qx - px))) / 1e6 AS km2 FROM quad GROUP BY ALL) SELECT zone, count(*) AS parts, {rs('sum(km2)', 1)} AS km2 FROM h GROUP BY zone")
def unkink(spark, sf):
    g = F.col("g")
    rows = _bow_ties(spark, sf).select("zone", u.unkink(F.col("geom")).alias("g"))
    return rows.select("zone", F.size(g["parts"]).cast("long").alias("parts"), r(measure.area(g) / 1e6, 1).alias("km2"))


@query("make_valid", f"WITH {_TIE}, {_NODES}, {s_panels('ed')}, h AS (SELECT zone, half, abs(sum(wt * {_ZONE} * radians(qx - px))) / 1e6 AS km2 FROM quad GROUP BY ALL) SELECT zone, true AS rebuilt, 'MultiPolygon' AS kind, {rs('sum(km2)', 1)} AS km2 FROM h GROUP BY zone")
def make_valid(spark, sf):
    rows = _bow_ties(spark, sf).select("zone", u.make_valid("geom").alias("v")).select("zone", F.array_contains("v.fixes", "rebuilt").alias("rebuilt"), F.col("v.geom").alias("g"))
    return rows.select("zone", "rebuilt", F.col("g.kind").alias("kind"), r(measure.area(F.col("g")) / 1e6, 1).alias("km2"))


@query("validate", f"""WITH {ZONES} SELECT zone, true AS valid, 0 AS issues, false AS tie_valid, 'zero-area-ring,self-intersection' AS tie_code FROM z""")
def validate(spark, sf):
    """Pentagons, and bow ties that cross themselves."""
    sound = V.pentagons(spark, sf).select("zone", u.boolean_valid(F.col("geom")).alias("valid"), F.size(u.validate("geom")).alias("issues"))
    ties = _bow_ties(spark, sf).select("zone", u.validate("geom").alias("v"))
    errors = F.filter("v", lambda i: i["severity"] == "error")
    return sound.join(ties.select("zone", (F.size(errors) == 0).alias("tie_valid"), F.array_join(F.array_distinct(F.transform(errors, lambda i: i["code"])), ",").alias("tie_code")), "zone")


# Tables.
@query("flatten", f"WITH {TRACKS} SELECT user_id, i::INT AS multi_idx, 'Point' AS kind, x, y FROM t")
def flatten(spark, sf):
    """Tracks as multi-points, taken apart."""
    rows = V.tracks(spark, sf).select("user_id", T.multi_point(T.positions_of(F.col("geom"))).alias("geom"))
    flat = helpers.flatten_each(rows, "user_id").withColumn("p", F.element_at(T.positions_of(F.col("geom")), 1))
    return flat.select("user_id", "multi_idx", F.col("geom.kind").alias("kind"), "p.x", "p.y")


@query("coord_each", f"WITH {ZONES}, {PENTAGONS} SELECT zone, 0 AS multi_idx, 0 AS geom_idx, i::INT AS coord_idx, px AS x, py AS y FROM pe")
def coord_each(spark, sf):
    return helpers.coord_each(V.pentagons(spark, sf), "zone", exclude_wrap=True)


@query("find_segment", f"WITH {TRACKS} SELECT user_id, px, py, qx, qy FROM ts WHERE i = 0 UNION ALL SELECT user_id + 1000000, arg_max(px, i), arg_max(py, i), arg_max(qx, i), arg_max(qy, i) FROM ts GROUP BY user_id")
def find_segment(spark, sf):
    """Each track's first segment and, under another number, its last."""
    rows = V.tracks(spark, sf)
    ends = helpers.find_segment(rows, "user_id", 0).unionByName(helpers.find_segment(rows, "user_id", -1).withColumn("user_id", F.col("user_id") + 1000000))
    return ends.select("user_id", F.col("p.x").alias("px"), F.col("p.y").alias("py"), F.col("q.x").alias("qx"), F.col("q.y").alias("qy"))


@query("find_point", f"WITH {TRACKS} SELECT user_id, arg_max(x, i) AS x, arg_max(y, i) AS y FROM t GROUP BY user_id")
def find_point(spark, sf):
    return helpers.find_point(V.tracks(spark, sf), "user_id", -1).select("user_id", "p.x", "p.y")


@query("apply_filter", f"WITH {CUSTOMER} SELECT id, lon, lat FROM cp WHERE segment = 'BUILDING' AND z IS NOT NULL")
def apply_filter(spark, sf):
    return helpers.filter_properties(helpers.apply_filter(V.customer_pt(spark, sf), {"segment": "BUILDING"}, "z"), ["id", "lon", "lat"])


@query("cluster_reduce", f"WITH {CUSTOMER} SELECT segment, count(*) AS n, {rs('sum(z)', 2)} AS total FROM cp GROUP BY segment")
def cluster_reduce(spark, sf):
    return agg.cluster_reduce(V.customer_pt(spark, sf), "segment", F.count(F.lit(1)).alias("n"), r(F.sum("z"), 2).alias("total"))


@query("random_points", "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS fid, true AS inside FROM customer")
def random_points(spark, sf):
    """As many random points as customers, all in their box."""
    p = helpers.random_points(spark, V.table(spark, sf, "customer").count(), (10.0, 20.0, 30.0, 40.0), seed=3)
    return p.select("fid", (F.col("lon").between(10, 30) & F.col("lat").between(20, 40)).alias("inside"))


@query("sample", "SELECT least(500, count(*)) AS n, least(500, count(*)) AS ids FROM customer")
def sample(spark, sf):
    return helpers.sample(V.customer_pt(spark, sf), 500, seed=5).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))


# Distances between tables.
_WITHIN = f"""{CUSTOMER}, {SUPPLIER}, e AS (SELECT id, sid, lon AS lon1, lat AS lat1, rlon AS lon2, rlat AS lat2 FROM cp, sp WHERE abs(rlon - lon) < 2 AND abs(rlat - lat) < 2), {G.inverse('e', 'gi')}"""


@query("snap_to", f"""WITH {_WITHIN}, n AS (SELECT id, arg_min(lon2, s12) AS x, arg_min(lat2, s12) AS y FROM gi WHERE s12 <= 60000 GROUP BY id)
SELECT cp.id, coalesce(n.x, lon) AS x, coalesce(n.y, lat) AS y, n.x IS NOT NULL AND (n.x <> lon OR n.y <> lat) AS moved FROM cp LEFT JOIN n USING (id)""")
def snap_to(spark, sf):
    """Customers moved onto suppliers within 60 km."""
    reference = V.supplier_pt(spark, sf).select("sid", T.point("rlon", "rlat").alias("geom"))
    return joins.snap_points(spread(V.customer_pt(spark, sf)), spread(reference), "id", "sid", 60_000.0)


@query("nearest_line")
def nearest_line(spark, sf):
    """Each supplier's nearest street."""
    found = joins.nearest_line(spread(V.supplier_pt(spark, sf)), spread(V.streets(spark, sf)), "sid", "id", x="rlon", y="rlat")
    return found.select("sid", "id", "seg", r(F.col("x")).alias("x"), r(F.col("y")).alias("y"), r(F.col("distance"), 2).alias("metres"))


@query("nearest_point_to_line")
def nearest_point_to_line(spark, sf):
    """The customer that is nearest to one line across the zones."""
    line = T.line_string(T.ring([(80.0, 20.0), (100.0, 35.0), (130.0, 50.0)]))
    return joins.nearest_point_to_line(spread(V.customer_pt(spark, sf)), line, "id").select("id", r(F.col("distance"), 2).alias("metres"))


@query("point_to_polygon_distance")
def point_to_polygon_distance(spark, sf):
    """Suppliers to one pentagon, negative inside."""
    ring = T.ring([(90.0, 30.0), (100.0, 30.0), (101.0, 36.0), (95.0, 40.0), (89.0, 36.0), (90.0, 30.0)])
    d = u.point_to_polygon_distance(T.polygon(F.array(ring)), F.col("rlon"), F.col("rlat"))
    return spread(V.supplier_pt(spark, sf)).select("sid", r(d, 2).alias("metres"))


@query("polygonize", f"WITH {ZONES} SELECT zone // 5 AS row, 5 AS faces FROM z GROUP BY ALL")
def polygonize(spark, sf):
    """Faces of each row of zones, from the zones' outlines as lines."""
    lines = V.zones(spark, sf).select(F.floor(F.col("zone") / 5).cast("long").alias("row"), shapes.polygon_to_line(F.col("geom")).alias("geom"))
    return tables.polygonize(lines, "row").groupBy("row").agg(F.count(F.lit(1)).cast("int").alias("faces"))


@query("center_median")
def center_median(spark, sf):
    return agg.center_median(V.customer_pt(spark, sf)).select(r(F.col("lon"), 4).alias("lon"), r(F.col("lat"), 4).alias("lat"))


@query("polygon_smooth")
def polygon_smooth(spark, sf):
    rows = V.pentagons(spark, sf).select("zone", u.polygon_smooth(F.col("geom"), F.lit(2.0)).alias("g"))
    return _positions(rows, "zone", F.col("g")).select("zone", "i", r(F.col("x")).alias("x"), r(F.col("y")).alias("y"))


@query("network_ends")
def network_ends(spark, sf):
    """Streets' ends that stop short of another street, or run past one, by 5 km at most."""
    return tables.network_ends(spread(V.streets(spark, sf)), "id", max_undershoot=5000.0, max_overshoot=5000.0, size=1.0).select("code", "line", r(F.col("x")).alias("x"), r(F.col("y")).alias("y"), r(F.col("distance"), 2).alias("metres"))


# Hulls, triangles and clusters in the frame's plane.
def _frame():
    from tellurion.plans.queries import s_frame

    return s_frame("fp")


_PLANE = f"{SUPPLIER}, fp AS (SELECT sid, rlon AS lon, rlat AS lat, sz AS z FROM sp), {_frame()}, pl AS MATERIALIZED (SELECT sid, lon, lat, z, x, y FROM tm)"


@query("convex_hull", f"""WITH {_PLANE}, ed AS (SELECT a.sid AS a, b.sid AS b, min((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) AS least FROM pl a, pl b, pl c WHERE a.sid <> b.sid AND c.sid <> a.sid AND c.sid <> b.sid GROUP BY ALL)
SELECT DISTINCT {rs('lon')} AS x, {rs('lat')} AS y FROM ed JOIN pl ON pl.sid = ed.a WHERE least > 0""")
def convex_hull(spark, sf):
    """The corners of the suppliers' hull."""
    h = tables.convex_hull(V.supplier_pt(spark, sf), "rlon", "rlat")
    return h.select(F.explode(T.positions_of(F.col("geom"))).alias("p")).select(r(F.col("p.x")).alias("x"), r(F.col("p.y")).alias("y")).distinct()


@query("clusters_dbscan", f"""WITH RECURSIVE {_PLANE}, nr AS MATERIALIZED (SELECT a.sid AS a, b.sid AS b FROM pl a, pl b WHERE power(a.x - b.x, 2) + power(a.y - b.y, 2) <= 300000.0::DOUBLE * 300000),
co AS MATERIALIZED (SELECT a FROM nr GROUP BY a HAVING count(*) >= 3), cc AS MATERIALIZED (SELECT nr.a, nr.b FROM nr JOIN co p ON p.a = nr.a JOIN co q ON q.a = nr.b),
re(id, root) AS (SELECT a, a FROM co UNION SELECT cc.b, re.root FROM re JOIN cc ON cc.a = re.id WHERE re.root < cc.b), ro AS (SELECT id, min(root) AS root FROM re GROUP BY id),
nu AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT root FROM ro)), cl AS (SELECT id, cluster FROM ro JOIN nu USING (root)),
eg AS (SELECT nr.a AS id, min(cluster) AS cluster FROM nr JOIN cl ON cl.id = nr.b WHERE nr.a NOT IN (SELECT a FROM co) GROUP BY nr.a)
SELECT sid, CASE WHEN cl.id IS NOT NULL THEN 'core' WHEN eg.id IS NOT NULL THEN 'edge' ELSE 'noise' END AS role, coalesce(cl.cluster, eg.cluster)::INT AS cluster FROM pl LEFT JOIN cl ON cl.id = sid LEFT JOIN eg ON eg.id = sid""")
def clusters_dbscan(spark, sf):
    return tables.dbscan(V.supplier_pt(spark, sf), "sid", 300_000.0, 3, "rlon", "rlat")


#: A triangle's corner on the left of a, b is the point that sees the two at the widest angle; one that its three sides agree on is a triangle.
_TIN = f"""{_PLANE}, ap AS MATERIALIZED (SELECT a, b, arg_min(c, cot) AS c FROM (SELECT a.sid AS a, b.sid AS b, c.sid AS c,
  ((a.x - c.x) * (b.x - c.x) + (a.y - c.y) * (b.y - c.y)) / ((a.x - c.x) * (b.y - c.y) - (a.y - c.y) * (b.x - c.x)) AS cot
  FROM pl a, pl b, pl c WHERE a.sid <> b.sid AND (a.x - c.x) * (b.y - c.y) - (a.y - c.y) * (b.x - c.x) > 0) GROUP BY a, b),
tr AS MATERIALIZED (SELECT p.a, p.b, p.c FROM ap p JOIN ap q ON q.a = p.b AND q.b = p.c AND q.c = p.a JOIN ap s ON s.a = p.c AND s.b = p.a AND s.c = p.b WHERE p.a < p.b AND p.a < p.c)"""


def _suppliers(spark, sf):
    return V.supplier_pt(spark, sf).withColumn("g", F.lit(1))


@query("tin", f"""WITH {_TIN} SELECT {rs('least(i.z, j.z, k.z)', 2)} AS low, {rs('i.z + j.z + k.z', 2)} AS total, {rs('greatest(i.z, j.z, k.z)', 2)} AS high
FROM tr JOIN pl i ON i.sid = a JOIN pl j ON j.sid = b JOIN pl k ON k.sid = c""")
def tin(spark, sf):
    """Triangles over the suppliers, by the heights of their corners."""
    t = delaunay.tin(_suppliers(spark, sf), "g", "sid", "rlon", "rlat", "sz")
    return t.select(r(F.least("a", "b", "c"), 2).alias("low"), r(F.col("a") + F.col("b") + F.col("c"), 2).alias("total"), r(F.greatest("a", "b", "c"), 2).alias("high"))


@query("delaunay_neighbours", f"WITH {_TIN}, e AS (SELECT a, b FROM tr UNION SELECT b, c FROM tr UNION SELECT c, a FROM tr) SELECT least(a, b) AS a, greatest(a, b) AS b FROM e GROUP BY ALL")
def delaunay_neighbours(spark, sf):
    """Suppliers whose Voronoi cells share a side, on the plane without end."""
    return delaunay.neighbours(_suppliers(spark, sf), "g", "sid", "rlon", "rlat").filter("id < id2").select(F.col("id").alias("a"), F.col("id2").alias("b"))


@query("concave_rim", f"""WITH {_TIN}, ok AS (SELECT tr.* FROM tr JOIN pl i ON i.sid = a JOIN pl j ON j.sid = b JOIN pl k ON k.sid = c
  WHERE greatest(sqrt(power(i.x - j.x, 2) + power(i.y - j.y, 2)), sqrt(power(j.x - k.x, 2) + power(j.y - k.y, 2)), sqrt(power(k.x - i.x, 2) + power(k.y - i.y, 2))) <= 600000.0::DOUBLE),
e AS (SELECT a, b FROM ok UNION ALL SELECT b, c FROM ok UNION ALL SELECT c, a FROM ok) SELECT min(a) AS a, min(b) AS b FROM e GROUP BY least(a, b), greatest(a, b) HAVING count(*) = 1""")
def concave_rim(spark, sf):
    """The sides of the suppliers' concave hull, with the inside on their left."""
    return delaunay.rim(_suppliers(spark, sf), "g", "sid", 600_000.0, "rlon", "rlat").select("a", "b")


@query("concave_hull")
def concave_hull(spark, sf):
    """The hull's area and number of parts; the rim that it is made of has SQL, its assembly a test."""
    h = delaunay.concave_hull(_suppliers(spark, sf), "g", "sid", 600_000.0, "rlon", "rlat")
    return h.select(F.size("geom.parts").alias("parts"), r(u.geodesic_area(F.col("geom")) / 1e6, 1).alias("km2"))




@query("buffer_lines")
def buffer_lines(spark, sf):
    """Areas within 2 km of each street, whose edges are followed within a metre."""
    b = u.buffer(F.col("geom"), 2000.0, tolerance=1.0)
    return spread(V.streets(spark, sf)).select("id", r(u.geodesic_area(b) / 1e6, 2).alias("km2"))


@query("prepared_contains", f"WITH {CUSTOMER}, {IN_PENTAGON} SELECT id, zone FROM hit")
def prepared_contains(spark, sf):
    """Customers in pentagons that are prepared as cells."""
    return prepared.contained(V.customer_pt(spark, sf), prepared.prepare(V.pentagons(spark, sf), "zone"), "zone").select("id", "zone")


@query("network_self_crossings", f"""WITH {TRACKS}, c AS (SELECT a.user_id, a.px AS ax, a.py AS ay, a.qx - a.px AS sx, a.qy - a.py AS sy, b.px AS cx, b.py AS cy, b.qx - b.px AS tx, b.qy - b.py AS ty FROM ts a JOIN ts b ON a.user_id = b.user_id AND b.i > a.i + 1),
f AS (SELECT *, ((cx - ax) * ty - (cy - ay) * tx) / nullif(sx * ty - sy * tx, 0) AS u, ((cx - ax) * sy - (cy - ay) * sx) / nullif(sx * ty - sy * tx, 0) AS v FROM c)
SELECT user_id, count(*) AS crossings, {rs('min(ax + u * sx)')} AS west, {rs('max(ay + u * sy)')} AS north FROM f WHERE u > 0 AND u < 1 AND v > 0 AND v < 1 GROUP BY user_id""")
def network_self_crossings(spark, sf):
    """How often each track crosses itself, over whole tracks."""
    found = networks.self_crossings(spread(V.tracks(spark, sf)), "user_id", size=8.0)
    return found.groupBy("user_id").agg(F.count(F.lit(1)).alias("crossings"), r(F.min("x")).alias("west"), r(F.max("y")).alias("north"))


@query("network_report")
def network_report(spark, sf):
    """The streets' faults with ends joined within 2 km, and stubs of 5 km; held against counting in the tests."""
    out = networks.report(spread(V.streets(spark, sf)), "id", tolerance=2000.0, max_undershoot=5000.0, max_overshoot=5000.0, size=1.0)
    return out.select("code", "line", "other", r(F.col("x")).alias("x"), r(F.col("y")).alias("y"), "degree", r(F.col("distance"), 2).alias("metres"))


_BALANCES = [2000.0, 5000.0]


@query("contour_lengths", f"""WITH nd AS (SELECT c_custkey % 40 AS i, c_custkey // 40 AS j, c_acctbal AS z FROM customer), np AS (SELECT *, 100 + i * 0.1::DOUBLE AS x, 20 + j * 0.05::DOUBLE AS y FROM nd),
tr AS (SELECT a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz, l FROM np a JOIN np c ON c.i = a.i + 1 AND c.j = a.j + 1 JOIN np b ON (b.i = a.i + 1 AND b.j = a.j) OR (b.i = a.i AND b.j = a.j + 1), (SELECT unnest({_BALANCES})::DOUBLE AS l)),
pt AS (SELECT l, [CASE WHEN (az >= l) <> (bz >= l) THEN [ax + (l - az) / (bz - az) * (bx - ax), ay + (l - az) / (bz - az) * (by_ - ay)] END, CASE WHEN (bz >= l) <> (cz >= l) THEN [bx + (l - bz) / (cz - bz) * (cx - bx), by_ + (l - bz) / (cz - bz) * (cy - by_)] END,
  CASE WHEN (az >= l) <> (cz >= l) THEN [ax + (l - az) / (cz - az) * (cx - ax), ay + (l - az) / (cz - az) * (cy - ay)] END] AS ps FROM tr),
sg AS (SELECT l, list_filter(ps, lambda p: p IS NOT NULL) AS ps FROM pt)
SELECT l AS level, count(*) AS segments, {rs('sum(sqrt(power(ps[1][1] - ps[2][1], 2) + power(ps[1][2] - ps[2][2], 2)))', 4)} AS degrees FROM sg WHERE len(ps) = 2 GROUP BY l""")
def contour_lengths(spark, sf):
    """Contours over a lattice of every customer's balance: their segments and their length in degrees, from whole chains."""
    k = F.col("c_custkey")
    nodes = V.table(spark, sf, "customer").select(F.lit(1).alias("g"), (100 + k % 40 * 0.1).alias("lon"), (20 + F.floor(k / 40) * 0.05).alias("lat"), F.col("c_acctbal").alias("z"))
    ring = F.col("geom.parts")[0][0]
    steps = F.zip_with(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, F.size(ring) - 1), lambda p, q: F.sqrt((p["x"] - q["x"]) ** 2 + (p["y"] - q["y"]) ** 2))
    own = contours.isolines(nodes, "g", _BALANCES).select("level", (F.size(ring) - 1).alias("n"), F.aggregate(steps, F.lit(0.0), lambda a, b: a + b).alias("d"))
    return own.groupBy("level").agg(F.sum("n").alias("segments"), r(F.sum("d"), 4).alias("degrees"))
