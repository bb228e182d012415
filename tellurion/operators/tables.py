"""Operators over whole tables that need a kernel or rounds of joins."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurion.functions import crs
from tellurion.functions import types as T
from tellurion.operators import geodetic as g
from tellurion.operators import planar as pl
from tellurion.operators.aggregates import bbox, framed
from tellurion.operators.joins import boxes_join, cell
from tellurion.session import land, ship

GEOM_DDL = T.GEOMETRY


def unpack(text: str | None):
    """The kernels' form of a geometry that came into pandas as JSON; None for null."""
    v = json.loads(text) if text is not None else {}
    if v.get("kind") is None or v.get("parts") is None:
        return None
    return v["kind"], [[np.array([(p["x"], p["y"]) for p in r], float).reshape(-1, 2) for r in part] for part in v["parts"]]


def pack(geom) -> dict | None:
    if geom is None:
        return None
    return {"kind": geom[0], "parts": [[[{"x": float(x), "y": float(y)} for x, y in r] for r in part] for part in geom[1]]}


# Set operations on groups.
#: Areas that one step of a union joins.
FAN = 16


def dense(df: DataFrame, order: list[Column], at: str) -> DataFrame:
    """Landed rows numbered from 0 in an order, over ranges of it; a count for each partition is all that comes together."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = land(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    sizes = {r["p"]: r["c"] for r in rows.groupBy(F.shiftright(at, 33).alias("p")).agg(F.count(F.lit(1)).alias("c")).collect()}
    before = [0]
    for p in range(max(sizes, default=0)):
        before.append(before[-1] + sizes.get(p, 0))
    first = F.element_at(F.array(*[F.lit(b).cast("long") for b in before]), (F.shiftright(at, 33) + 1).cast("int"))
    return rows.withColumn(at, first + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)))


def morton(x: Column, y: Column, bits: int = 20) -> Column:
    """A place along a space-filling curve from two coordinates in degrees."""
    out = F.lit(0).cast("long")
    for c, lo, span, odd in ((x, -180.0, 360.0, 0), (y, -90.0, 180.0, 1)):
        v = F.greatest(F.lit(0.0), F.least(F.lit(float((1 << bits) - 1)), F.floor((c - lo) / span * float(1 << bits)))).cast("long")
        for k in range(bits):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(v, k).bitwiseAND(F.lit(1).cast("long")), 2 * k + odd))
    return out


def union_by(df: DataFrame, key: str | None, geom: str = "geom", fid: str = "fid") -> DataFrame:
    """The union of each group's areas, up a tree of neighbours.

    Areas are put in the order of a space-filling curve and joined ``FAN`` at a time,
    as often as it takes. Neighbours share edges, which go at once, so what moves up
    has fewer positions at each level, and no task holds more than a few areas.
    """
    group = key or "_all"
    rows = df if key else df.withColumn("_all", F.lit(0))
    kind = rows.schema[group].dataType.simpleString()
    rows = rows.select(F.col(group).alias("_key"), F.col(fid).alias("_fid"), F.col(geom).alias("geom")).filter(F.size(T.positions_of(F.col("geom"))) > 0).withColumn("_box", T.bbox(F.col("geom")))
    boxes = rows.groupBy(F.col("_key").alias("_of")).agg(*(f(f"_box.{c}").alias(c) for f, c in ((F.min, "xmin"), (F.min, "ymin"), (F.max, "xmax"), (F.max, "ymax"))))
    # Every area is laid into its group's own plane first, and what comes of them lies on one grid there.
    rows = rows.join(boxes, F.col("_key").eqNullSafe(F.col("_of"))).select("_key", "_fid", morton((F.col("_box.xmin") + F.col("_box.xmax")) / 2, (F.col("_box.ymin") + F.col("_box.ymax")) / 2).alias("_z"), F.to_json("geom").alias("geom"), F.array("xmin", "ymin", "xmax", "ymax").alias("_in"))

    def frame(own) -> g.Frame:
        return g.Frame(("MultiPoint", [[np.array(own, float).reshape(2, 2)]]))

    def extent(own) -> float:
        f = frame(own)
        return pl.extent(f.to(np.array([(own[0], own[1]), (own[2], own[3])], float)))

    def laid(batches):
        for pdf in batches:
            pdf["geom"] = [pack(("MultiPolygon", frame(b).plane(g.densified(unpack(x))))) for x, b in zip(pdf["geom"], pdf["_in"], strict=True)]
            yield pdf

    def joined(parts: list, own, straight: float):
        return pl.overlay([[p for own in parts for p in own]], lambda inside: inside[0], extent(own), straight)

    def run(k, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = joined([unpack(x)[1] for x in pdf["geom"]], pdf["_in"].iloc[0], 0.0)
        return pd.DataFrame({"_key": [k[0]], "_at": [k[1]], "geom": [pack(("MultiPolygon", parts))], "_in": [list(pdf["_in"].iloc[0])]})

    def last(k, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["_in"].iloc[0]
        return pd.DataFrame({group: [k[0]], "geom": [pack(g.thinned(frame(own).earth(joined([unpack(x)[1] for x in pdf["geom"]], own, 4.0))))]})

    ship()
    rows = rows.mapInPandas(laid, f"_key {kind}, _fid {rows.schema['_fid'].dataType.simpleString()}, _z long, geom {GEOM_DDL}, _in array<double>")
    now = dense(rows, [F.col("_key"), F.col("_z"), F.col("_fid")], "_at").select("_key", "_at", F.to_json("geom").alias("geom"), "_in")
    most = now.agg(F.max("_at")).first()[0] or 0
    while most >= FAN:
        now = now.withColumn("_at", F.shiftright("_at", 4)).groupBy("_key", "_at").applyInPandas(run, f"_key {kind}, _at long, geom {GEOM_DDL}, _in array<double>")
        now = land(now).withColumn("geom", F.to_json("geom"))
        most //= FAN
    out = now.groupBy("_key").applyInPandas(last, f"`{group}` {kind}, geom {GEOM_DDL}")
    # A group of areas that are null or empty has no union.
    every = (df if key else df.withColumn("_all", F.lit(0))).select(F.col(group).alias("_of")).distinct()
    out = every.join(out, F.col("_of").eqNullSafe(out[group]), "left").select(F.col("_of").alias(group), "geom")
    return out if key else out.drop("_all")


def dissolve(df: DataFrame, prop: str, geom: str = "geom", fid: str = "fid") -> DataFrame:
    """Areas joined by a property, with the first feature's id; a missing property is a group of its own."""
    first = df.groupBy(prop).agg(F.min(fid).alias(fid))
    joined = union_by(df, prop, geom, fid)
    return first.join(joined, first[prop].eqNullSafe(joined[prop])).select(first[prop], first[fid], "geom")


def convex_hull(df: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    """The hull of a point table: each task's hull first, then the hull of those."""
    mid = bbox(df, x, y).first()
    if mid["xmin"] is None:
        return df.sparkSession.createDataFrame([], f"geom {GEOM_DDL}")
    lon0 = (mid["xmin"] + mid["xmax"]) / 2

    def run(batches):
        for pdf in batches:
            p = np.stack(crs.tmerc_forward(pdf["x"].to_numpy(), pdf["y"].to_numpy(), lon0), axis=1)
            h = pl.convex_hull(p)
            yield pd.DataFrame(p if h is None else h, columns=["px", "py"])

    ship()
    part = df.select(F.col(x).alias("x"), F.col(y).alias("y")).mapInPandas(run, "px double, py double")

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        h = pl.convex_hull(pdf[["px", "py"]].to_numpy())
        if h is None:
            return pd.DataFrame({"geom": []})
        r = np.stack(crs.tmerc_reverse(h[:, 0], h[:, 1], lon0), axis=1)
        return pd.DataFrame({"geom": [pack(("Polygon", [[r]]))]})

    shares = part.groupBy((F.monotonically_increasing_id() % 16).alias("k")).applyInPandas(lambda pdf: pd.DataFrame((lambda h: pdf[["px", "py"]].to_numpy() if h is None else h)(pl.convex_hull(pdf[["px", "py"]].to_numpy())), columns=["px", "py"]), "px double, py double")
    return shares.withColumn("k", F.lit(0)).groupBy("k").applyInPandas(lambda pdf: last(pdf), f"geom {GEOM_DDL}")


def _per_group(df: DataFrame, key: str, f, schema: str) -> DataFrame:
    ship()
    return df.groupBy(key).applyInPandas(f, schema)


def polygonize(df: DataFrame, key: str, geom: str = "geom") -> DataFrame:
    """Faces bounded by each group's lines."""
    kind = df.schema[key].dataType.simpleString()

    def run(k, pdf):
        rows = pl.faces([r for x in pdf["geom"] for r in g.rings(unpack(x))])
        return pd.DataFrame([(k[0], pack(("Polygon", [[r]]))) for r in rows], columns=[key, "geom"])

    return _per_group(df.select(key, F.to_json(F.col(geom)).alias("geom")), key, run, f"`{key}` {kind}, geom {GEOM_DDL}")


def _lattice(pdf, x, y, z):
    xs, ys = np.unique(pdf[x].round(9)), np.unique(pdf[y].round(9))
    grid = np.full((len(ys), len(xs)), np.nan)
    grid[np.searchsorted(ys, pdf[y].round(9)), np.searchsorted(xs, pdf[x].round(9))] = pdf[z]
    return xs, ys, grid


def isolines(df: DataFrame, key: str, breaks: list[float], x: str = "lon", y: str = "lat", z: str = "z") -> DataFrame:
    """A row for each break of each group's lattice; breaks are contoured in tasks of their own."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, x, y, z).withColumn("level", F.explode(F.array(*map(F.lit, map(float, breaks)))))

    def run(k, pdf):
        chains = g.isolines(*_lattice(pdf, x, y, z), k[1])
        return pd.DataFrame([(k[0], k[1], pack(("MultiLineString", [[c] for c in chains])))], columns=[key, "level", "geom"])

    ship()
    return rows.groupBy(key, "level").applyInPandas(run, f"`{key}` {kind}, level double, geom {GEOM_DDL}")


def isobands(df: DataFrame, key: str, breaks: list[float], x: str = "lon", y: str = "lat", z: str = "z") -> DataFrame:
    kind = df.schema[key].dataType.simpleString()
    pairs = [F.struct(F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for a, b in zip(sorted(breaks), sorted(breaks)[1:], strict=False)]
    rows = df.select(key, x, y, z, F.explode(F.array(*pairs)).alias("band")).select(key, x, y, z, "band.lo", "band.hi")

    def run(k, pdf):
        geom = g.isobands(*_lattice(pdf, x, y, z), [k[1], k[2]])[0][2]
        return pd.DataFrame([(k[0], f"{k[1]:g}-{k[2]:g}", k[1], k[2], pack(geom))], columns=[key, "name", "min", "max", "geom"])

    ship()
    return rows.groupBy(key, "lo", "hi").applyInPandas(run, f"`{key}` {kind}, name string, min double, max double, geom {GEOM_DDL}")


def shortest_paths(df: DataFrame, obstacles: list, od_id: str, resolution: float = 1000.0) -> DataFrame:
    """A path for each row (x1, y1, x2, y2) around the given obstacles; rows are searched in parallel."""
    kind = df.schema[od_id].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            out = [(r[od_id], pack(("LineString", [[g.shortest_path((r["x1"], r["y1"]), (r["x2"], r["y2"]), obstacles, resolution)]]))) for r in pdf.to_dict("records")]
            yield pd.DataFrame(out, columns=[od_id, "geom"])

    ship()
    return df.select(od_id, "x1", "y1", "x2", "y2").mapInPandas(run, f"`{od_id}` {kind}, geom {GEOM_DDL}")


# Grids.
def grid(spark: SparkSession, box: tuple[float, float, float, float], size: float, kind: str = "square", size_y: float | None = None) -> DataFrame:
    """Cells of ``size`` metres in the plane at the box's middle: i, j and a polygon, or x, y for points."""
    corners = np.array([[box[0], box[1]], [box[2], box[1]], [box[2], box[3]], [box[0], box[3]]])
    f = g.Frame(("MultiPoint", [[corners]]))
    p = f.to(corners)
    (x0, y0), (w, h) = p.min(0), np.ptp(p, axis=0)
    back = lambda x, y: T.position(*crs.tmerc_reverse(x, y, f.lon0, north=-f.y0))
    i, j = F.col("i"), F.col("j")
    if kind == "point":
        nx, ny = int(w // size) + 1, int(h // size) + 1
        rows = _cells(spark, nx, ny)
        q = back(x0 + i * size, y0 + j * size)
        return rows.select("i", "j", q["x"].alias("lon"), q["y"].alias("lat"))
    if kind == "hex":
        dx, dy = 1.5 * size, math.sqrt(3) * size
        rows = _cells(spark, int(w // dx) + 1, int(h // dy) + 1)
        cx, cy = x0 + i * dx, y0 + j * dy + F.when(i % 2 == 1, dy / 2).otherwise(0.0)
        ring = [(cx + size * math.cos(math.radians(60 * k)), cy + size * math.sin(math.radians(60 * k))) for k in range(6)]
        return rows.select("i", "j", _polygon([back(x, y) for x, y in [*ring, ring[0]]]))
    sy = size_y or size
    rows = _cells(spark, int(w // size), int(h // sy))
    a, b, c, d = x0 + i * size, y0 + j * sy, x0 + (i + 1) * size, y0 + (j + 1) * sy
    if kind == "triangle":
        rows = rows.withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
        one, two = [(a, b), (c, b), (c, d), (a, b)], [(a, b), (c, d), (a, d), (a, b)]
        return rows.select("i", "j", "half", F.when(F.col("half") == 0, _polygon([back(*q) for q in one])).otherwise(_polygon([back(*q) for q in two])).alias("geom"))
    return rows.select("i", "j", _polygon([back(*q) for q in [(a, b), (c, b), (c, d), (a, d), (a, b)]]))


def grid_masked(spark: SparkSession, box: tuple[float, float, float, float], size: float, mask: DataFrame, kind: str = "square", size_y: float | None = None, geom: str = "geom", cells: float = 1.0) -> DataFrame:
    """The grid's cells that touch an area of ``mask``, or its points inside one."""
    from tellurion.functions.udfs import boolean_intersects
    from tellurion.operators.joins import points_in_regions

    # Landed, as corners are long expressions that tests would repeat.
    rows, over = land(grid(spark, box, size, kind, size_y)), mask.select(F.col(geom).alias("_mask"))
    if kind == "point":
        return points_in_regions(rows, over.withColumnRenamed("_mask", "geom"), how="left_semi")
    keys = [c for c in rows.columns if c != "geom"]
    pairs = boxes_join(rows.withColumn("_l", T.bbox(F.col("geom"))), over.withColumn("_r", T.bbox(F.col("_mask"))), cells, "_l", "_r")
    return pairs.filter(boolean_intersects(F.col("geom"), F.col("_mask"))).select(*keys, "geom").dropDuplicates(keys)


def interpolate(samples: DataFrame, box: tuple[float, float, float, float], size: float, z: str, radius: float, kind: str = "square", weight: float = 1.0) -> DataFrame:
    """Cells (i, j, ..) of a grid with the inverse-distance mean of the samples about their middles; cells without any are left out."""
    from tellurion.functions.measure import centroid
    from tellurion.operators.aggregates import idw

    rows = land(grid(samples.sparkSession, box, size, kind))
    keys = [c for c in rows.columns if c in ("i", "j", "half")]
    rows = rows.withColumn("_cell", F.struct(*keys))
    if kind != "point":
        rows = rows.withColumn("_c", centroid(F.col("geom"))).withColumns({"lon": F.col("_c.x"), "lat": F.col("_c.y")})
    return idw(samples, rows.select("_cell", "lon", "lat"), "_cell", z, radius, weight).select("_cell.*", "z")


def _cells(spark: SparkSession, nx: int, ny: int) -> DataFrame:
    """Rows of a lattice from one range, split over the cluster."""
    return spark.range(nx * ny).select((F.col("id") % max(nx, 1)).cast("int").alias("i"), F.floor(F.col("id") / max(nx, 1)).cast("int").alias("j"))


def _polygon(ring: list[Column]) -> Column:
    return T.geometry("Polygon", F.array(F.array(F.array(*ring)))).alias("geom")


# Clusters.
def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """id, root for links (a, b): each id with the least one that it is connected to.

    Links turn into stars by two steps a round: every id's greater neighbours link to
    the least id about it, then its lesser neighbours do. Chains of any length halve with each
    round. An id by itself, linked to itself, is its own root.
    """
    ids = land(links.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    now = links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, told = land(now), None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = land(small.unionByName(below.select("u", F.col("m").alias("v"))).distinct())
        sums = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if sums == told:
            return ids.join(now, F.col("id") == F.col("u"), "left").select("id", F.coalesce("v", "id").alias("root"))
        told = sums
    raise RuntimeError(f"links still change after {max_rounds} rounds")


def dbscan(df: DataFrame, fid: str, radius: float, min_points: int = 3, x: str = "lon", y: str = "lat") -> DataFrame:
    """fid, role (core, edge, noise) and cluster, in the frame's plane.

    Clusters are numbered by their least core id; a border point goes to the
    lowest numbered cluster that reaches it. The count includes the point itself.

    Points lie in cells whose diagonal is the radius, so those of a cell are
    neighbours of each other: a cell with ``min_points`` has core points only, which
    are of one cluster. No pair of points in one cell is ever listed, and of two
    cells it is asked once whether any of their core points are near: points are
    sorted away from the other cell until none is left that could be.
    """
    from pyspark.sql import Window

    rows = framed(df, x, y).select(F.col(fid).alias("id"), "px", "py")
    side = radius / math.sqrt(2) * (1 - 1e-12)
    rows = land(rows.withColumns({"cx": F.floor(F.col("px") / side).cast("long"), "cy": F.floor(F.col("py") / side).cast("long")}))
    cells = land(rows.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("m"), F.min("px").alias("xa"), F.min("py").alias("ya"), F.max("px").alias("xb"), F.max("py").alias("yb")))
    # The cells that may hold a point within the radius of one of this cell's.
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3) if (i, j) != (0, 0) and (abs(i), abs(j)) != (2, 2)])
    thin = rows.join(cells.filter(F.col("m") < min_points).select("cx", "cy", "m"), ["cx", "cy"])
    near = near_counts(thin, rows, cells, around, radius, min_points)
    core = rows.join(cells.filter(F.col("m") >= min_points).select("cx", "cy"), ["cx", "cy"], "left_semi")
    core = land(core.unionByName(thin.drop("m").join(near.filter(F.col("n") >= min_points).select("id"), "id", "left_semi").select(rows.columns)))
    home = land(core.groupBy("cx", "cy").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("k"), F.min("px").alias("xa"), F.min("py").alias("ya"), F.max("px").alias("xb"), F.max("py").alias("yb")))
    # Cells of core points that reach each other, each pair once.
    a = home.withColumn("d", F.explode(around)).filter("d.i > 0 or (d.i = 0 and d.j > 0)").withColumns({"ox": F.col("cx") + F.col("d.i"), "oy": F.col("cy") + F.col("d.j")})
    b = home.select(F.col("cx").alias("ox"), F.col("cy").alias("oy"), *(F.col(c).alias(f"o{c}") for c in ("first", "k", "xa", "ya", "xb", "yb")))
    gap = lambda lo, hi, olo, ohi: F.greatest(F.lit(0.0), F.col(olo) - F.col(hi), F.col(lo) - F.col(ohi))
    both = a.join(b, ["ox", "oy"]).filter(F.hypot(gap("xa", "xb", "oxa", "oxb"), gap("ya", "yb", "oya", "oyb")) <= radius)
    links = reaching(both, core, radius)
    names = home.select("first").withColumn("id", F.col("first"))
    label = components(links) if links.limit(1).count() else names.select("id", F.col("id").alias("root")).limit(0)
    label = names.join(label, "id", "left").select("first", F.coalesce("root", "id").alias("root"))
    number = _numbered(label.select("root").distinct())
    owned = home.join(label, "first").join(number, "root").select("cx", "cy", "cluster")
    cores = core.join(owned, ["cx", "cy"])
    others = rows.join(core.select("id"), "id", "left_anti")
    # Borders: of each cell about, the nearest core point decides; clusters are those of whole cells.
    asked = others.withColumn("d", F.explode(F.array_append(around, F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))))).select("id", "px", "py", (F.col("cx") + F.col("d.i")).alias("cx"), (F.col("cy") + F.col("d.j")).alias("cy"))
    edge = asked.join(cores.select("cx", "cy", F.col("px").alias("qx"), F.col("py").alias("qy"), "cluster"), ["cx", "cy"]).filter((F.col("px") - F.col("qx")) ** 2 + (F.col("py") - F.col("qy")) ** 2 <= radius * radius)
    edge = edge.groupBy("id").agg(F.min("cluster").alias("cluster"))
    named = cores.select("id", "cluster").withColumn("role", F.lit("core")).unionByName(edge.withColumn("role", F.lit("edge")))
    return rows.select("id").join(named, "id", "left").select(F.col("id").alias(fid), F.coalesce("role", F.lit("noise")).alias("role"), F.col("cluster").cast("int").alias("cluster"))


def near_counts(thin: DataFrame, rows: DataFrame, cells: DataFrame, around: Column, radius: float, most: int) -> DataFrame:
    """id, n: the neighbours of points in cells with fewer than ``most`` points, themselves included.

    A cell about that lies within the radius as a whole counts by its number, without
    its points; the others' points are measured.
    """
    asked = thin.withColumn("d", F.explode(around)).select("id", "px", "py", "m", (F.col("cx") + F.col("d.i")).alias("ox"), (F.col("cy") + F.col("d.j")).alias("oy"))
    there = cells.select(F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.col("m").alias("om"), "xa", "ya", "xb", "yb")
    asked = asked.join(there, ["ox", "oy"])
    far = lambda p, lo, hi: F.greatest(F.abs(F.col(p) - F.col(lo)), F.abs(F.col(p) - F.col(hi)))
    gap = lambda p, lo, hi: F.greatest(F.lit(0.0), F.col(lo) - F.col(p), F.col(p) - F.col(hi))
    asked = asked.filter(F.hypot(gap("px", "xa", "xb"), gap("py", "ya", "yb")) <= radius).withColumn("all", F.hypot(far("px", "xa", "xb"), far("py", "ya", "yb")) <= radius * (1 - 1e-12))
    sure = asked.filter("all").select("id", F.col("om").alias("n"))
    some = asked.filter("not all").join(rows.select(F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.col("px").alias("qx"), F.col("py").alias("qy")), ["ox", "oy"])
    some = some.filter((F.col("px") - F.col("qx")) ** 2 + (F.col("py") - F.col("qy")) ** 2 <= radius * radius).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    own = thin.select("id", F.col("m").alias("n"))
    return own.unionByName(sure).unionByName(some).groupBy("id").agg(F.sum("n").alias("n"))


def reaching(pairs: DataFrame, core: DataFrame, radius: float) -> DataFrame:
    """a, b: the first ids of those pairs of cells that hold two core points within the radius of each other.

    Of each cell the points that the other one's box reaches are laid in a lattice whose
    cells are a sixteenth of the side, and of each lattice cell two points at most in each
    direction stand for all; pairs that those settle are done, the others list what is left.
    """
    from pyspark.sql import Window

    key = ["cx", "cy", "ox", "oy"]
    both = pairs.select(*key, "first", "ofirst", "xa", "ya", "xb", "yb", "oxa", "oya", "oxb", "oyb")
    gap = lambda p, lo, hi: F.greatest(F.lit(0.0), F.col(lo) - F.col(p), F.col(p) - F.col(hi))
    left = both.join(core.select("cx", "cy", "px", "py"), ["cx", "cy"]).withColumn("g", F.hypot(gap("px", "oxa", "oxb"), gap("py", "oya", "oyb"))).filter(F.col("g") <= radius)
    right = both.join(core.select(F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.col("px").alias("qx"), F.col("py").alias("qy")), ["ox", "oy"]).withColumn("g", F.hypot(gap("qx", "xa", "xb"), gap("qy", "ya", "yb"))).filter(F.col("g") <= radius)
    return _reach_rounds(left.select(*key, "first", "ofirst", "px", "py", "g"), right.select(*key, "qx", "qy", "g"), key, radius, Window)


def _reach_rounds(left: DataFrame, right: DataFrame, key: list[str], radius: float, window) -> DataFrame:
    """The nearest points of both sides first; then, for pairs that those don't settle, a finer lattice of what may still be near."""
    best = lambda df, n: df.withColumn("o", F.row_number().over(window.partitionBy(*key).orderBy("g"))).filter(F.col("o") <= n).drop("o", "g")
    close = (F.col("px") - F.col("qx")) ** 2 + (F.col("py") - F.col("qy")) ** 2 <= radius * radius
    left, right = land(left), land(right)
    first = land(best(left, 8).join(best(right, 8), key).filter(close).select(*key, "first", "ofirst").distinct())
    done = first
    rest_l, rest_r = left.join(first.select(*key), key, "left_anti"), right.join(first.select(*key), key, "left_anti")
    # Points are merged into boxes of a lattice, ever finer; boxes that lie within the radius as a whole settle
    # a pair, those that lie beyond it go.
    parts = 4
    rest_l, rest_r = land(rest_l.drop("g")), land(rest_r.drop("g"))
    while rest_l.limit(1).count():
        size = radius / parts
        la = rest_l.groupBy(*key, "first", "ofirst", F.floor(F.col("px") / size).alias("i"), F.floor(F.col("py") / size).alias("j")).agg(F.min("px").alias("xa"), F.min("py").alias("ya"), F.max("px").alias("xb"), F.max("py").alias("yb"))
        rb = rest_r.groupBy(*key, F.floor(F.col("qx") / size).alias("p"), F.floor(F.col("qy") / size).alias("q")).agg(F.min("qx").alias("ua"), F.min("qy").alias("va"), F.max("qx").alias("ub"), F.max("qy").alias("vb"))
        span = lambda a, b, c, d: F.greatest(F.abs(F.col(b) - F.col(c)), F.abs(F.col(d) - F.col(a)))
        apart = lambda a, b, c, d: F.greatest(F.lit(0.0), F.col(c) - F.col(b), F.col(a) - F.col(d))
        met = la.join(rb, key).withColumn("least", F.hypot(apart("xa", "xb", "ua", "ub"), apart("ya", "yb", "va", "vb"))).withColumn("most", F.hypot(span("xa", "xb", "ua", "ub"), span("ya", "yb", "va", "vb")))
        met = land(met.filter(F.col("least") <= radius).select(*key, "first", "ofirst", "i", "j", "p", "q", "most"))
        sure = met.filter(F.col("most") <= radius).select(*key, "first", "ofirst").distinct()
        done = land(done.unionByName(sure))
        left_over = met.join(sure.select(*key), key, "left_anti")
        rest_l = land(rest_l.withColumns({"i": F.floor(F.col("px") / size), "j": F.floor(F.col("py") / size)}).join(left_over.select(*key, "i", "j").distinct(), [*key, "i", "j"], "left_semi").drop("i", "j"))
        rest_r = land(rest_r.withColumns({"p": F.floor(F.col("qx") / size), "q": F.floor(F.col("qy") / size)}).join(left_over.select(*key, "p", "q").distinct(), [*key, "p", "q"], "left_semi").drop("p", "q"))
        parts *= 8
        if parts > 1 << 30:
            # What no lattice tells apart lies within rounding of the radius: the points decide.
            last = rest_l.join(rest_r, key).filter(close).select(*key, "first", "ofirst").distinct()
            done = land(done.unionByName(last))
            break
    return done.select(F.col("first").alias("a"), F.col("ofirst").alias("b")).distinct()


def _numbered(roots: DataFrame) -> DataFrame:
    """root, cluster: roots numbered in order from 0."""
    return dense(roots, [F.col("root")], "cluster")


def kmeans(df: DataFrame, fid: str, k: int | None = None, rounds: int = 200, x: str = "lon", y: str = "lat") -> DataFrame:
    """fid, cluster, centroid_lon, centroid_lat by Lloyd's rounds in the frame's plane.

    Seeds follow k-means++ with a fixed 64-bit xorshift sequence over rows in id
    order: each draw is one aggregate, and rows are summed in the engine.
    """
    n = df.count()
    k = min(n, k or max(1, round(math.sqrt(n / 2))))
    mid = bbox(df, x, y).first()
    if mid["xmin"] is None:
        none = F.lit(None).cast("double")
        return df.select(fid, F.lit(None).cast("int").alias("cluster"), none.alias("centroid_lon"), none.alias("centroid_lat"))
    lon0 = (mid["xmin"] + mid["xmax"]) / 2
    px, py = crs.tmerc_forward(F.col(x), F.col(y), lon0)
    rows = land(df.select(F.col(fid).alias("id"), px.alias("px"), py.alias("py")))
    state = 0x9E3779B97F4A7C15

    def draw() -> float:
        nonlocal state
        state ^= (state << 13) & (2**64 - 1)
        state ^= state >> 7
        state ^= (state << 17) & (2**64 - 1)
        return (state >> 11) / 2**53

    def d2(cs) -> Column:
        return F.least(*[(F.col("px") - a) ** 2 + (F.col("py") - b) ** 2 for a, b in cs], F.lit(math.inf))

    first = rows.orderBy("id").offset(int(draw() * n)).limit(1).first()
    centres = [(first["px"], first["py"])]
    while len(centres) < k:
        weighed = rows.withColumn("d", d2(centres))
        # The draw falls in a share of ids first, then on a row of that share.
        shares = weighed.groupBy(F.floor(F.col("id") / 4096).alias("s")).agg(F.sum("d").alias("d")).orderBy("s").collect()
        target = draw() * sum(r["d"] for r in shares)
        for r in shares:
            if target <= r["d"]:
                break
            target -= r["d"]
        own = weighed.filter(F.floor(F.col("id") / 4096) == r["s"]).orderBy("id").collect()
        for r in own:
            target -= r["d"]
            if target <= 0:
                break
        centres.append((r["px"], r["py"]))
    for _ in range(rounds):
        found = rows.withColumn("c", _nearest(centres)).groupBy("c").agg(F.avg("px").alias("a"), F.avg("py").alias("b")).collect()
        new = list(centres)
        for r in found:
            new[r["c"]] = (r["a"], r["b"])
        moved = max(math.hypot(p[0] - q[0], p[1] - q[1]) for p, q in zip(centres, new, strict=True))
        centres = new
        if moved < 1e-6:
            break
    back = [tuple(map(float, crs.tmerc_reverse(np.float64(a), np.float64(b), lon0))) for a, b in centres]
    where = F.array(*[T.position(F.lit(a), F.lit(b)) for a, b in back])
    out = rows.withColumn("cluster", _nearest(centres))
    c = F.element_at(where, F.col("cluster") + 1)
    return out.select(F.col("id").alias(fid), "cluster", c["x"].alias("centroid_lon"), c["y"].alias("centroid_lat"))


def _nearest(centres) -> Column:
    return F.array_min(F.array(*[F.struct(((F.col("px") - a) ** 2 + (F.col("py") - b) ** 2).alias("d"), F.lit(i).alias("i")) for i, (a, b) in enumerate(centres)]))["i"]


# Quality of coverages and networks.
def coverage_overlaps(df: DataFrame, fid: str, geom: str = "geom", min_overlap: float = 1e-3, size: float = 1.0) -> DataFrame:
    """Pairs of areas that overlap by more than ``min_overlap`` square metres, with the overlap."""
    rows = df.select(F.col(fid).alias("a"), F.col(geom).alias("ga"), T.bbox(F.col(geom)).alias("lbox"))
    pairs = boxes_join(rows, rows.toDF("b", "gb", "rbox"), size).filter("a < b").select("a", "b", F.to_json("ga").alias("ga"), F.to_json("gb").alias("gb"))

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                a, b = (unpack(r[k]) for k in ("ga", "gb"))
                f = g.Frame(a, b)
                parts = pl.intersection(f.plane(a), f.plane(b))
                out.append((r["a"], r["b"], pl.area(parts), pack(f.earth(parts))))
            yield pd.DataFrame(out, columns=["a", "b", "area", "geom"])

    kind = df.schema[fid].dataType.simpleString()
    ship()
    return pairs.mapInPandas(run, f"a {kind}, b {kind}, area double, geom {GEOM_DDL}").filter(F.col("area") > min_overlap)


def coverage_gaps(df: DataFrame, fid: str, geom: str = "geom", min_gap: float = 1.0) -> DataFrame:
    """Holes of the areas' union over ``min_gap`` square metres, largest first."""
    whole = union_by(df, None, geom, fid)

    def run(batches):
        for pdf in batches:
            out = []
            for x in pdf["geom"]:
                v = unpack(x)
                f = g.Frame(v)
                for part in f.plane(v):
                    out += [(abs(pl.ring_sum(h)), pack(("Polygon", [[f.back(h[::-1])]]))) for h in part[1:]]
            yield pd.DataFrame(out, columns=["area", "geom"])

    ship()
    return whole.select(F.to_json("geom").alias("geom")).mapInPandas(run, f"area double, geom {GEOM_DDL}").filter(F.col("area") >= min_gap).orderBy(F.desc("area"))


def network_ends(df: DataFrame, line_id: str, geom: str = "geom", max_undershoot: float = 0.0, max_overshoot: float = 0.0, size: float = 0.1) -> DataFrame:
    """code, line, x, y, distance: ends of one line alone that stop short of another line, or run past one, by metres at most."""
    from tellurion.operators.joins import lines_within, overshoots

    r = F.element_at(F.element_at(F.col(geom)["parts"], 1), 1)
    ends = df.select(F.col(line_id).alias("line"), F.explode(F.array(F.element_at(r, 1), F.element_at(r, -1))).alias("p")).select("line", "p.x", "p.y")
    alone = ends.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line")).filter("n = 1").select("line", "x", "y")
    alone = land(alone.withColumn("end", F.struct("line", "x", "y")))
    # The line's own segments are no neighbours of its end.
    near = lines_within(alone.select("end", "x", "y"), df, "end", line_id, max_undershoot, "x", "y", geom, but=F.col("end.line"))
    under = near.filter("distance > 0").select(F.lit("undershoot").alias("code"), "end.line", "end.x", "end.y", "distance")
    over = overshoots(alone, df, line_id, max_overshoot, size, "overlapping", geom).filter("distance > 0")
    over = over.groupBy("line", "x", "y").agg(F.min("distance").alias("distance")).select(F.lit("overshoot").alias("code"), "line", "x", "y", "distance")
    return under.unionByName(over)


def network_issues(df: DataFrame, line_id: str, geom: str = "geom", size: float = 0.1) -> DataFrame:
    """code, x, y: dangles, pseudo nodes and crossings without a node."""
    from tellurion.operators.aggregates import network_nodes
    from tellurion.operators.joins import line_intersect

    nodes = network_nodes(df, line_id, geom)
    ends = nodes.filter("degree = 1").select(F.lit("dangle").alias("code"), "x", "y")
    pseudo = nodes.filter("degree = 2 and lines = 2").select(F.lit("pseudo-node").alias("code"), "x", "y")
    a = df.select(F.col(line_id).alias("a"), F.col(geom).alias("geom"))
    cross = line_intersect(a, a.toDF("b", "geom2"), "a", "b", "geom", "geom2", size, overlaps=False, less=True)
    cross = cross.select(F.round("x", 9).alias("x"), F.round("y", 9).alias("y")).distinct().join(nodes.select("x", "y"), ["x", "y"], "left_anti")
    return ends.unionByName(pseudo).unionByName(cross.select(F.lit("crossing-without-node").alias("code"), "x", "y"))
