"""Spatial joins as cell-id equi-joins with an exact residual test.

A region is listed at the level that its size asks for, under the four cells at most
that its box meets there; a point is listed under its cell of every level that is in
use. The engine then hash-joins on cells, splits hot cells at run time, and the
residual test decides. So a region that is far larger than the others costs four
rows and a level, and nothing here falls back to a nested loop.

Columns that joins add for themselves have names that the tables don't.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellurion.functions import measure
from tellurion.functions import types as T
from tellurion.functions.shapes import boxes_meet, point_in_polygon
from tellurion.operators import segments
from tellurion.session import land

#: A degree of latitude is nowhere shorter, in metres; nor one of longitude, times the cosine of latitude.
DEGREE = 110_000.0


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("int")


def fresh(*frames: DataFrame):
    """Names for columns that none of the tables has."""
    taken = {c.lower() for df in frames for c in df.columns}

    def name(base: str) -> str:
        own = f"__{base}"
        while own.lower() in taken:
            own = f"_{own}"
        taken.add(own.lower())
        return own

    return name


def level_of(box: Column, least: float = 2.0**-30) -> Column:
    """The level whose cells, of side 2 to that power, are no smaller than the box nor than ``least``."""
    return F.ceil(F.log2(F.greatest(box["xmax"] - box["xmin"], box["ymax"] - box["ymin"], F.lit(least)))).cast("int")


def at_level(x: Column, level: Column) -> Column:
    return F.floor(x / F.pow(F.lit(2.0), level)).cast("long")


def levels_in_use(*rows: DataFrame) -> list[int]:
    """The levels in the one column of each table, a few dozen at most; a null box has none."""
    every = rows[0].toDF("l")
    for other in rows[1:]:
        every = every.unionByName(other.toDF("l"))
    return sorted(r["l"] for r in every.filter("l is not null").distinct().collect())


def listed(df: DataFrame, box: str, level: Column, names: tuple[str, str, str]) -> DataFrame:
    """A row for each cell that the box meets at each of the level's values, with level and cell."""
    m, cx, cy = names
    b = F.col(box)
    rows = df.withColumn(m, level)
    for c, lo, hi in ((cx, "xmin", "xmax"), (cy, "ymin", "ymax")):
        rows = rows.withColumn(c, F.explode(F.sequence(at_level(b[lo], F.col(m)), at_level(b[hi], F.col(m)))))
    return rows


def placed(df: DataFrame, x: str, y: str, levels: list[int], names: tuple[str, str, str]) -> DataFrame:
    """A row for each level with the point's cell."""
    m, cx, cy = names
    rows = df.withColumn(m, F.lit(levels[0]) if len(levels) == 1 else F.explode(F.array(*map(F.lit, levels))))
    return rows.withColumns({cx: at_level(F.col(x), F.col(m)), cy: at_level(F.col(y), F.col(m))})


def points_in_regions(points: DataFrame, regions: DataFrame, x: str = "lon", y: str = "lat", geom: str = "geom", how: str = "inner", ignore_boundary: bool = False) -> DataFrame:
    """Points with each region that they are in; ``how`` is inner, left, left_semi or left_anti.

    Column names of the two sides must differ. A null coordinate or region meets nothing.
    """
    name = fresh(points, regions)
    box, level, own, other = name("box"), name("level"), (name("m"), name("px"), name("py")), (name("n"), name("cx"), name("cy"))
    sized = regions.withColumn(box, T.bbox(F.col(geom))).withColumn(level, level_of(F.col(box)))
    levels = levels_in_use(sized.select(level))
    if not levels:
        return points.join(regions.limit(0), F.lit(False), how)

    def joined(left: DataFrame, at: list[int], how: str) -> DataFrame:
        right = listed(sized if len(at) == len(levels) else sized.filter(F.col(level).isin(at)), box, F.col(level), other)
        left = placed(left, x, y, at, own)
        test = F.lit(True)
        for p, q in zip(own, other, strict=True):
            test = test & (left[p] == right[q])
        test = test & F.col(x).between(F.col(box)["xmin"], F.col(box)["xmax"]) & F.col(y).between(F.col(box)["ymin"], F.col(box)["ymax"])
        test = test & point_in_polygon(F.col(x), F.col(y), F.col(geom), ignore_boundary)
        return left.join(right, test, how).drop(*own, *other, box, level)

    if how == "inner" or len(levels) == 1:
        return joined(points, levels, how)
    # What must tell a point's absence goes level by level, so that each point stays one row.
    rest, found = points, []
    for m in levels:
        if how == "left_semi":
            found.append(joined(rest, [m], "left_semi"))
        rest = joined(rest, [m], "left_anti")
    if how == "left_anti":
        return rest
    if how == "left":
        return joined(points, levels, "inner").unionByName(rest, allowMissingColumns=True)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def tag(points: DataFrame, regions: DataFrame, field: str, out_field: str, point_id: str, region_id: str, x: str = "lon", y: str = "lat") -> DataFrame:
    """Every point with ``field`` of the first region, by id, that it is in; null for none."""
    own = regions.select(F.col(region_id).alias("_rid"), F.col(field).alias("_field"), "geom")
    hits = points_in_regions(points.select(point_id, x, y), own, x, y).groupBy(point_id).agg(F.min_by("_field", "_rid").alias(out_field))
    return points.join(hits, point_id, "left")


def collect(regions: DataFrame, points: DataFrame, field: str, out_field: str, region_id: str, point_id: str, x: str = "lon", y: str = "lat") -> DataFrame:
    """Every region with the values of ``field`` of its points, in order of their ids; an empty array for none."""
    own = points.select(F.col(point_id).alias("_pid"), F.col(field).alias("_field"), x, y).filter(F.col("_field").isNotNull())
    hits = points_in_regions(own, regions.select(region_id, "geom"), x, y).groupBy(region_id)
    hits = hits.agg(F.transform(F.sort_array(F.collect_list(F.struct("_pid", "_field"))), lambda s: s["_field"]).alias(out_field))
    empty = F.array().cast(hits.schema[out_field].dataType)
    return regions.join(hits, region_id, "left").withColumn(out_field, F.coalesce(out_field, empty))


def points_within_polygon(points: DataFrame, regions: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    return points_in_regions(points, regions.select("geom"), x, y, how="left_semi")


def reach(y: Column, radius: float) -> tuple[Column, Column]:
    """Degrees of longitude and latitude that surely hold all within so many metres."""
    up = F.lit(radius / DEGREE)
    most = F.least(F.lit(89.9), F.abs(y) + up)
    return F.least(F.lit(360.0), radius / (DEGREE * F.cos(F.radians(most)))), up


def within_distance(left: DataFrame, right: DataFrame, radius: float, distance=None, lx: str = "lon", ly: str = "lat", rx: str = "rlon", ry: str = "rlat", out: str = "distance") -> DataFrame:
    """Pairs within ``radius`` metres, with their distance in metres.

    ``distance`` maps four columns to metres; the rhumb distance unless another
    is given. What the rhumb distance needs of a point is computed once for the
    point, before the join. The left side is listed under the cells that its
    circle's box meets. No pair is found across the antimeridian.
    """
    if distance is None:
        from tellurion.operators import near

        return near.pairs(left, right, radius, lx, ly, rx, ry, out)
    name = fresh(left, right)
    box, level, here, there = name("reach"), name("level"), (name("m"), name("cx"), name("cy")), (name("n"), name("px"), name("py"))
    dx, dy = reach(F.col(ly), radius)
    a, b = F.col(lx), F.col(ly)
    circle = F.struct((a - dx).alias("xmin"), (b - dy).alias("ymin"), (a + dx).alias("xmax"), (b + dy).alias("ymax"))
    left = left.withColumn(box, circle).withColumn(level, level_of(circle))
    levels = levels_in_use(left.select(level))
    own, right = listed(left, box, F.col(level), here), placed(right, rx, ry, levels or [0], there)
    test = F.col(rx).between(F.col(box)["xmin"], F.col(box)["xmax"]) & F.col(ry).between(F.col(box)["ymin"], F.col(box)["ymax"])
    for p, q in zip(here, there, strict=True):
        test = test & (own[p] == right[q])
    pairs = own.join(right, test).withColumn(out, distance(a, b, F.col(rx), F.col(ry))).drop(box, level, *here, *there)
    return pairs.filter(F.col(out) <= radius)


def halvings(points: DataFrame, radius: float, x: str, y: str) -> int:
    """How much finer than a circle's box cells should be, so that a cell holds some hundred points at least: three times at most; one small aggregate."""
    each = density_radius(points, 64, x, y)
    return max(0, min(3, math.ceil(math.log2(max(1.0, radius / each)))))


def density_radius(points: DataFrame, per_circle: float, x: str, y: str) -> float:
    """Metres of a circle that holds so many points where they are spread evenly over their box; one small aggregate."""
    s = points.agg(F.count(x).alias("n"), F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")).first()
    if not s["n"] or s["x0"] is None or s["y0"] is None:
        return 1.0
    mid = math.radians((s["y0"] + s["y1"]) / 2)
    area = max(s["x1"] - s["x0"], 1e-9) * DEGREE * max(math.cos(mid), 0.01) * max(s["y1"] - s["y0"], 1e-9) * DEGREE
    return max(1.0, math.sqrt(per_circle * area / (math.pi * s["n"])))


def widening(rest: DataFrame, target_id: str, start: float, search, most: float = 4e7) -> DataFrame:
    """``search(targets, radius)`` over circles that grow fourfold, for the targets that have found nothing yet.

    Every round's results and what is left are landed, so a round runs once. What
    a circle holds is complete, so a target that has found something is done.
    """
    out, radius = None, start
    while True:
        found = land(search(rest, radius))
        out = found if out is None else out.unionByName(found)
        rest = land(rest.join(found.select(target_id).distinct(), target_id, "left_anti"))
        if radius > most or not rest.limit(1).count():
            return out
        radius *= 4


#: Points of a cell that isn't taken apart any further, and the finest cells' level.
LEAF, FINEST = 8, 40
#: Metres of a degree of latitude, or of one of longitude times the cosine of latitude, at most.
DEGREE_MOST = 111_700.0


def nearest_point(targets: DataFrame, points: DataFrame, target_id: str, point_id: str, distance=None, lx: str = "lon", ly: str = "lat", rx: str = "rlon", ry: str = "rlat") -> DataFrame:
    """target_id, point_id and distance of the nearest point; the smaller id wins a tie."""
    return nearest_k(targets, points, target_id, point_id, 1, distance, lx, ly, rx, ry).drop("rank")


def nearest_k(targets: DataFrame, points: DataFrame, target_id: str, point_id: str, k: int, distance=None, lx: str = "lon", ly: str = "lat", rx: str = "rlon", ry: str = "rlat") -> DataFrame:
    """The k nearest points of each target with their ranks; of points as near as each other the smaller id comes first.

    Cells are taken apart from the whole box down, those with few points not at
    all. Each target keeps the cells that may hold one of its k nearest: those that
    its circle meets, whose radius is the distance within which cells with k
    points surely lie. So how points are spread doesn't matter: a target keeps a few
    cells at each level, and only their points are measured. ``distance`` maps
    four columns to metres, along rhumb lines (the default) or geodesics. Target
    ids must be unique; rows with a null position find nothing and are found by none.
    """
    from pyspark.sql import Window

    # Of points in one place the first k ids are enough.
    own = points.select(F.col(point_id).alias("pid"), F.col(rx).alias("x"), F.col(ry).alias("y")).filter("x is not null and y is not null")
    own = own.withColumn("o", F.row_number().over(Window.partitionBy("x", "y").orderBy("pid"))).filter(F.col("o") <= k).drop("o")
    ends = own.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")).first()
    aims = targets.select(F.col(target_id).alias("tid"), F.col(lx).alias("tx"), F.col(ly).alias("ty")).filter("tx is not null and ty is not null")
    schema = [F.col("tid").alias(target_id), F.col("pid").alias(point_id), "distance", "rank"]
    if ends["x0"] is None:
        return aims.join(own, F.lit(False)).withColumns({"distance": F.lit(0.0), "rank": F.lit(1)}).select(*schema)
    x0, y0 = ends["x0"], ends["y0"]
    side = max(ends["x1"] - x0, ends["y1"] - y0, 1e-9) * (1 + 1e-9)
    fine = lambda c, lo: F.floor((F.col(c) - lo) / side * float(1 << FINEST)).cast("long")
    own = land(own.withColumns({"ix": fine("x", x0), "iy": fine("y", y0)}))
    total = own.count()
    step = 2 if total > LEAF else FINEST

    def cells(level: int) -> DataFrame:
        """Each cell with its number of points, and the box about them."""
        at = [F.shiftright(c, FINEST - level).alias(n) for c, n in (("ix", "cx"), ("iy", "cy"))]
        return own.groupBy(*at).agg(F.count(F.lit(1)).alias("m"), F.min("x").alias("xa"), F.min("y").alias("ya"), F.max("x").alias("xb"), F.max("y").alias("yb"))

    far = lambda t, lo, hi: F.greatest(F.abs(F.col(t) - F.col(lo)), F.abs(F.col(t) - F.col(hi)))
    least_lat = F.greatest(F.lit(0.0), F.least(F.abs(F.col("ty")), F.when((F.col("ya") <= 0) & (F.col("yb") >= 0), 0.0).otherwise(F.least(F.abs("ya"), F.abs("yb")))))
    crossing = F.when(F.col("ty") * F.col("ya") < 0, 0.0).when(F.col("ty") * F.col("yb") < 0, 0.0).otherwise(least_lat)
    most = DEGREE_MOST * F.hypot(far("ty", "ya", "yb"), F.cos(F.radians(crossing)) * far("tx", "xa", "xb"))

    def pruned(pairs: DataFrame) -> DataFrame:
        """The pairs whose cell the target's circle meets."""
        ranked = pairs.withColumn("most", most).withColumn("sum", F.sum("m").over(Window.partitionBy("tid").orderBy("most", "level", "cx", "cy").rowsBetween(Window.unboundedPreceding, 0)))
        bound = F.min(F.when(F.col("sum") >= min(k, total), F.col("most"))).over(Window.partitionBy("tid"))
        ranked = ranked.withColumn("bound", bound * (1 + 1e-9) + 1e-6)
        dy = F.col("bound") / DEGREE
        dx = F.least(F.lit(360.0), F.col("bound") / (DEGREE * F.cos(F.radians(F.least(F.lit(89.9), F.abs("ty") + dy)))))
        meets = (F.col("xb") >= F.col("tx") - dx) & (F.col("xa") <= F.col("tx") + dx) & (F.col("yb") >= F.col("ty") - dy) & (F.col("ya") <= F.col("ty") + dy)
        return land(ranked.filter(meets).drop("most", "sum", "bound"))

    root = cells(0).withColumn("level", F.lit(0))
    # One row meets every target.
    pairs = aims.join(F.broadcast(root))
    level = 0
    while level < FINEST:
        open_ = pairs.filter((F.col("m") > LEAF) & (F.col("level") == level))
        if level and not open_.limit(1).count():
            break
        if not level and total <= LEAF:
            break
        level += step
        below = cells(level).withColumns({"ux": F.shiftright("cx", step), "uy": F.shiftright("cy", step)})
        parts = open_.select("tid", "tx", "ty", F.col("cx").alias("ux"), F.col("cy").alias("uy")).join(below, ["ux", "uy"]).drop("ux", "uy").withColumn("level", F.lit(level))
        closed = pairs.filter((F.col("m") <= LEAF) | (F.col("level") < level - step))
        pairs = pruned(closed.unionByName(parts))
    used = levels_in_use(pairs.select("level")) or [0]
    at = own.withColumn("level", F.explode(F.array(*map(F.lit, used))))
    at = at.select("pid", "x", "y", "level", *(F.expr(f"shiftright({c}, {FINEST} - level)").alias(n) for c, n in (("ix", "cx"), ("iy", "cy"))))
    metres = measure.rhumb_between(measure.rhumb_place(F.col("tx"), F.col("ty")), measure.rhumb_place(F.col("x"), F.col("y"))) if distance is None else distance(F.col("tx"), F.col("ty"), F.col("x"), F.col("y"))
    found = pairs.select("tid", "tx", "ty", "level", "cx", "cy").join(at, ["level", "cx", "cy"]).withColumn("distance", metres)
    if k == 1:
        return found.groupBy("tid").agg(F.min(F.struct("distance", "pid")).alias("b")).select(F.col("tid"), F.col("b.pid").alias("pid"), F.col("b.distance").alias("distance"), F.lit(1).alias("rank")).select(*schema)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("tid").orderBy("distance", "pid"))).filter(F.col("rank") <= k).select(*schema)


#: Great circles of geodetic latitudes lie by so many hundredths from geodesics, and sag by so much of the length squared over the radius.
OFF, SAG, RADIUS = 0.01, 0.01, 6371008.8


def _units(lon, lat):
    import numpy as np

    lam, phi = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(phi) * np.cos(lam), np.cos(phi) * np.sin(lam), np.sin(phi)], axis=-1)


def _arcs(p, q):
    """Metres between unit vectors on the sphere."""
    import numpy as np

    return 2 * RADIUS * np.arcsin(np.minimum(1.0, np.sqrt(((p - q) ** 2).sum(-1)) / 2))


def segment_bounds(ax, ay, bx, by, px, py):
    """Metres that a geodesic segment is away from a point at least and at most, from great circles; arrays."""
    import numpy as np

    a, b, p = _units(ax, ay), _units(bx, by), _units(px, py)
    n = np.cross(a, b)
    size, length = np.sqrt((n * n).sum(-1)), _arcs(a, b)
    beside = (size > 1e-12) & ((np.cross(n, a) * p).sum(-1) >= 0) & ((np.cross(b, n) * p).sum(-1) >= 0)
    off = RADIUS * np.arcsin(np.minimum(1.0, np.abs((n * p).sum(-1)) / np.where(beside, size, 1.0)))
    m = np.where(beside, off, np.minimum(_arcs(p, a), _arcs(p, b)))
    # A metre more: feet on segments of a decimetre are off by centimetres themselves.
    spare = SAG * length * length / RADIUS + 1.0
    far = (length > 5e6) | (m > 5e6)
    return np.where(far, 0.0, m * (1 - OFF) - spare), np.where(far, np.inf, m * (1 + OFF) + spare)


def _bounds_column(f, *columns) -> Column:
    """``f``'s bounds of arrays as a struct of least and most."""
    import pandas as pd
    from pyspark.sql.types import DoubleType, StructField, StructType

    from tellurion.session import ship

    def run(*series):
        return pd.DataFrame(dict(zip(("least", "most"), f(*(v.to_numpy(float) for v in series)), strict=True)))

    run.__annotations__ = {"series": pd.Series, "return": pd.DataFrame}
    ship()
    return F.pandas_udf(run, StructType([StructField(n, DoubleType()) for n in ("least", "most")]))(*columns)


def lines_within(points: DataFrame, lines: DataFrame, point_id: str, line_id: str, radius: float, x: str = "lon", y: str = "lat", geom: str = "geom", but: Column | None = None) -> DataFrame:
    """Each point's nearest line within ``radius`` metres: point_id, line_id, seg (from 0), x, y and distance.

    Lines are geodesics between their positions. Of lines as near as each other
    the smaller id has it. Segments are listed in the cells that they pass, points in those that
    their circle's box meets; great circles bound the distance of each pair, and the exact
    foot is solved for those that may be nearest. ``but`` names a line that isn't the
    point's neighbour.
    """
    from pyspark.sql import Window

    from tellurion.functions.geodesic import foot

    segs = segments.flat(lines, geom, line_id)
    dx, dy = F.col("qx") - F.col("px"), F.col("qy") - F.col("py")
    # A geodesic may leave its ends' box towards the pole; no farther than a great circle's sagitta and a tenth. Off the straight line it lies farther.
    bulge = 1.1 * F.degrees(F.radians(F.abs(dx)) ** 2) / 16
    steep = F.tan(F.radians(F.least(F.lit(89.0), F.greatest(F.abs("py"), F.abs("qy")) + 1)))
    lean = F.degrees(F.radians(F.abs(dy)) * (F.radians(F.abs(dx)) + F.radians(F.abs(dy))) * steep)
    short = (F.greatest(F.abs(dx), F.abs(dy)) < 5) & (F.greatest(F.abs("py"), F.abs("qy")) < 85)
    extent = F.greatest(F.abs(dx), F.abs(dy), F.lit(2.0**-30))
    size = max(1e-6, 2 * radius / DEGREE)
    segs = segs.withColumn("_m", F.greatest(F.ceil(F.log2(extent)).cast("int") - segments.PASSES, F.lit(math.ceil(math.log2(size)))))
    levels = levels_in_use(segs.select("_m"))
    segs = segments.passed(segs, None, (bulge + F.when(short, 0.5 * lean + bulge).otherwise(F.lit(0.0)), short))
    segs = segs.select(line_id, F.col("no").alias("seg"), F.col("px").alias("ax"), F.col("py").alias("ay"), F.col("qx").alias("bx"), F.col("qy").alias("by"), "_m", "_cx", "_cy")
    wide, high = reach(F.col(y), radius)
    name = fresh(points, segs)
    n, cx, cy, own = name("n"), name("px"), name("py"), name("own")
    at = points.select(point_id, x, y).filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    at = at.withColumn(own, F.struct((F.col(x) - wide).alias("xmin"), (F.col(y) - high).alias("ymin"), (F.col(x) + wide).alias("xmax"), (F.col(y) + high).alias("ymax")))
    at = listed(at, own, F.explode(F.array(*map(F.lit, levels or [0]))), (n, cx, cy)).drop(own)
    # Pairs may come from several cells; the nearest is the same.
    pairs = at.join(segs.hint("merge"), (at[n] == segs["_m"]) & (at[cx] == segs["_cx"]) & (at[cy] == segs["_cy"])).drop(n, cx, cy, "_m", "_cx", "_cy")
    pairs = pairs if but is None else pairs.filter(F.col(line_id) != but)
    pairs = pairs.withColumn("_d", _bounds_column(segment_bounds, "ax", "ay", "bx", "by", x, y)).filter(F.col("_d.least") <= radius)
    pairs = pairs.withColumn("_best", F.min("_d.most").over(Window.partitionBy(point_id))).filter(F.col("_d.least") <= F.col("_best"))
    pairs = pairs.withColumn("f", foot("ax", "ay", "bx", "by", x, y)).filter(F.col("f.dist") <= radius)
    best = pairs.groupBy(point_id).agg(F.min(F.struct(F.round("f.dist", 9).alias("d"), line_id, "seg", "f.x", "f.y")).alias("b"))
    return best.select(point_id, F.col(f"b.{line_id}").alias(line_id), "b.seg", "b.x", "b.y", F.col("b.d").alias("distance"))


def overshoots(ends: DataFrame, lines: DataFrame, line_id: str, radius: float, size: float, how: str, geom: str = "geom") -> DataFrame:
    """line, x, y and distance of each end that lies beyond a place where its line meets another, by ``radius`` metres at most; the nearest such place.

    ``ends`` has line, x and y. Only as much of a line as lies about its end is held against others.
    """
    dx, dy = reach(F.col("y"), radius)
    about = F.struct((F.col("x") - dx).alias("xmin"), (F.col("y") - dy).alias("ymin"), (F.col("x") + dx).alias("xmax"), (F.col("y") + dy).alias("ymax"))
    rows = segments.flat(lines, geom, line_id)
    own = rows.withColumnRenamed(line_id, "line").join(ends.select("line", F.col("x").alias("ex"), F.col("y").alias("ey"), about.alias("about")), "line")
    near = boxes_meet(F.struct(F.least("px", "qx").alias("xmin"), F.least("py", "qy").alias("ymin"), F.greatest("px", "qx").alias("xmax"), F.greatest("py", "qy").alias("ymax")), F.col("about"))
    met = segments.meetings(own.filter(near), rows.withColumnRenamed(line_id, "other"), ["line", "ex", "ey"], ["other"], size, how, bound="about").filter("line != other")
    bounds = lambda ax, ay, bx, by: (_arcs(_units(ax, ay), _units(bx, by)) * (1 - OFF),) * 2
    met = met.filter(_bounds_column(bounds, "ex", "ey", "x", "y")["least"] <= radius)
    d = met.withColumn("distance", geodesic_metres(F.col("ex"), F.col("ey"), F.col("x"), F.col("y"))).filter(F.col("distance") <= radius)
    return d.select("line", F.col("ex").alias("x"), F.col("ey").alias("y"), "distance")


def nearest_line(points: DataFrame, lines: DataFrame, point_id: str, line_id: str, start: float | None = None, x: str = "lon", y: str = "lat", geom: str = "geom") -> DataFrame:
    """Each point's nearest line of a table, as ``lines_within`` gives it, by circles that grow until they meet one."""
    ends = lines.select(F.explode(T.positions_of(F.col(geom))).alias("p")).select("p.x", "p.y")
    search = lambda rest, radius: lines_within(rest, lines, point_id, line_id, radius, x, y, geom)
    return widening(points.select(point_id, x, y), point_id, start or density_radius(ends, 1, "x", "y"), search)


def nearest_point_to_line(points: DataFrame, line: Column, point_id: str, x: str = "lon", y: str = "lat") -> DataFrame:
    """The point that is nearest to one line, as point_id and distance in metres; the smaller id wins a tie."""
    from tellurion.functions.udfs import point_to_line_distance

    d = points.select(point_id, F.round(point_to_line_distance(line, F.col(x), F.col(y)), 9).alias("distance")).filter(F.col("distance").isNotNull())
    return d.agg(F.min(F.struct("distance", point_id)).alias("b")).select(F.col(f"b.{point_id}").alias(point_id), F.col("b.distance").alias("distance"))


def snap_points(points: DataFrame, reference: DataFrame, point_id: str, line_id: str, tolerance: float, x: str = "lon", y: str = "lat", geom: str = "geom") -> DataFrame:
    """Every point with x, y moved onto the reference within ``tolerance`` metres, and whether it moved.

    A reference position within reach comes first, or else the nearest place on a
    reference line. The reference's lines are taken as they are, not noded.
    """
    ends = reference.select(F.explode(T.positions_of(F.col(geom))).alias("_p")).select(F.col("_p.x").alias("_vx"), F.col("_p.y").alias("_vy")).distinct()
    own = points.select(point_id, x, y)
    # Circles grow to the tolerance from one that holds a few positions, so a crowd of them isn't measured.
    at, rest, radius = None, own, 0.0
    while radius < tolerance:
        radius = min(tolerance, radius * 4 or density_radius(ends, 4, "_vx", "_vy"))
        found = within_distance(rest, ends, radius, geodesic_metres, x, y, "_vx", "_vy").groupBy(point_id).agg(F.min(F.struct("distance", "_vx", "_vy")).alias("_v"))
        found = land(found)
        at = found if at is None else at.unionByName(found)
        if radius < tolerance:
            rest = land(rest.join(found, point_id, "left_anti"))
    if at is None:
        at = own.select(point_id, F.lit(None).cast("struct<distance:double,_vx:double,_vy:double>").alias("_v")).limit(0)
    rest = own.join(at, point_id, "left_anti")
    near = lines_within(rest, reference, point_id, line_id, tolerance, x, y, geom).select(point_id, F.col("x").alias("_ex"), F.col("y").alias("_ey"))
    out = own.join(at, point_id, "left").join(near, point_id, "left")
    nx, ny = F.coalesce("_v._vx", "_ex", x), F.coalesce("_v._vy", "_ey", y)
    return out.select(point_id, nx.alias("x"), ny.alias("y"), ((nx != F.col(x)) | (ny != F.col(y))).alias("moved"))


def geodesic_metres(a: Column, b: Column, c: Column, d: Column) -> Column:
    from tellurion.functions.geodesic import distance

    return distance(a, b, c, d, "meters")


def boxes_join(left: DataFrame, right: DataFrame, size: float, lbox: str = "lbox", rbox: str = "rbox", same: tuple[str, str] | None = None) -> DataFrame:
    """Pairs of rows whose boxes meet, each once: a pair counts at the level of its larger box, in the cell of its common corner.

    ``same`` names a column of each side that must be equal too.

    Cells are of ``size`` at least. Each row is listed at its own level and at those in use above it.
    """
    name = fresh(left, right)
    la, lb, own, other = name("la"), name("lb"), (name("m"), name("cx"), name("cy")), (name("n"), name("dx"), name("dy"))
    a, b = left.withColumn(la, level_of(F.col(lbox), size)), right.withColumn(lb, level_of(F.col(rbox), size))
    levels = levels_in_use(a.select(la), b.select(lb))
    if not levels:
        return left.join(right, F.lit(False))
    above = lambda l: F.lit(levels[0]) if len(levels) == 1 else F.explode(F.filter(F.array(*map(F.lit, levels)), lambda m: m >= F.col(l)))
    a, b = listed(a, lbox, above(la), own), listed(b, rbox, above(lb), other)
    test = boxes_meet(F.col(lbox), F.col(rbox)) & (F.col(own[0]) == F.greatest(F.col(la), F.col(lb)))
    for p, q in zip(own, other, strict=True):
        test = test & (a[p] == b[q])
    if same:
        test = test & (a[same[0]] == b[same[1]])
    for c, lo in ((own[1], "xmin"), (own[2], "ymin")):
        test = test & (F.col(c) == at_level(F.greatest(F.col(lbox)[lo], F.col(rbox)[lo]), F.col(own[0])))
    return a.join(b, test).drop(*own, *other, la, lb)


def segment_rows(lines: DataFrame, line_id: str, geom: str, out: str) -> DataFrame:
    """A row for each segment: the line's id, the segment's number, p and q as a struct, and its box."""
    rows = lines.select(F.col(line_id), F.explode(T.rings_of(F.col(geom))).alias("_ring")).select(line_id, F.posexplode(measure.segments(F.col("_ring"))).alias(f"{out}_no", out))
    s = F.col(out)
    box = F.struct(F.least(s["p"]["x"], s["q"]["x"]).alias("xmin"), F.least(s["p"]["y"], s["q"]["y"]).alias("ymin"), F.greatest(s["p"]["x"], s["q"]["x"]).alias("xmax"), F.greatest(s["p"]["y"], s["q"]["y"]).alias("ymax"))
    return rows.withColumn(f"{out}_box", box)


def line_intersect(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_geom: str = "geom", right_geom: str = "geom", size: float = 1.0, overlaps: bool = True, less: bool = False) -> DataFrame:
    """left_id, right_id, x, y of every place where two lines meet; ends of collinear overlaps included, unless ``overlaps`` is false.

    With ``less`` only pairs whose left id is the smaller.
    """
    a, b = segments.flat(left, left_geom, left_id), segments.flat(right, right_geom, right_id)
    met = segments.meetings(a, b, [left_id], [right_id], size, "overlapping" if overlaps else "touching", ([left_id], [right_id]) if less else None)
    return met.select(left_id, right_id, "x", "y").distinct() if overlaps else met


def nearest_point_plane(points: DataFrame, fid: str, start: float, px: str = "px", py: str = "py") -> DataFrame:
    """Each point's distance to the nearest other point in a plane; circles grow fourfold until they hold one."""
    rest = land(points.select(F.col(fid).alias("fid"), F.col(px).alias("px"), F.col(py).alias("py")))
    others = rest.toDF("other", "qx", "qy")

    def search(rest: DataFrame, radius: float) -> DataFrame:
        box = F.struct((F.col("px") - radius).alias("xmin"), (F.col("py") - radius).alias("ymin"), (F.col("px") + radius).alias("xmax"), (F.col("py") + radius).alias("ymax"))
        own = rest.withColumn("_cx", F.explode(F.sequence(cell(box["xmin"], 2 * radius), cell(box["xmax"], 2 * radius)))).withColumn("_cy", F.explode(F.sequence(cell(box["ymin"], 2 * radius), cell(box["ymax"], 2 * radius))))
        there = others.withColumn("_px", cell(F.col("qx"), 2 * radius)).withColumn("_py", cell(F.col("qy"), 2 * radius))
        d = F.sqrt((F.col("px") - F.col("qx")) ** 2 + (F.col("py") - F.col("qy")) ** 2)
        pairs = own.join(there, (own["_cx"] == there["_px"]) & (own["_cy"] == there["_py"])).filter("fid != other").withColumn("distance", d)
        return pairs.filter(F.col("distance") <= radius).groupBy("fid").agg(F.min("distance").alias("distance"))

    return widening(rest, "fid", start, search, 1e8)


def length_of(lines: DataFrame, line_id: str, geom: str = "geom") -> DataFrame:
    """line_id and metres of each line with planar edges, from a row for each panel of each segment.

    The quadrature is unrolled in compiled code, and panels are summed before
    they are shuffled; ``measure.length`` does the same inside one row.
    """
    rows = segment_rows(lines, line_id, geom, "s").select(line_id, F.col("s.p.x").alias("px"), F.col("s.p.y").alias("py"), F.col("s.q.x").alias("qx"), F.col("s.q.y").alias("qy"))
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("qx") - F.col("px")), F.abs(F.col("qy") - F.col("py"))) / measure.PANEL)).cast("int")
    rows = rows.withColumn("k", n).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    d_phi, d_lam = F.radians(F.col("qy") - F.col("py")), F.radians(F.col("qx") - F.col("px"))
    total = F.lit(0.0)
    for t, w in zip(measure.NODES, measure.NODE_WEIGHTS, strict=True):
        phi = F.radians(F.col("py") + (F.col("qy") - F.col("py")) * ((F.col("j") + float(t)) / F.col("k")))
        v = 1 - measure.E2 * F.sin(phi) * F.sin(phi)
        m, p = measure.A * (1 - measure.E2) / (v * F.sqrt(v)) * d_phi, measure.A / F.sqrt(v) * F.cos(phi) * d_lam
        total = total + float(w) * F.sqrt(m * m + p * p)
    return rows.select(line_id, (total / F.col("k")).alias("metres")).groupBy(line_id).agg(F.sum("metres").alias("metres"))
