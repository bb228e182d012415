"""Delaunay triangles of a table of points, tile by tile.

A tile's task knows the points of the tile and of its eight neighbours. A triangle
is final when its circumcircle, as far as it lies within the box of all points, is
inside what the tiles of its three corners know: then no other point can be in
it. A point all of whose triangles are final is done; the others go on to tiles
four times as wide, with the sectors that their final triangles fill. What
a coarser tile finds within those sectors is no triangle of the whole and is left out.
Tiles begin so fine that none is crowded, and what is left in the end are the
points at the rim, whose circles reach far.

Orientation and circle tests are exact: floats with an error bound, whole numbers
where that doesn't decide. Of points on one circle, those last in order of their
coordinates count as lifted by ever smaller amounts, so the triangles are the same in whatever
tile they are found. The hull is closed by triangles with a corner at infinity.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellurion.functions import crs
from tellurion.functions import types as T
from tellurion.session import land, ship

#: Points of the most crowded tile when tiles begin, and points that are finished in one task.
TILE, REST = 1000, 8000
DEEPEST = 40
EPS = 2.0**-53
#: Relative errors of the two determinants, and a little more.
TURN_ERROR, CIRCLE_ERROR = 4 * EPS, 12 * EPS


def turn(a, b, c) -> float:
    """Positive where a, b, c turn left, negative where they turn right, zero on one line; exact in sign."""
    left, right = (a[0] - c[0]) * (b[1] - c[1]), (a[1] - c[1]) * (b[0] - c[0])
    det = left - right
    if abs(det) > TURN_ERROR * (abs(left) + abs(right)):
        return det
    ax, ay, bx, by, cx, cy = map(Fraction, (*a, *b, *c))
    det = (ax - cx) * (by - cy) - (ay - cy) * (bx - cx)
    return (det > 0) - (det < 0)


def in_circle(a, b, c, d) -> bool:
    """Whether d is inside the circle of a, b, c, which turn left; points on it are told apart by order."""
    ax, ay, bx, by, cx, cy = a[0] - d[0], a[1] - d[1], b[0] - d[0], b[1] - d[1], c[0] - d[0], c[1] - d[1]
    a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    p, q, r, s, t, u = bx * cy, cx * by, cx * ay, ax * cy, ax * by, bx * ay
    det = a2 * (p - q) + b2 * (r - s) + c2 * (t - u)
    if abs(det) > CIRCLE_ERROR * (a2 * (abs(p) + abs(q)) + b2 * (abs(r) + abs(s)) + c2 * (abs(t) + abs(u))):
        return det > 0
    ax, ay, bx, by, cx, cy, dx, dy = map(Fraction, (*a, *b, *c, *d))
    ax, ay, bx, by, cx, cy = ax - dx, ay - dy, bx - dx, by - dy, cx - dx, cy - dy
    exact = (ax * ax + ay * ay) * (bx * cy - cx * by) + (bx * bx + by * by) * (cx * ay - ax * cy) + (cx * cx + cy * cy) * (ax * by - bx * ay)
    if exact:
        return exact > 0
    # On the circle: the point that is last in order is lifted most, and what that does to the determinant decides.
    for k in sorted(range(4), key=lambda k: (a, b, c, d)[k], reverse=True):
        if k == 3:
            return False
        sign = turn(b, c, d) if k == 0 else -turn(a, c, d) if k == 1 else turn(a, b, d)
        if sign:
            return sign > 0
    return False


class Mesh:
    """Triangles by insertion; ``at[u, v]`` is the third corner of the triangle on the left of u, v.

    The corner ``n`` lies at infinity; its triangles stand on the outer side of the hull's edges.
    """

    def __init__(self, pts: list[tuple[float, float]]):
        self.pts, self.n = pts, len(pts)
        self.at: dict[tuple[int, int], int] = {}
        order = self._order()
        self.flat = True
        if len(order) < 3:
            return
        u, v = order[:2]
        third = next((k for k in range(2, len(order)) if turn(pts[u], pts[v], pts[order[k]])), None)
        if third is None:
            return
        self.flat = False
        w = order[third]
        if turn(pts[u], pts[v], pts[w]) < 0:
            u, v = v, u
        for t in ((u, v, w), (v, u, self.n), (w, v, self.n), (u, w, self.n)):
            self._put(*t)
        edge = (u, v)
        for k, p in enumerate(order):
            if k > 1 and k != third:
                edge = self._insert(p, self._find(p, edge))

    def _order(self) -> list[int]:
        """Along rows of boxes, back and forth, so that each point is near the one before."""
        p = np.array(self.pts, float).reshape(-1, 2)
        if not len(p):
            return []
        lo, size = p.min(0), np.maximum(np.ptp(p, axis=0), 1e-300)
        rows = max(1, int(math.sqrt(len(p) / 2)))
        band = np.minimum(((p[:, 1] - lo[1]) / size[1] * rows).astype(int), rows - 1)
        return np.lexsort((np.where(band % 2, -p[:, 0], p[:, 0]), band)).tolist()

    def _put(self, u: int, v: int, w: int) -> None:
        self.at[u, v], self.at[v, w], self.at[w, u] = w, u, v

    def _holds(self, u: int, v: int, w: int, p: int) -> bool:
        n, pts = self.n, self.pts
        if u == n:
            u, v, w = v, w, u
        elif v == n:
            u, v, w = w, u, v
        if w != n:
            return in_circle(pts[u], pts[v], pts[w], pts[p])
        side = turn(pts[u], pts[v], pts[p])
        return side > 0 or (side == 0 and min(pts[u], pts[v]) < pts[p] < max(pts[u], pts[v]))

    def _find(self, p: int, edge: tuple[int, int]) -> tuple[int, int]:
        """An edge of a triangle whose circle holds p, by a walk from another edge."""
        n, pts, at, q = self.n, self.pts, self.at, self.pts[p]
        u, v = edge
        while True:
            w = at[u, v]
            if n in (u, v, w):
                while w != n:
                    u, v, w = v, w, u
                side = turn(pts[u], pts[v], q)
                if side < 0:
                    u, v = v, u
                elif side > 0 or min(pts[u], pts[v]) < q < max(pts[u], pts[v]):
                    return u, v
                else:
                    # On the hull's line, beyond one end: along the hull towards it.
                    ahead = (q > pts[v]) == (pts[v] > pts[u]) and q != pts[v]
                    u, v = (n, v) if ahead else (u, n)
                continue
            for a, b in ((u, v), (v, w), (w, u)):
                if turn(pts[a], pts[b], q) < 0:
                    u, v = b, a
                    break
            else:
                return u, v

    def _insert(self, p: int, edge: tuple[int, int]) -> tuple[int, int]:
        at = self.at
        u, v = edge
        w = at[u, v]
        for e in ((u, v), (v, w), (w, u)):
            del at[e]
        todo, rim = [(u, v), (v, w), (w, u)], []
        while todo:
            a, b = todo.pop()
            x = at[b, a]
            if self._holds(b, a, x, p):
                for e in ((b, a), (a, x), (x, b)):
                    del at[e]
                todo += [(a, x), (x, b)]
            else:
                rim.append((a, b))
        for a, b in rim:
            self._put(a, b, p)
        return next((a, b) for a, b in rim if self.n not in (a, b))

    def triangles(self) -> np.ndarray:
        own = [(u, v, w) for (u, v), w in self.at.items() if u < v and u < w and w != self.n and v != self.n]
        return np.array(own, int).reshape(-1, 3)

    def hull(self) -> list[tuple[int, int]]:
        """The hull's edges, each with the outside on its left."""
        return [(u, v) for (u, v), w in self.at.items() if w == self.n]


def delaunay(p: np.ndarray) -> np.ndarray:
    """(t, 3) places of distinct points, each triangle turning left."""
    return Mesh([tuple(map(float, q)) for q in p]).triangles()


# Tiles.
def _reach(pts: np.ndarray, tri: np.ndarray) -> np.ndarray:
    """Boxes of the circumcircles, a little wider than they are; endless for those that are too flat to be sure."""
    a, b, c = (pts[tri[:, k]] for k in range(3))
    b, c = b - a, c - a
    area = b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0]
    b2, c2 = (b**2).sum(1), (c**2).sum(1)
    with np.errstate(all="ignore"):
        ux, uy = (c[:, 1] * b2 - b[:, 1] * c2) / (2 * area), (b[:, 0] * c2 - c[:, 0] * b2) / (2 * area)
        radius = np.hypot(ux, uy) * (1 + 1e-6)
    radius = np.where(np.abs(area) > 1e-7 * np.maximum(b2, c2), radius, np.inf)
    ux, uy = np.where(np.isfinite(radius), ux, 0.0), np.where(np.isfinite(radius), uy, 0.0)
    return np.column_stack([a[:, 0] + ux - radius, a[:, 1] + uy - radius, a[:, 0] + ux + radius, a[:, 1] + uy + radius])


def _beyond(a, b, box: tuple) -> tuple | None:
    """The box of what lies on the left of a, b within ``box``; None for nothing."""
    x0, y0, x1, y1 = box
    ring, out = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)], []
    value = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for x, y in ring]
    for k in range(4):
        (p, q), (s, t) = (ring[k], ring[(k + 1) % 4]), (value[k], value[(k + 1) % 4])
        if s > 0:
            out.append(p)
        if (s > 0) != (t > 0):
            f = s / (s - t)
            out.append((p[0] + f * (q[0] - p[0]), p[1] + f * (q[1] - p[1])))
    if not out:
        return None
    xs, ys = zip(*out, strict=True)
    return min(xs), min(ys), max(xs), max(ys)


def _filled(corner, b, c, sectors: list) -> bool:
    """Whether the sector from b to c about a corner meets one of those that final triangles fill."""
    inside = lambda u, w, p: turn(corner, u, p) > 0 and turn(corner, p, w) > 0
    ray = lambda p, q: turn(corner, p, q) == 0 and (p[0] - corner[0]) * (q[0] - corner[0]) + (p[1] - corner[1]) * (q[1] - corner[1]) > 0
    for ux, uy, wx, wy in sectors:
        u, w = (ux, uy), (wx, wy)
        if inside(u, w, b) or inside(u, w, c) or inside(b, c, u) or inside(b, c, w) or (ray(b, u) and ray(c, w)):
            return True
    return False


POINT = ("id", "x", "y", "z", "px", "py")


def _tile(pts: list[tuple[float, float]], cells: np.ndarray, own: np.ndarray, sectors: list[list], box: tuple, size: float, last: bool):
    """Final triangles and edges of a tile's own points, which of the points are done, and the sectors of the others."""
    mesh, n = Mesh(pts), len(pts)
    if mesh.flat:
        edges = []
        if last:
            line = sorted(range(n), key=pts.__getitem__)
            edges = list(zip(line, line[1:], strict=False))
        return [], edges, np.full(n, last), sectors
    p, tri = np.array(pts), mesh.triangles()
    # What the tiles of the corners know: three by three of them, as far as the box of all points goes.
    margin = 1e-9 * max(box[2] - box[0], box[3] - box[1], 1e-300)
    lo = np.array(box[:2]) + (cells - 1) * size + margin
    hi = lo + 3 * size - 2 * margin
    lo[lo < np.array(box[:2]) + size / 2], hi[hi > np.array(box[2:])] = -np.inf, np.inf

    def known(reach: np.ndarray, corners: np.ndarray) -> np.ndarray:
        low, high = np.maximum(reach[:, :2], box[:2]), np.minimum(reach[:, 2:], box[2:])
        return np.all([(low >= lo[corners[:, k]]).all(1) & (high <= hi[corners[:, k]]).all(1) for k in range(corners.shape[1])], axis=0)

    sure = np.ones(len(tri), bool) if last else known(_reach(p, tri), tri)
    done = own.copy()
    done[tri[~sure].ravel()] = False
    for u, v in mesh.hull():
        there = _beyond(pts[u], pts[v], box)
        if not (last or there is None or known(np.array([there]), np.array([[u, v]]))[0]):
            done[[u, v]] = False
    found = []
    for t in tri[sure].tolist():
        for k in range(3):
            a, b, c = t[k], t[k - 2], t[k - 1]
            if sectors[a] and _filled(pts[a], pts[b], pts[c], sectors[a]):
                break
        else:
            found.append(t)
    more = [list(s) for s in sectors]
    for t in found:
        for k in range(3):
            a, b, c = t[k], t[k - 2], t[k - 1]
            if own[a] and not done[a]:
                more[a].append([*pts[b], *pts[c]])
    mine = []
    for t in found:
        least = min(t, key=pts.__getitem__)
        if own[least]:
            mine.append(t)
    return mine, [], done, more


def triangles(points: DataFrame, key: str, fid: str, x: str = "lon", y: str = "lat", z: str | None = None) -> DataFrame:
    """Landed Delaunay triangles of each key's points, in the plane of their own box.

    Columns: the key, kind (0 for triangles, 2 for the edges of points that all lie on one line),
    and id, x, y, z, px, py of three corners (a, b, c; two for an edge). Of equal
    positions the one with the smallest id counts. Rows with a null position
    play no part; an empty table gives an empty result.
    """
    ship()
    value = F.col(z).cast("double") if z else F.lit(None).cast("double")
    rows = points.select(F.col(key).alias("key"), F.struct(F.col(fid).alias("id"), value.alias("z")).alias("p"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x is not null and y is not null")
    rows = rows.groupBy("key", "x", "y").agg(F.min("p").alias("p")).select("key", "x", "y", "p.id", "p.z")
    mid = rows.groupBy("key").agg(((F.min("x") + F.max("x")) / 2).alias("lon0"), ((F.min("y") + F.max("y")) / 2).alias("lat0"))
    same = F.col("key").eqNullSafe(F.col("key2"))
    east, north = crs.tmerc_forward(F.col("x"), F.col("y"), F.col("lon0"))
    _, south = crs.tmerc_forward(F.col("lon0"), F.col("lat0"), F.col("lon0"))
    flat = rows.join(mid.withColumn("south", south).withColumnRenamed("key", "key2"), same).select("key", "id", "x", "y", "z", east.alias("px"), (north - F.col("south")).alias("py"))
    flat = land(flat)
    boxes = flat.groupBy("key").agg(F.min("px").alias("x0"), F.min("py").alias("y0"), F.max("px").alias("x1"), F.max("py").alias("y1"), F.count(F.lit(1)).alias("n"))
    boxes = boxes.withColumn("side", F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1e-6)) * (1 + 1e-9))
    boxes = land(boxes.drop("n").withColumn("level", F.lit(DEEPEST + 2)))
    active = flat.withColumn("sectors", F.array().cast("array<array<double>>"))
    out = None
    while True:
        boxes = land(_levels(active, boxes))
        found = land(_round(active, boxes))
        own = found.filter("kind != 1").drop("sectors")
        out = own if out is None else out.unionByName(own)
        active = found.filter("kind = 1").select("key", *(F.col(f"a_{c}").alias(c) for c in POINT), "sectors")
        if not active.limit(1).count():
            return out.withColumnRenamed("key", key)


def _levels(active: DataFrame, boxes: DataFrame) -> DataFrame:
    """The boxes with the coarsest level, two above the last or more, whose tiles aren't crowded; a key with few points left ends in one tile."""
    left = active.groupBy(F.col("key").alias("key2")).agg(F.count(F.lit(1)).alias("left"))
    even = F.ceil(F.log2(F.greatest(F.col("left") / TILE, F.lit(1.0))) / 2).cast("int")
    now = boxes.join(left, F.col("key").eqNullSafe(F.col("key2"))).withColumn("finest", F.greatest(F.col("level") - 2, F.lit(0))).drop("key2")
    now = land(now.withColumn("level", F.when(F.col("left") <= REST, 0).otherwise(F.least(even, F.col("finest")))))
    crowd = _celled(active, now).filter((F.col("left") > REST) & (F.col("level") < F.col("finest"))).groupBy("key", "ci", "cj").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > TILE)
    crowd = land(crowd.select(F.col("key").alias("k"), F.col("ci").alias("i"), F.col("cj").alias("j")))
    if not crowd.limit(1).count():
        return now.drop("left", "finest")
    # Points of crowded tiles are counted at all finer levels at once.
    rows = _celled(active, now)
    rows = rows.join(crowd, rows["key"].eqNullSafe(crowd["k"]) & (rows["ci"] == crowd["i"]) & (rows["cj"] == crowd["j"]), "left_semi")
    rows = rows.withColumn("l", F.explode(F.sequence(F.least(F.col("level") + 2, F.col("finest")), F.col("finest"), F.lit(1))))
    size = F.col("side") / F.pow(F.lit(2.0), F.col("l"))
    most = rows.groupBy("key", "l", "finest", F.floor((F.col("px") - F.col("x0")) / size).alias("i"), F.floor((F.col("py") - F.col("y0")) / size).alias("j")).agg(F.count(F.lit(1)).alias("m")).groupBy("key", "l", "finest").agg(F.max("m").alias("m"))
    fit = most.filter((F.col("m") <= TILE) | (F.col("l") >= F.col("finest"))).groupBy(F.col("key").alias("key2")).agg(F.min("l").alias("fit"))
    return now.join(fit, F.col("key").eqNullSafe(F.col("key2")), "left").withColumn("level", F.coalesce("fit", "level")).drop("key2", "fit", "left", "finest")


def _celled(rows: DataFrame, boxes: DataFrame) -> DataFrame:
    own = rows.join(boxes.withColumnRenamed("key", "key2"), F.col("key").eqNullSafe(F.col("key2"))).withColumn("size", F.col("side") / F.pow(F.lit(2.0), F.col("level")))
    return own.withColumns({"ci": F.floor((F.col("px") - F.col("x0")) / F.col("size")).cast("long"), "cj": F.floor((F.col("py") - F.col("y0")) / F.col("size")).cast("long")})


def _round(active: DataFrame, boxes: DataFrame) -> DataFrame:
    """One round: kind 0 (triangles), 1 (points that aren't done) or 2 (edges)."""
    step = F.array(*map(F.lit, (-1, 0, 1)))
    rows = _celled(active, boxes).withColumn("di", F.explode(F.when(F.col("level") == 0, F.array(F.lit(0))).otherwise(step))).withColumn("dj", F.explode(F.when(F.col("level") == 0, F.array(F.lit(0))).otherwise(step)))
    rows = rows.select("key", (F.col("ci") + F.col("di")).alias("bi"), (F.col("cj") + F.col("dj")).alias("bj"), "ci", "cj", *POINT, "sectors", "x0", "y0", "x1", "y1", "size", "level")
    # Neighbours without points of their own have nothing to do.
    homes = rows.filter("bi = ci and bj = cj").select(F.col("key").alias("key2"), F.col("bi").alias("hi"), F.col("bj").alias("hj")).distinct()
    rows = rows.join(homes, rows["key"].eqNullSafe(homes["key2"]) & (rows["bi"] == homes["hi"]) & (rows["bj"] == homes["hj"]), "left_semi")
    kinds = {c: dict(active.dtypes)[c] for c in ("key", *POINT)}
    corners = [(f"{p}_{c}", kinds[c]) for p in "abc" for c in POINT]
    ddl = f"key {kinds['key']}, kind int, {', '.join(f'{n} {k}' for n, k in corners)}, sectors array<array<double>>"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(ddl))

    def run(t: pa.Table) -> pa.Table:
        col = {c: t.column(c).to_pylist() for c in ("ci", "cj", "bi", "bj", "sectors", *POINT)}
        one = {c: t.column(c)[0].as_py() for c in ("key", "x0", "y0", "x1", "y1", "size", "level")}
        pts = list(zip(col["px"], col["py"], strict=True))
        cells = np.array([col["ci"], col["cj"]], float).T
        own = np.array([a == b and c == d for a, b, c, d in zip(col["ci"], col["bi"], col["cj"], col["bj"], strict=True)])
        tris, edges, done, more = _tile(pts, cells, own, col["sectors"], (one["x0"], one["y0"], one["x1"], one["y1"]), one["size"], one["level"] == 0)
        point = lambda i: tuple(col[c][i] for c in POINT)
        none = (None,) * len(POINT)
        rows = [(one["key"], 0, *point(a), *point(b), *point(c), None) for a, b, c in tris]
        rows += [(one["key"], 2, *point(a), *point(b), *none, None) for a, b in edges]
        rows += [(one["key"], 1, *point(i), *none, *none, more[i]) for i in np.flatnonzero(own & ~done).tolist()]
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

    return rows.groupBy("key", "bi", "bj").applyInArrow(run, ddl)


def tin(points: DataFrame, key: str, fid: str, x: str = "lon", y: str = "lat", z: str = "z") -> DataFrame:
    """Triangles of each key's points as polygons, with their corners' values a, b, c."""
    t = triangles(points, key, fid, x, y, z).filter("kind = 0")
    ring = T.ring([(F.col(f"{p}_x"), F.col(f"{p}_y")) for p in "abca"])
    return t.select(key, T.geometry("Polygon", F.array(F.array(ring))).alias("geom"), *(F.col(f"{p}_z").alias(p) for p in "abc"))


def neighbours(points: DataFrame, key: str, fid: str, x: str = "lon", y: str = "lat") -> DataFrame:
    """The pairs of points that share a Delaunay edge, each both ways: the key, id, x, y and id2, x2, y2."""
    end = lambda p, q: F.struct(*(F.col(f"{p}_{c}").alias(c) for c in ("id", "x", "y")), *(F.col(f"{q}_{c}").alias(f"{c}2") for c in ("id", "x", "y")))
    both = F.array(end("a", "b"), end("b", "a"))
    three = F.concat(both, F.array(end("b", "c"), end("c", "b"), end("c", "a"), end("a", "c")))
    t = triangles(points, key, fid, x, y)
    return t.select(F.col(key), F.explode(F.when(F.col("kind") == 0, three).otherwise(both)).alias("e")).select(key, "e.*").distinct()


def voronoi(points: DataFrame, key: str, fid: str, x: str = "lon", y: str = "lat") -> DataFrame:
    """The cell of each site, cut from its key's box by the bisectors with its Delaunay neighbours; of equal sites the first has it.

    The box is the sites' own, wider by a tenth on each side or as far as a plane reaches.
    """
    from tellurion.operators import geodetic as g
    from tellurion.operators import planar as pl

    rows = points.select(F.col(key).alias("key"), F.col(fid).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x is not null and y is not null")
    sites = rows.groupBy("key", "x", "y").agg(F.min("id").alias("id"))
    near = neighbours(rows, "key", "id", "x", "y").groupBy(F.col("key").alias("key2"), F.col("id").alias("site")).agg(F.collect_list(F.struct("x2", "y2")).alias("near"))
    boxes = rows.groupBy(F.col("key").alias("key3")).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    own = sites.join(near, F.col("key").eqNullSafe(F.col("key2")) & (F.col("id") == F.col("site")), "left").join(boxes, F.col("key").eqNullSafe(F.col("key3")))
    own = own.select("key", "id", "x", "y", "near", "x0", "y0", "x1", "y1")
    kinds = dict(own.dtypes)

    def run(batches):
        made: dict = {}
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                box = (r["x0"], r["y0"], r["x1"], r["y1"])
                if box not in made:
                    made.clear()
                    made[box] = g.voronoi_frame(*box)
                f, cell = made[box]
                near = [] if r["near"] is None else [(q["x2"], q["y2"]) for q in r["near"]]
                at = f.to(np.array([(r["x"], r["y"]), *near], float))
                for q in at[1:][np.argsort(((at[1:] - at[0]) ** 2).sum(1), kind="stable")]:
                    if len(cell):
                        cell = pl.clip_half(cell, (cell - (q + at[0]) / 2) @ (q - at[0]))
                ring = f.back(pl.closed(cell)) if len(cell) > 2 else None
                geom = {"kind": "Polygon", "parts": [] if ring is None else [[[{"x": float(a), "y": float(b)} for a, b in ring]]]}
                out.append((r["key"], r["id"], geom))
            yield pd.DataFrame(out, columns=["key", "id", "geom"])

    ship()
    return own.mapInPandas(run, f"key {kinds['key']}, id {kinds['id']}, geom {T.GEOMETRY}").toDF(key, fid, "geom")


def rim(points: DataFrame, key: str, fid: str, max_edge: float, x: str = "lon", y: str = "lat") -> DataFrame:
    """The edges around the triangles whose sides are all within ``max_edge`` metres: key, a, b (ids), ax, ay, bx, by, the inside on the left."""
    side = lambda p, q: F.hypot(F.col(f"{p}_px") - F.col(f"{q}_px"), F.col(f"{p}_py") - F.col(f"{q}_py"))
    t = triangles(points, key, fid, x, y).filter("kind = 0").filter(F.greatest(side("a", "b"), side("b", "c"), side("c", "a")) <= max_edge)
    edge = lambda p, q: F.struct(F.col(f"{p}_id").alias("a"), F.col(f"{q}_id").alias("b"), F.col(f"{p}_x").alias("ax"), F.col(f"{p}_y").alias("ay"), F.col(f"{q}_x").alias("bx"), F.col(f"{q}_y").alias("by"))
    e = t.select(F.col(key), F.explode(F.array(edge("a", "b"), edge("b", "c"), edge("c", "a"))).alias("e"))
    once = e.groupBy(key, F.least("e.a", "e.b").alias("lo"), F.greatest("e.a", "e.b").alias("hi")).agg(F.count(F.lit(1)).alias("n"), F.min("e").alias("e"))
    return once.filter("n = 1").select(key, "e.*")


def concave_hull(points: DataFrame, key: str, fid: str, max_edge: float, x: str = "lon", y: str = "lat") -> DataFrame:
    """The area of the triangles whose sides are all within ``max_edge`` metres, for each key that has any.

    Only the rim's edges come together, which are the positions of the result.
    """
    from tellurion.operators import planar as pl

    edges = rim(points, key, fid, max_edge, x, y)
    kind = dict(edges.dtypes)[key]

    def run(k, pdf):
        parts = pl.assembled(pl.walk(pdf[["ax", "ay", "bx", "by"]].to_numpy()), 0.0)
        geom = {"kind": "Polygon" if len(parts) == 1 else "MultiPolygon", "parts": [[[{"x": float(a), "y": float(b)} for a, b in r] for r in part] for part in parts]}
        return pd.DataFrame({key: [k[0]], "geom": [geom]})

    ship()
    return edges.groupBy(key).applyInPandas(run, f"`{key}` {kind}, geom {T.GEOMETRY}")
