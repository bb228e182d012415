"""Columns over whole geometries that need a kernel: one Arrow batch of rows at a time.

Geometries stay Arrow arrays on the way: a batch's positions are one flat array
with offsets for rings, parts and rows. What has a closed form for each position or
edge is computed over the whole batch at once; the rest over one row's rings.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegerType, StringType, StructField, StructType

from tellurion.functions import geodesic as geo
from tellurion.functions.crs import convert
from tellurion.functions.measure import centroid
from tellurion.operators import geodetic as g
from tellurion.operators import planar as pl
from tellurion.session import ship

POSITION = StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])
GEOMETRY = StructType([StructField("kind", StringType()), StructField("parts", ArrayType(ArrayType(ArrayType(POSITION))))])
ISSUE = StructType([StructField("code", StringType()), StructField("severity", StringType()), StructField("part", IntegerType()), StructField("ring", IntegerType())])
REPAIR = StructType([StructField("geom", GEOMETRY), StructField("fixes", ArrayType(StringType()))])

XY = pa.struct([("x", pa.float64()), ("y", pa.float64())])
ARROW = pa.struct([("kind", pa.string()), ("parts", pa.list_(pa.list_(pa.list_(XY))))])


class Batch:
    """A batch's geometries: kinds, flat positions, and offsets of rows, parts and rings; null rows are empty."""

    def __init__(self, kinds: list, rows: np.ndarray, parts: np.ndarray, rings: np.ndarray, xy: np.ndarray):
        self.kinds, self.rows, self.parts, self.rings, self.xy = kinds, rows, parts, rings, xy

    @classmethod
    def of(cls, arr: pa.Array) -> Batch:
        parts = arr.field("parts")
        there = np.asarray(arr.is_valid()) & np.asarray(parts.is_valid())
        kinds = [k if ok else None for k, ok in zip(arr.field("kind").to_pylist(), there, strict=True)]
        # Offsets from where this batch begins in its buffers.
        rows, rings = _offsets(parts), parts.values.slice(parts.offsets[0].as_py())
        inner, points = _offsets(rings), rings.values.slice(rings.offsets[0].as_py() if len(rings) else 0)
        last, flat = _offsets(points), points.values.slice(points.offsets[0].as_py() if len(points) else 0)
        n = int(last[-1]) if len(last) else 0
        flat = flat.slice(0, n)
        xy = np.stack([np.asarray(flat.field("x"), float), np.asarray(flat.field("y"), float)], axis=1) if n else np.zeros((0, 2))
        return cls(kinds, rows, inner, last, xy)

    def arrow(self) -> pa.Array:
        xy = pa.StructArray.from_arrays([pa.array(self.xy[:, 0]), pa.array(self.xy[:, 1])], fields=list(XY))
        nest = xy
        for offsets in (self.rings, self.parts):
            nest = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), nest)
        none = pa.array([k is None for k in self.kinds], pa.bool_())
        parts = pa.ListArray.from_arrays(pa.array(self.rows, pa.int32()), nest, mask=none)
        return pa.StructArray.from_arrays([pa.array(self.kinds, pa.string()), parts], fields=list(ARROW), mask=none)

    def geoms(self) -> list:
        out = []
        for i, kind in enumerate(self.kinds):
            out.append(None if kind is None else (kind, [[self.xy[self.rings[r] : self.rings[r + 1]] for r in range(self.parts[p], self.parts[p + 1])] for p in range(self.rows[i], self.rows[i + 1])]))
        return out

    @classmethod
    def from_geoms(cls, geoms: list) -> Batch:
        rings = [[[np.asarray(r, float).reshape(-1, 2) for r in part] for part in v[1]] if v else [] for v in geoms]
        flat = [r for v in rings for part in v for r in part]
        ends = lambda sizes: np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)
        return cls([v[0] if v else None for v in geoms], ends([len(v) for v in rings]), ends([len(part) for v in rings for part in v]), ends([len(r) for r in flat]), np.concatenate(flat) if flat else np.zeros((0, 2)))

    @classmethod
    def of_rings(cls, kind: str, xy: np.ndarray, there: np.ndarray) -> Batch:
        """One ring of equal size for each row (rows x positions x 2); rows that aren't there are null."""
        n, m = xy.shape[:2]
        ends = np.concatenate([[0], np.cumsum(there)])
        k = int(ends[-1])
        return cls([kind if ok else None for ok in there], ends, np.arange(k + 1), m * np.arange(k + 1), xy[there].reshape(-1, 2))

    def row_of(self) -> np.ndarray:
        """The row of each position."""
        ring_row = np.repeat(np.arange(len(self.kinds)), np.diff(self.parts[self.rows])) if len(self.kinds) else np.zeros(0, int)
        return np.repeat(ring_row, np.diff(self.rings))

    def edges(self) -> np.ndarray:
        """Places of the positions that another of the same ring follows."""
        inner = np.ones(len(self.xy), bool)
        ends = self.rings[1:][np.diff(self.rings) > 0]
        inner[ends - 1] = False
        return np.flatnonzero(inner)

    def sums(self, at: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values at positions summed by ring, and each ring's part."""
        ring = np.repeat(np.arange(len(self.rings) - 1), np.diff(self.rings))[at]
        return np.bincount(ring, v, len(self.rings) - 1), np.repeat(np.arange(len(self.parts) - 1), np.diff(self.parts))


def _offsets(arr: pa.ListArray) -> np.ndarray:
    """Offsets from 0; nulls are as long as nothing."""
    if not len(arr):
        return np.zeros(1, np.int64)
    o = np.asarray(arr.offsets, np.int64)
    return o - o[0]


def line(positions: np.ndarray) -> tuple:
    return "LineString", [[positions]]


def lines(rows: list[np.ndarray]) -> tuple:
    return "MultiLineString", [[r] for r in rows]


def _column(run: Callable, result: DataType, geoms: int, n_args: tuple) -> Column:
    ship()
    cols = [a if isinstance(a, Column) else F.col(a) if isinstance(a, str) else F.lit(a) for a in n_args]
    return F.arrow_udf(run, result, ArrowUDFType.SCALAR)(*cols)


def kernel(f: Callable, result: DataType = GEOMETRY, geoms: int = 1) -> Callable[..., Column]:
    """A column function whose first ``geoms`` arguments are geometries; null in, null out."""
    inner = list(result.fields) if isinstance(result, StructType) else []

    def run(*cols):
        own = [Batch.of(c).geoms() for c in cols[:geoms]]
        rest = [c.to_pylist() for c in cols[geoms:]]
        out = [None if any(v is None for v in row) else f(*row) for row in zip(*own, *rest, strict=True)]
        if result is GEOMETRY:
            return Batch.from_geoms(out).arrow()
        if result is REPAIR:
            geom = Batch.from_geoms([v[0] if v else None for v in out]).arrow()
            fixes = pa.array([v[1] if v else None for v in out], pa.list_(pa.string()))
            return pa.StructArray.from_arrays([geom, fixes], names=["geom", "fixes"], mask=pa.array([v is None for v in out], pa.bool_()))
        if inner:
            return pa.array([None if v is None else dict(zip(result.fieldNames(), v, strict=True)) for v in out], _arrow(result))
        return pa.array(out, _arrow(result))

    return lambda *args: _column(run, result, geoms, args)


def _arrow(kind: DataType) -> pa.DataType:
    if isinstance(kind, StructType):
        return pa.struct([(x.name, _arrow(x.dataType)) for x in kind.fields])
    if isinstance(kind, ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return {DoubleType(): pa.float64(), IntegerType(): pa.int32(), BooleanType(): pa.bool_(), StringType(): pa.string()}[kind]


def _numbers(cols) -> list[np.ndarray]:
    """Columns of numbers as arrays, nulls as NaN."""
    return [np.asarray(c.cast(pa.float64()).to_numpy(zero_copy_only=False), float) for c in cols]


def moved(f: Callable) -> Callable[..., Column]:
    """A column function that maps positions: ``f(x, y, *numbers)`` over all of a batch's."""

    def run(*cols):
        b, rest = Batch.of(cols[0]), _numbers(cols[1:])
        row = b.row_of()
        b.xy = np.stack(f(b.xy[:, 0], b.xy[:, 1], *(v[row] for v in rest))[:2], axis=1)
        bad = np.isnan(np.stack(rest)).any(axis=0) if rest else np.zeros(len(b.kinds), bool)
        if bad.any():
            return Batch.from_geoms([None if x else v for v, x in zip(b.geoms(), bad, strict=True)]).arrow()
        return b.arrow()

    return lambda *args: _column(run, GEOMETRY, 1, args)


def shaped(kind: str, f: Callable) -> Callable[..., Column]:
    """A column function of numbers that gives one ring for each row: ``f`` gives rows x positions of x and of y."""

    def run(*cols):
        v = _numbers(cols)
        there = ~np.isnan(np.stack(v)).any(axis=0)
        x, y = f(*(np.where(there, c, 1.0)[:, None] for c in v))
        return Batch.of_rings(kind, np.stack([x, y], axis=-1), there).arrow()

    return lambda *args: _column(run, GEOMETRY, 0, args)


def measured(f: Callable) -> Callable[..., Column]:
    """A column function from a batch of geometries to a number for each row; null for null."""

    def run(col):
        b = Batch.of(col)
        return pa.array(f(b), pa.float64(), mask=np.array([k is None for k in b.kinds], bool))

    return lambda *args: _column(run, DoubleType(), 1, args)


def line(positions: np.ndarray) -> tuple:
    return "LineString", [[positions]]


def lines(rows: list[np.ndarray]) -> tuple:
    return "MultiLineString", [[r] for r in rows]


def _ring(geom) -> np.ndarray:
    return g.rings(geom)[0]


def buffer(geom, radius, steps: int = 16, edges: str = "planar", method: str = "geodesic", tolerance: float = 0.01, crs: str = "WGS84") -> Column:
    """All within ``radius`` metres of each geometry; see the kernel for the options. A batch's points are solved at once."""
    turn = -360.0 * np.arange(4 * steps + 1) / (4 * steps)

    def run(col, metres):
        b, (r,) = Batch.of(col), _numbers([metres])
        if crs != "WGS84":
            b.xy = np.stack(convert(b.xy[:, 0], b.xy[:, 1], crs, "WGS84"), axis=1).reshape(-1, 2)
        point = np.array([k == "Point" for k in b.kinds], bool) & (r > 0) & (np.diff(b.rows) == 1)
        out: list = [None] * len(b.kinds)
        if point.any():
            at = b.xy[b.rings[b.parts[b.rows[:-1][point]]]]
            x, y, _ = geo.direct(at[:, :1], at[:, 1:], turn, r[point][:, None])
            for i, ring in zip(np.flatnonzero(point), np.stack([x, y], axis=-1), strict=True):
                out[i] = ("Polygon", [[ring]])
        for i, v in enumerate(b.geoms()):
            if v is not None and not point[i] and not np.isnan(r[i]):
                out[i] = g.buffer(v, float(r[i]), steps, edges, method, tolerance)
        done = Batch.from_geoms(out)
        if crs != "WGS84":
            done.xy = np.stack(convert(done.xy[:, 0], done.xy[:, 1], "WGS84", crs), axis=1).reshape(-1, 2)
        return done.arrow()

    return _column(run, GEOMETRY, 1, (geom, radius))


# Geometry from geometry.
simplify = kernel(lambda a, tol: g.simplified(a, tol))
simplify_topology = kernel(lambda a, tol: g.simplified(a, tol, True))
convex = kernel(g.convex)
concave = kernel(g.concave)
polygon_smooth = kernel(lambda a, n: g.smoothed(a, int(n)))
#: With sharpness and steps, if wanted.
bezier_spline = kernel(lambda a, sharpness=0.85, steps=16: g.bezier_spline(a, sharpness, int(steps)))
translate = moved(lambda x, y, d, b: geo.direct(x, y, b, d))


def _turned(x, y, angle, px, py):
    s, az, _ = geo.inverse(px, py, x, y)
    return geo.direct(px, py, az + angle, s)


def _stretched(x, y, factor, px, py):
    s, az, _ = geo.inverse(px, py, x, y)
    return geo.direct(px, py, az, s * factor)


_rotate, _scale = moved(_turned), moved(_stretched)


def _pivot(geom, pivot) -> tuple:
    """The pivot's coordinates; the geometry's mean position unless one is given."""
    p = centroid(F.col(geom) if isinstance(geom, str) else geom) if pivot is None else None
    return (p["x"], p["y"]) if pivot is None else pivot


def rotate(geom, angle, pivot=None) -> Column:
    """Turned clockwise about ``pivot``, a pair of numbers or columns."""
    return _rotate(geom, angle, *_pivot(geom, pivot))


def scale(geom, factor, origin=None) -> Column:
    """Stretched along geodesics from ``origin``, a pair of numbers or columns."""
    return _scale(geom, factor, *_pivot(geom, origin))


polygon_tangents = kernel(lambda a, x, y: ("MultiPoint", [[p[None]] for p in g.polygon_tangents(a, (x, y))]))
clean_coords = kernel(lambda a, tol: g.clean_coords(a, tol))
line_slice_along = kernel(lambda a, lo, hi: line(g.line_slice_along(_ring(a), lo, hi)))
line_chunk = kernel(lambda a, n: lines(g.line_chunk(_ring(a), n)))


def line_chunk_positions(rows: DataFrame, key: str, length: float, geom: str = "geom") -> DataFrame:
    """key, i, x, y of the positions of ``line_chunk``'s pieces, numbered along each line; pieces leave a task a few lines at a time."""
    ship()

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNKED):
                some = batch.slice(lo, CHUNKED)
                own = [None if v is None else np.concatenate(g.line_chunk(_ring(v), length)) for v in Batch.of(some.column(1)).geoms()]
                count = np.array([0 if v is None else len(v) for v in own])
                if count.any():
                    xy = np.concatenate([v for v in own if v is not None])
                    i = np.concatenate([np.arange(n) for n in count]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(np.repeat(np.arange(len(own)), count))), pa.array(i), pa.array(xy[:, 0]), pa.array(xy[:, 1])], names=[key, "i", "x", "y"])

    schema = StructType([rows.schema[key], StructField("i", IntegerType()), StructField("x", DoubleType()), StructField("y", DoubleType())])
    return rows.select(key, geom).mapInArrow(run, schema)


#: Lines whose pieces are held at once.
CHUNKED = 32
#: A distance and, if wanted, the steps of an arc.
line_offset = kernel(lambda a, d, steps=32: line(g.line_offset(_ring(a), d, int(steps))))
bbox_clip = kernel(lambda a, x0, y0, x1, y1: g.bbox_clip(a, (x0, y0, x1, y1)))
tesselate = kernel(lambda a: ("MultiPolygon", [[t] for p in a[1] for t in pl.tesselate(p)]))
kinks = kernel(lambda a: ("MultiPoint", [[p[None]] for p in pl.kinks(a[1])]))
unkink = kernel(lambda a: ("MultiPolygon", [q[1][0] for q in g.unkinked(a)]))

# Geometry from two.
intersect = kernel(g.intersect, geoms=2)
difference = kernel(g.difference, geoms=2)
union = kernel(g.union, geoms=2)
xor = kernel(g.xor, geoms=2)
mask = kernel(g.mask, geoms=2)
line_split = kernel(lambda a, b: lines(pl.line_split(_ring(a), g.rings(b))), geoms=2)
#: With a tolerance in metres, if wanted.
line_overlap = kernel(lambda a, b, tol=1e-6: lines(g.line_overlap(_ring(a), _ring(b), max(tol, 1e-6))), geoms=2)

# Shapes about a point: x, y and their measures, over whole batches.
STEPS = 64


def _circle(steps, x, y, r):
    return geo.direct(x, y, -360.0 * np.arange(steps + 1) / steps, r)[:2]


def _arc(steps, x, y, r, a, b):
    sweep = (b - a) % 360
    return geo.direct(x, y, a + np.where(sweep == 0, 360.0, sweep) * np.arange(steps + 1) / steps, r)[:2]


def _ellipse(steps, x, y, a, b, turn):
    t = 2 * np.pi * np.arange(steps + 1) / steps
    east, north = a * np.cos(t), b * np.sin(t)
    return geo.direct(x, y, np.degrees(np.arctan2(east, north)) + turn, np.hypot(east, north))[:2]


def _great_circle(steps, x, y, x2, y2):
    s, az, _ = geo.inverse(x, y, x2, y2)
    return geo.direct(x, y, az, s * np.arange(steps) / (steps - 1))[:2]


def stepped(kind: str, f: Callable, least: int, usual: int = STEPS) -> Callable[..., Column]:
    """A shape with a number of steps, which is a plain number and not a column."""

    def made(*args, steps: int = usual) -> Column:
        if steps < least:
            raise ValueError(f"at least {least} steps are needed")
        return shaped(kind, partial(f, steps))(*args)

    return made


circle = stepped("Polygon", _circle, 3)
line_arc = stepped("LineString", _arc, 1)
ellipse = stepped("Polygon", _ellipse, 8)
great_circle = stepped("LineString", _great_circle, 2, 100)
#: x, y, radius, two bearings and, if wanted, steps.
sector = kernel(lambda x, y, r, a, b, n=STEPS: g.sector((x, y), r, a, b, int(n)), geoms=0)

# Positions, numbers and tests.
along = kernel(lambda a, d: tuple(g.along(_ring(a), d).tolist()), POSITION)
center_of_mass = kernel(lambda a: tuple(g.center_of_mass(a).tolist()), POSITION)
point_on_feature = kernel(lambda a: tuple(g.point_on_feature(a).tolist()), POSITION)
NEAREST = StructType([StructField("x", DoubleType()), StructField("y", DoubleType()), StructField("dist", DoubleType()), StructField("location", DoubleType()), StructField("index", IntegerType())])


def _nearest(b: Batch, x: np.ndarray, y: np.ndarray, places: bool = False) -> np.ndarray:
    """For each row its place nearest to a point: x, y, distance, metres along and segment; NaN where there is none.

    Every segment of a batch is solved at once. Of segments as near as each other, such as two that share an end, the first counts.
    """
    at = b.edges()
    row = b.row_of()[at]
    p, q = b.xy[at], b.xy[at + 1]
    fx, fy, d, t = geo.feet(*p.T, *q.T, x[row], y[row])
    out = np.full((len(b.kinds), 5), np.nan)
    d = np.where(np.isnan(d), np.inf, d)
    least = np.full(len(b.kinds), np.inf)
    np.minimum.at(least, row, d)
    near = np.flatnonzero(np.isfinite(d) & (d <= least[row] + 1e-9))
    own, first = np.unique(row[near], return_index=True)
    best = near[first]
    start = np.searchsorted(row, own)
    out[own] = np.stack([fx[best], fy[best], d[best], t[best], best - start], axis=1)
    if places and len(own):
        total = np.concatenate([[0.0], np.cumsum(geo.inverse(*p.T, *q.T)[0])])
        out[own, 3] += total[best] - total[start]
    return out


def _nearest_column(result: DataType, f: Callable, places: bool = False) -> Callable[..., Column]:
    """``f(batch, nearest places, other numbers)`` over a geometry and a point's x and y."""

    def run(*cols):
        b, (x, y, *rest) = Batch.of(cols[0]), _numbers(cols[1:])
        return f(b, _nearest(b, x, y, places), x, y, *rest)

    return lambda *args: _column(run, result, 1, args)


def _place(b: Batch, found: np.ndarray, *_) -> pa.Array:
    none = np.isnan(found[:, 2])
    cols = [pa.array(found[:, k], pa.float64(), mask=none) for k in range(4)]
    return pa.StructArray.from_arrays([*cols, pa.array(np.where(none, 0, found[:, 4]).astype(np.int32), mask=none)], names=NEAREST.fieldNames(), mask=pa.array(none))


def _signed(b: Batch, found: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.Array:
    inside = np.array([v is not None and np.isfinite(d) and g.inside(v, (px, py)) for v, d, px, py in zip(b.geoms(), found[:, 2], x, y, strict=True)], bool)
    return pa.array(np.where(inside, -found[:, 2], found[:, 2]), pa.float64(), mask=np.isnan(found[:, 2]))


nearest_point_on_line = _nearest_column(NEAREST, _place, True)
point_to_line_distance = _nearest_column(DoubleType(), lambda b, found, x, y: pa.array(found[:, 2], pa.float64(), mask=np.isnan(found[:, 2])))
point_to_polygon_distance = _nearest_column(DoubleType(), _signed)
boolean_point_on_line = _nearest_column(BooleanType(), lambda b, found, x, y, tol: pa.array(found[:, 2] <= tol, pa.bool_(), mask=np.isnan(found[:, 2]) | np.isnan(tol)))


def _between(b: Batch, lo: np.ndarray, hi: np.ndarray) -> Batch:
    """Of each line what lies between two places along it, as ``line_between`` has it; lines of as many positions are measured together."""
    ok = np.array([k is not None for k in b.kinds], bool) & ~np.isnan(lo + hi)
    rings = np.diff(b.parts[b.rows]) if len(b.kinds) else np.zeros(0, int)
    first = b.rings[np.minimum(b.parts[b.rows[:-1]], len(b.rings) - 1)] if len(b.kinds) else np.zeros(0, int)
    size = np.where(rings == 1, b.rings[np.minimum(b.parts[b.rows[:-1]] + 1, len(b.rings) - 1)] - first, 0) if len(b.kinds) else rings
    if (ok & ((rings != 1) | (size < 2))).any():
        # Lines of several parts go one by one.
        return Batch.from_geoms([line(g.line_between(_ring(v), float(p), float(q))) if k else None for v, p, q, k in zip(b.geoms(), lo, hi, ok, strict=True)])
    rows, xy = [np.zeros(0, int)], [np.zeros((0, 2))]
    for n in np.unique(size[ok]):
        own = np.flatnonzero(ok & (size == n))
        at = b.xy[first[own, None] + np.arange(n)]
        s, az, _ = geo.inverse(*(at[:, :-1, c].ravel() for c in (0, 1)), *(at[:, 1:, c].ravel() for c in (0, 1)))
        az, total = az.reshape(len(own), n - 1), np.concatenate([np.zeros((len(own), 1)), np.cumsum(s.reshape(len(own), n - 1), axis=1)], axis=1)
        every, ends = np.arange(len(own)), []
        for d in (lo[own], hi[own]):
            off = np.abs(total - d[:, None])
            k = off.argmin(axis=1)
            ends.append(np.where(off[every, k] < 1e-4, total[every, k], d))
        start, stop = np.maximum(0.0, np.minimum(*ends)), np.minimum(np.maximum(*ends), total[:, -1])
        if (start >= stop).any():
            raise ValueError("the slice is empty")
        cut = []
        for d in (start, stop):
            k = np.minimum((total <= d[:, None]).sum(axis=1) - 1, n - 2)
            x, y, _ = geo.direct(at[every, k, 0], at[every, k, 1], az[every, k], d - total[every, k])
            cut.append(np.stack([x, y], axis=1)[:, None])
        inner = (total > start[:, None] + 1e-9) & (total < stop[:, None] - 1e-9)
        keep = np.concatenate([np.ones((len(own), 1), bool), inner, np.ones((len(own), 1), bool)], axis=1)
        rows.append(np.repeat(own, keep.sum(axis=1)))
        xy.append(np.concatenate([cut[0], at, cut[1]], axis=1)[keep])
    row, xy = np.concatenate(rows), np.concatenate(xy)
    count = np.bincount(row, minlength=len(ok))
    ends = np.concatenate([[0], np.cumsum(ok)])
    return Batch(["LineString" if k else None for k in ok], ends, np.arange(ends[-1] + 1), np.concatenate([[0], np.cumsum(count[ok])]), xy[np.argsort(row, kind="stable")])


def line_slice(geom, x1, y1, x2, y2) -> Column:
    """The part of a line between the places nearest to two points."""

    def run(col, *at):
        b, (ax, ay, bx, by) = Batch.of(col), _numbers(at)
        lo, hi = (_nearest(b, x, y, True)[:, 3] for x, y in ((ax, ay), (bx, by)))
        return _between(b, lo, hi).arrow()

    return _column(run, GEOMETRY, 1, (geom, x1, y1, x2, y2))


def _parallel(one, two, tol: float = 0.1) -> pa.Array:
    """Segment by segment the same bearing, or the opposite one, within ``tol`` degrees."""
    a, b = Batch.of(one), Batch.of(two)
    at, bt = a.edges(), b.edges()
    ra, rb = a.row_of()[at], b.row_of()[bt]
    na, nb = np.bincount(ra, minlength=len(a.kinds)), np.bincount(rb, minlength=len(b.kinds))
    same = (na == nb) & (na > 0)
    at, bt = at[same[ra]], bt[same[rb]]
    za, zb = (geo.inverse(*v.xy[k].T, *v.xy[k + 1].T)[1] for v, k in ((a, at), (b, bt)))
    off = np.abs((za - zb + 90) % 180 - 90) > tol
    apart = np.bincount(a.row_of()[at], off, len(a.kinds)) > 0
    return pa.array(same & ~apart, pa.bool_(), mask=np.array([k is None or j is None for k, j in zip(a.kinds, b.kinds, strict=True)], bool))


def boolean_parallel(a, b, tolerance: float = 0.1) -> Column:
    """Whether the segments' bearings agree within ``tolerance`` degrees, whatever their direction."""
    return _column(lambda one, two: _parallel(one, two, tolerance), BooleanType(), 2, (a, b))


relate = kernel(lambda a, b: pl.relate(*a, *b), StringType(), geoms=2)


def _apart(a, b) -> bool:
    """Whether the boxes of two geometries don't meet."""
    p, q = (np.concatenate([*g.rings(v), np.zeros((0, 2))]) for v in (a, b))
    return not len(p) or not len(q) or bool((p.min(0) > q.max(0)).any() or (q.min(0) > p.max(0)).any())


def _intersects(a, b) -> bool:
    if _apart(a, b):
        return False
    m = pl.relate(*a, *b)
    return not m.startswith("FF") or m[3:5] != "FF"


boolean_intersects = kernel(_intersects, BooleanType(), geoms=2)


def _length(b: Batch) -> np.ndarray:
    at = b.edges()
    p, q = b.xy[at], b.xy[at + 1]
    s = geo.inverse(p[:, 0], p[:, 1], q[:, 0], q[:, 1])[0]
    point = np.array([k is not None and "Point" in k for k in b.kinds], bool)
    return np.where(point, 0.0, np.bincount(b.row_of()[at], s, len(b.kinds)))


def _area(b: Batch) -> np.ndarray:
    at = b.edges()
    p, q = b.xy[at], b.xy[at + 1]
    areal = np.array([k is not None and "Polygon" in k for k in b.kinds], bool)
    own = areal[b.row_of()[at]]
    ring, part = b.sums(at[own], geo.strips(*p[own].T, *q[own].T))
    # A part is its first ring's area less those of the others, and never below nothing.
    sign = np.full(len(ring), -1.0)
    sign[b.parts[:-1][np.diff(b.parts) > 0]] = 1.0
    parts = np.maximum(0.0, np.bincount(part, sign * np.abs(ring), len(b.parts) - 1))
    return np.bincount(np.repeat(np.arange(len(b.kinds)), np.diff(b.rows)), parts, len(b.kinds))


geodesic_length = measured(_length)
geodesic_area = measured(_area)
validate = kernel(lambda a: [dict(zip(("code", "severity", "part", "ring"), v, strict=True)) for v in g.validate(a)], ArrayType(ISSUE))
_make_valid = kernel(lambda a, grid, least, tol: g.make_valid(a, grid, least, tol), REPAIR)


def make_valid(geom, snap_grid: float = 0.0, min_area: float = 0.0, clean_tolerance: float = 0.0) -> Column:
    """A repaired geometry and the list of what was done to it; the options are metres and square metres."""
    return _make_valid(geom, float(snap_grid), float(min_area), float(clean_tolerance))




def boolean_valid(geom: Column) -> Column:
    return ~F.exists(validate(geom), lambda i: i["severity"] == "error")


def register(spark: SparkSession) -> None:
    """Names for SQL: the geodesic scalars; other columns are ``F.expr``-free functions of this module."""
    ship()
    spark.udf.register("geo_distance", geo.distance_udf)
    spark.udf.register("geo_inverse", geo.inverse_udf)
    spark.udf.register("geo_destination", geo.direct_udf)
