"""Operators on one geometry, or a few, in longitude and latitude.

Lengths are metres. What is built point by point uses geodesics; what needs a
plane uses a transverse Mercator frame at the middle of the inputs' box. A
geometry is a kind with parts of rings of (n, 2) arrays.
"""

from __future__ import annotations

import heapq
import math

import numpy as np

from tellurion.functions import crs
from tellurion.functions import geodesic as geo
from tellurion.operators import planar as pl

Geom = tuple[str, list]
#: Extents beyond which the plane is no longer fit.
MAX_KM, MAX_DEGREES = 3900.0, 60.0


def rings(g: Geom) -> list[np.ndarray]:
    return [np.asarray(r, float).reshape(-1, 2) for p in g[1] for r in p]


def mapped(g: Geom, f) -> Geom:
    return g[0], [[f(np.asarray(r, float).reshape(-1, 2)) for r in p] for p in g[1]]


def areal(g: Geom) -> bool:
    return "Polygon" in g[0]


class Frame:
    """A plane at the middle of the box of some geometries."""

    def __init__(self, *geoms: Geom):
        pts = np.concatenate([r for g in geoms for r in rings(g)])
        if not len(pts):
            raise ValueError("empty geometry")
        lo, hi = pts.min(0), pts.max(0)
        self.lon0, half = (lo[0] + hi[0]) / 2, (hi[0] - lo[0]) / 2
        nearest = 0.0 if lo[1] <= 0 <= hi[1] else min(abs(lo[1]), abs(hi[1]))
        self.y0 = float(crs.tmerc_forward(self.lon0, (lo[1] + hi[1]) / 2, self.lon0)[1])
        if half > MAX_DEGREES or math.radians(half) * 6378.137 * math.cos(math.radians(nearest)) > MAX_KM:
            raise ValueError("the extent is too large for a plane")

    def to(self, r: np.ndarray) -> np.ndarray:
        return np.stack(crs.tmerc_forward(r[:, 0], r[:, 1], self.lon0, north=-self.y0), axis=1)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.stack(crs.tmerc_reverse(r[:, 0], r[:, 1], self.lon0, north=-self.y0), axis=1) if len(r) else r

    def plane(self, g: Geom) -> list:
        return mapped(g, self.to)[1]

    def earth(self, parts: list) -> Geom | None:
        if not parts:
            return None
        return mapped(("Polygon" if len(parts) == 1 else "MultiPolygon", parts), self.back)


def densified(g: Geom, tol: float = 0.01, most: int = 256) -> Geom:
    """Planar edges cut so that the plane's chord stays within ``tol`` metres of them."""
    def ring(r):
        out = [r[:1]]
        for a, b in zip(r, r[1:], strict=False):
            mid = (a + b) / 2
            f = Frame(("LineString", [[np.array([a, b])]]))
            p = f.to(np.array([a, mid, b]))
            off = float(np.hypot(*(p[1] - (p[0] + p[2]) / 2)))
            n = min(most, max(1, math.ceil(math.sqrt(off / tol))))
            out.append(a + (b - a) * (np.arange(1, n + 1) / n)[:, None])
        return np.concatenate(out)

    return mapped(g, ring)


# Built point by point.
def around(c, radius, bearings) -> np.ndarray:
    x, y, _ = geo.direct(c[0], c[1], np.asarray(bearings, float), np.asarray(radius, float))
    return np.stack([x, y], axis=1)


def circle(c, radius: float, steps: int = 64) -> Geom:
    """Counter-clockwise and closed."""
    return "Polygon", [[pl.closed(around(c, radius, -360.0 * np.arange(max(3, steps)) / max(3, steps)))]]


def arc(c, radius: float, b1: float, b2: float, steps: int = 64) -> np.ndarray:
    sweep = (b2 - b1) % 360 or 360.0
    return around(c, radius, b1 + sweep * np.arange(steps + 1) / steps)


def line_arc(c, radius: float, b1: float, b2: float, steps: int = 64) -> Geom:
    return "LineString", [[arc(c, radius, b1, b2, steps)]]


def sector(c, radius: float, b1: float, b2: float, steps: int = 64) -> Geom:
    if (b2 - b1) % 360 == 0:
        return circle(c, radius, steps)
    return "Polygon", [[pl.closed(np.concatenate([[c], arc(c, radius, b1, b2, steps)]))[::-1]]]


def ellipse(c, x_axis: float, y_axis: float, angle: float = 0.0, steps: int = 64) -> Geom:
    """The x axis points east before it is turned clockwise."""
    t = 2 * np.pi * np.arange(max(8, steps)) / max(8, steps)
    x, y = x_axis * np.cos(t), y_axis * np.sin(t)
    return "Polygon", [[pl.closed(around(c, np.hypot(x, y), np.degrees(np.arctan2(x, y)) + angle))]]


def great_circle(a, b, steps: int = 100) -> Geom:
    s, az, _ = geo.inverse(a[0], a[1], b[0], b[1])
    x, y, _ = geo.direct(a[0], a[1], float(az), float(s) * np.arange(steps) / (steps - 1))
    return "LineString", [[np.stack([x, y], axis=1)]]


def translated(g: Geom, distance: float, bearing: float) -> Geom:
    return mapped(g, lambda r: np.stack(geo.direct(r[:, 0], r[:, 1], bearing, distance)[:2], axis=1))


def middle(g: Geom) -> np.ndarray:
    """Mean of all positions, closing ones left out."""
    return np.concatenate([r[:-1] if areal(g) and len(r) > 1 and (r[0] == r[-1]).all() else r for r in rings(g)]).mean(0)


def _polar(g: Geom, pivot, f) -> Geom:
    pivot = middle(g) if pivot is None else pivot

    def ring(r):
        s, az, _ = geo.inverse(pivot[0], pivot[1], r[:, 0], r[:, 1])
        return np.stack(geo.direct(pivot[0], pivot[1], *f(az, s))[:2], axis=1)

    return mapped(g, ring)


def rotated(g: Geom, angle: float, pivot=None) -> Geom:
    """Clockwise about the pivot, the mean position unless one is given."""
    return _polar(g, pivot, lambda az, s: (az + angle, s))


def scaled(g: Geom, factor: float, origin=None) -> Geom:
    return _polar(g, origin, lambda az, s: (az, s * factor))


# Along lines.
def _measures(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, az, _ = geo.inverse(line[:-1, 0], line[:-1, 1], line[1:, 0], line[1:, 1])
    return np.concatenate([[0.0], np.cumsum(s)]), az


def along(line: np.ndarray, distance: float) -> np.ndarray:
    """The point at a distance along the line, kept to its ends."""
    total, az = _measures(line)
    d = min(max(0.0, distance), total[-1])
    k = min(int(np.searchsorted(total, d, side="right")) - 1, len(line) - 2)
    x, y, _ = geo.direct(line[k, 0], line[k, 1], az[k], d - total[k])
    return np.array([float(x), float(y)])


def line_slice_along(line: np.ndarray, start: float, stop: float) -> np.ndarray:
    """The part between two distances, whichever comes first; an empty one is an error."""
    total, _ = _measures(line)
    lo, hi = sorted((start, stop))
    lo, hi = max(0.0, lo), min(hi, total[-1])
    if lo >= hi:
        raise ValueError("the slice is empty")
    inner = line[(total > lo + 1e-9) & (total < hi - 1e-9)]
    return np.concatenate([[along(line, lo)], inner, [along(line, hi)]])


def nearest_on_line(line: np.ndarray, p) -> tuple[np.ndarray, float, float, int]:
    """The nearest point, its distance, its place along the line, and its segment.

    The foot on every segment is refined until it no longer moves; none is left out.
    """
    total, az = _measures(line)
    k = np.flatnonzero(np.diff(total) > 0)
    if not len(k):
        return line[0], float(geo.inverse(*line[0], *p)[0]), 0.0, 0
    size, lon, lat, az = np.diff(total)[k], line[k, 0], line[k, 1], az[k]
    s, zp, _ = geo.inverse(lon, lat, p[0], p[1])
    t = np.clip(s * np.cos(np.radians(zp - az)), 0, size)
    for _ in range(30):
        x, y, z = geo.direct(lon, lat, az, t)
        s, zp, _ = geo.inverse(x, y, p[0], p[1])
        new = np.clip(t + s * np.cos(np.radians(zp - z)), 0, size)
        done = np.abs(new - t).max() < 1e-6
        t = new
        if done:
            break
    x, y, _ = geo.direct(lon, lat, az, t)
    d = geo.inverse(x, y, p[0], p[1])[0]
    # Of equally near segments, such as two that share an end, the first.
    i = int(np.flatnonzero(d <= d.min() + 1e-9)[0])
    return np.array([float(x[i]), float(y[i])]), float(d[i]), float(total[k[i]] + t[i]), int(k[i])


def point_to_line(g: Geom, p) -> float:
    return min(nearest_on_line(r, p)[1] for r in rings(g))


def inside(g: Geom, p) -> bool:
    return any(pl.winding(np.asarray([p], float), pl.segments([r for r in pl.rewound([part])[0]]))[0] != 0 for part in g[1])


def point_to_polygon(g: Geom, p) -> float:
    """Negative inside."""
    d = point_to_line((g[0], [[pl.closed(r) for r in part] for part in g[1]]), p)
    return -d if inside(g, p) else d


def line_slice(line: np.ndarray, p, q) -> np.ndarray:
    return line_between(line, nearest_on_line(line, p)[2], nearest_on_line(line, q)[2])


def line_between(line: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """Between two places along the line; one within a tenth of a millimetre of a position is that position."""
    total, _ = _measures(line)

    def place(at: float) -> float:
        k = int(np.abs(total - at).argmin())
        return float(total[k]) if abs(total[k] - at) < 1e-4 else at

    return line_slice_along(line, place(lo), place(hi))


def line_chunk(line: np.ndarray, length: float) -> list[np.ndarray]:
    """Pieces of a length, the last one shorter; the line is measured once for all of them."""
    total, az = _measures(line)
    if not total[-1] > 0:
        raise ValueError("the slice is empty")
    at = np.minimum(total[-1], length * np.arange(max(1, math.ceil(total[-1] / length - 1e-12)) + 1))
    k = np.minimum(np.searchsorted(total, at, side="right") - 1, len(line) - 2)
    x, y, _ = geo.direct(line[k, 0], line[k, 1], az[k], at - total[k])
    cut = np.stack([x, y], axis=1)
    return [np.concatenate([cut[[i]], line[(total > lo + 1e-9) & (total < hi - 1e-9)], cut[[i + 1]]]) for i, (lo, hi) in enumerate(zip(at, at[1:], strict=False))]


def line_offset(line: np.ndarray, d: float, steps: int = 32) -> np.ndarray:
    """A parallel to the left for positive distances; outer joints are rounded, inner ones keep both feet."""
    _, az = _measures(line)
    out, side = [], az - math.copysign(90, d)
    for k in range(len(line)):
        if k in (0, len(line) - 1):
            out.append(around(line[k], abs(d), [side[min(k, len(side) - 1)]]))
            continue
        turn = (side[k] - side[k - 1] + 180) % 360 - 180
        outer = turn * d > 0
        n = max(1, math.ceil(abs(turn) / 360 * steps)) if outer else 1
        out.append(around(line[k], abs(d), side[k - 1] + turn * np.arange(n + 1) / n))
    return np.concatenate(out)


def polygon_tangents(g: Geom, p) -> np.ndarray:
    """The polygon's positions of least and greatest bearing from the point."""
    pts = np.concatenate(rings(g))
    _, az, _ = geo.inverse(p[0], p[1], pts[:, 0], pts[:, 1])
    mid = math.degrees(math.atan2(np.sin(np.radians(az)).mean(), np.cos(np.radians(az)).mean()))
    rel = (az - mid + 180) % 360 - 180
    return pts[[int(rel.argmin()), int(rel.argmax())]]


def boolean_parallel(a: np.ndarray, b: np.ndarray, tol: float = 0.1) -> bool:
    if len(a) != len(b):
        return False
    d = np.abs((_measures(a)[1] - _measures(b)[1] + 90) % 180 - 90)
    return bool((d <= tol).all())


def point_on_line(g: Geom, p, tol: float = 0.01, ignore_ends: bool = False) -> bool:
    ends = np.concatenate([r[[0, -1]] for r in rings(g)])
    if ignore_ends and (geo.inverse(ends[:, 0], ends[:, 1], p[0], p[1])[0] <= tol).any():
        return False
    return point_to_line(g, p) <= tol


# In the plane.
def overlaid(op, a: Geom, b: Geom) -> Geom | None:
    """A set operation of two areas in their common plane; nothing for an empty result."""
    f = Frame(a, b)
    return thinned(f.earth(op(f.plane(densified(a)), f.plane(densified(b)))))


def thinned(g: Geom | None, tol: float = 0.015) -> Geom | None:
    """Without what densifying put in: positions within ``tol`` metres of the straight line in degrees."""
    def ring(r):
        if len(r) > 3 and (r[0] == r[-1]).all():  # start at a corner
            r = pl.closed(np.roll(r[:-1], -int(np.lexsort((r[:-1, 1], r[:-1, 0]))[0]), axis=0))
        out = pl.simplify(r, tol / 111_000)
        return out if len(out) >= 4 else r

    return mapped(g, ring) if g else None


def intersect(a: Geom, b: Geom) -> Geom | None:
    return overlaid(pl.intersection, a, b)


def difference(a: Geom, b: Geom) -> Geom | None:
    return overlaid(pl.difference, a, b)


def xor(a: Geom, b: Geom) -> Geom | None:
    return overlaid(pl.symmetric_difference, a, b)


def union(*geoms: Geom) -> Geom | None:
    f = Frame(*geoms)
    return thinned(f.earth(pl.union(*[f.plane(densified(g)) for g in geoms])))


def mask(g: Geom, cover: Geom) -> Geom | None:
    return difference(cover, g)


def along_geodesics(g: Geom, tol: float = 0.01, most: int = 256) -> Geom:
    """Geodesic edges cut so that the plane's chord stays within ``tol`` metres of them."""
    def ring(r):
        s, az, _ = geo.inverse(r[:-1, 0], r[:-1, 1], r[1:, 0], r[1:, 1])
        out = [r[:1]]
        for a, b, n, z in zip(r, r[1:], s, az, strict=False):
            # A geodesic leaves the chord of a plane of its extent by less than its length squared over the earth's size.
            k = int(np.clip(math.ceil(n / math.sqrt(8 * tol * 6.3e6)), 1, most))
            x, y, _ = geo.direct(a[0], a[1], float(z), n * np.arange(1, k) / k)
            out += [np.stack([x, y], axis=1), b[None]]
        return np.concatenate(out)

    return mapped(g, ring)


def _band(g: Geom, radius: float, steps: int, edges: str = "planar", tol: float = 0.01) -> list:
    """A strip along each edge and a circle at each position, in longitude and latitude."""
    out, cut = [], densified if edges == "planar" else along_geodesics
    for r in rings(g):
        for c in np.unique(r, axis=0):
            # Turned by an odd angle, so that corners of strips don't fall on the circle's.
            out.append([pl.closed(around(c, radius, 3.7 - 360.0 * np.arange(4 * steps) / (4 * steps)))])
        for edge in zip(r, r[1:], strict=False) if "Point" not in g[0] else ():
            if (edge[0] == edge[1]).all():
                continue
            # The edge's own curve bends far less than any radius, so its two sides make one ring.
            c = cut(("LineString", [[np.array(edge)]]), tol)[1][0][0]
            _, z1, z2 = geo.inverse(c[:-1, 0], c[:-1, 1], c[1:, 0], c[1:, 1])
            way = np.append(z1, z2[-1])
            way[1:-1] = z2[:-1] + ((z1[1:] - z2[:-1] + 180) % 360 - 180) / 2
            sides = [np.stack(geo.direct(c[:, 0], c[:, 1], way + turn, radius)[:2], axis=1) for turn in (90, -90)]
            out.append([pl.closed(np.concatenate([sides[0], sides[1][::-1]]))])
    return out


def _plane_band(f: Frame, g: Geom, radius: float, steps: int, cut, tol: float) -> list:
    """The same in a plane, where directions are the plane's own."""
    out, turn = [], np.radians(3.7 - 360.0 * np.arange(4 * steps) / (4 * steps))
    for r in rings(g):
        for c in f.to(np.unique(r, axis=0)):
            out.append([pl.closed(c + radius * np.stack([np.sin(turn), np.cos(turn)], axis=1))])
        for edge in zip(r, r[1:], strict=False) if "Point" not in g[0] else ():
            if (edge[0] == edge[1]).all():
                continue
            c = f.to(cut(("LineString", [[np.array(edge)]]), tol)[1][0][0])
            d = np.diff(c, axis=0)
            d /= np.hypot(*d.T)[:, None]
            way = np.concatenate([d[:1], (d[:-1] + d[1:]) / 2, d[-1:]])
            side = radius * np.stack([way[:, 1], -way[:, 0]], axis=1) / np.hypot(*way.T)[:, None]
            out.append([pl.closed(np.concatenate([c + side, (c - side)[::-1]]))])
    return out


def buffer(g: Geom, radius: float, steps: int = 16, edges: str = "planar", method: str = "geodesic", tolerance: float = 0.01) -> Geom | None:
    """All within ``radius`` metres; a negative one draws areas in, zero leaves the area of the input.

    ``steps`` are segments of a quarter circle. ``edges`` tells whether edges are
    straight in longitude and latitude or geodesics; they are followed within
    ``tolerance`` metres. ``method`` places the outline by geodesics or by the
    plane's own distances, which is quicker and as good as the plane.
    """
    if edges not in ("planar", "geodesic") or method not in ("geodesic", "projected"):
        raise ValueError(f"no such edges or method: {edges}, {method}")
    tol = tolerance if tolerance > 0 else 0.01
    cut = densified if edges == "planar" else along_geodesics
    if radius == 0:
        return g if areal(g) else None
    if radius < 0 and not areal(g):
        return None
    if g[0] == "Point" and radius > 0:
        return circle(rings(g)[0][0], radius, 4 * steps)
    if method == "geodesic":
        band = ("MultiPolygon", _band(g, abs(radius), steps, edges, tol))
        f = Frame(g, band)
        pieces = f.plane(band)
    else:
        f = Frame(g)
        pieces = _plane_band(f, g, abs(radius), steps, cut, tol)
    if radius > 0:
        return f.earth(pl.union(pieces, f.plane(cut(g, tol)) if areal(g) else []))
    return f.earth(pl.difference(f.plane(cut(g, tol)), pieces))


def bbox_clip(g: Geom, box) -> Geom:
    if areal(g):
        cover = ("Polygon", [[np.array([[box[0], box[1]], [box[2], box[1]], [box[2], box[3]], [box[0], box[3]], [box[0], box[1]]], float)]])
        return "MultiPolygon", pl.intersection(g[1], cover[1])
    if "Line" in g[0]:
        return "MultiLineString", [[c] for r in rings(g) for c in pl.clip_line(r, box)]
    pts = np.concatenate(rings(g))
    pts = pts[(pts[:, 0] >= box[0]) & (pts[:, 0] <= box[2]) & (pts[:, 1] >= box[1]) & (pts[:, 1] <= box[3])]
    return "MultiPoint", [[p[None]] for p in pts]


def convex(g: Geom) -> Geom | None:
    f = Frame(g)
    hull = pl.convex_hull(np.concatenate([f.to(r) for r in rings(g)]))
    return None if hull is None else f.earth([[hull]])


def concave(g: Geom, max_edge: float) -> Geom | None:
    """The Delaunay triangles of one geometry's positions whose sides are all within ``max_edge``, as areas."""
    from tellurion.operators.delaunay import delaunay

    f = Frame(g)
    p = np.unique(np.concatenate([f.to(r) for r in rings(g)]), axis=0)
    q = p[delaunay(p)] if len(p) > 2 else np.zeros((0, 3, 2))
    sides = np.hypot(*np.moveaxis(q - np.roll(q, -1, axis=1), 2, 0))
    q = q[(sides <= max_edge).all(axis=1)]
    edges = {}
    for t in q:
        for k in range(3):
            a, b = tuple(t[k]), tuple(t[k - 2])
            if edges.pop((b, a), None) is None:
                edges[a, b] = True
    if not edges:
        return None
    return f.earth(pl.assembled(pl.walk(np.array([(*a, *b) for a, b in edges])), 0.0))


def _lines_in_plane(g: Geom, change) -> Geom:
    f = Frame(g)
    return mapped(g, lambda r: f.back(change(f.to(r))))


def simplified(g: Geom, tol: float, preserve_topology: bool = False) -> Geom:
    least = 4 if areal(g) else 2

    def change(r):
        out = pl.simplify_area(r, tol, least) if preserve_topology else pl.simplify(r, tol)
        return out if len(out) >= least else r

    return _lines_in_plane(g, change)


def smoothed(g: Geom, rounds: int = 1) -> Geom:
    return _lines_in_plane(g, lambda r: pl.smooth(r, rounds))


def bezier_spline(g: Geom, sharpness: float = 0.85, steps: int = 16) -> Geom:
    return _lines_in_plane(g, lambda r: pl.bezier(r, sharpness, steps))


def clean_coords(g: Geom, tol: float) -> Geom:
    """Positions within ``tol`` metres of the one before are left out, ends kept."""
    def ring(r):
        keep = [0]
        for k in range(1, len(r)):
            if float(geo.inverse(*r[keep[-1]], *r[k])[0]) > tol:
                keep.append(k)
        if keep[-1] != len(r) - 1:
            keep[-1 if len(keep) > 1 else len(keep) :] = [len(r) - 1]
        return r[keep]

    return mapped(g, ring)


def center_of_mass(g: Geom) -> np.ndarray:
    """Of the area in the plane; of the positions where there is none."""
    f = Frame(g)
    m, x, y = 0.0, 0.0, 0.0
    for part in pl.rewound(f.plane(g)) if areal(g) else []:
        for r in part:
            o = r[0]
            p = r - o
            c = p[:-1, 0] * p[1:, 1] - p[1:, 0] * p[:-1, 1]
            a = c.sum() / 2
            m += a
            x += ((p[:-1, 0] + p[1:, 0]) * c).sum() / 6 + a * o[0]
            y += ((p[:-1, 1] + p[1:, 1]) * c).sum() / 6 + a * o[1]
    return f.back(np.array([[x / m, y / m]]))[0] if m else middle(g)


def point_on_feature(g: Geom) -> np.ndarray:
    """A point inside an area, half-way along its widest level; a position of anything else."""
    if not areal(g):
        pts = np.concatenate(rings(g))
        return pts[len(pts) // 2]
    segs = pl.segments([r for part in pl.rewound(g[1]) for r in part])
    ys = np.unique(segs[:, [1, 3]])
    best = (-1.0, None)
    for y in (ys[:-1] + ys[1:]) / 2:
        s = segs[np.minimum(segs[:, 1], segs[:, 3]) < y]
        s = s[np.maximum(s[:, 1], s[:, 3]) > y]
        x = np.sort(s[:, 0] + (s[:, 2] - s[:, 0]) * (y - s[:, 1]) / (s[:, 3] - s[:, 1]))
        for a, b in zip(x[::2], x[1::2], strict=False):
            if b - a > best[0]:
                best = (b - a, np.array([(a + b) / 2, y]))
    return best[1]


def line_overlap(a: np.ndarray, b: np.ndarray, tol: float = 1e-6) -> list[np.ndarray]:
    """Runs of line a that lie on line b, within ``tol`` metres."""
    f = Frame(("LineString", [[a]]), ("LineString", [[b]]))
    p, s = f.to(a), pl.segments([f.to(b)])
    q = f.to(b)
    edges = [e.reshape(2, 2) for piece in pl.line_split(p, [q], near=max(tol, 1e-6)) for e in np.concatenate([piece[:-1], piece[1:]], axis=1)]
    # The other line's positions that are near end an overlap too, where they stand over the line.
    cut = []
    for e in edges:
        d = e[1] - e[0]
        t = (q - e[0]) @ d / max(float(d @ d), 1e-300)
        near = np.hypot(*(q - (e[0] + t[:, None] * d)).T) <= max(tol, 1e-6)
        at = np.unique(np.concatenate([[0.0], t[near & (t > 1e-12) & (t < 1 - 1e-12)], [1.0]]))
        places = e[0] + at[:, None] * d
        places[-1] = e[1]
        cut += [places[k : k + 2] for k in range(len(at) - 1)]
    out: list[np.ndarray] = []
    for e in cut:
        d = pl.distances(np.array([e[0], e.mean(0), e[1]]), s)
        if d.max() <= max(tol, 1e-6):
            if out and np.hypot(*(out[-1][-1] - e[0])) < 1e-6:
                out[-1] = np.concatenate([out[-1], e[1:]])
            else:
                out.append(e)
    return [f.back(o) for o in out]


def snap_to(g: Geom, reference: list[np.ndarray], tol: float) -> tuple[Geom, int]:
    """Positions moved to the nearest reference position within ``tol`` metres, or else to its nearest segment."""
    ref, moved = np.concatenate(reference), 0

    def ring(r):
        nonlocal moved
        out = r.copy()
        for k, p in enumerate(r):
            d = geo.inverse(p[0], p[1], ref[:, 0], ref[:, 1])[0]
            j = int(np.argmin(d))
            if d[j] <= tol:
                new = ref[j]
            else:
                near = [nearest_on_line(x, p) for x in reference if len(x) > 1]
                near = [n for n in near if n[1] <= tol]
                new = min(near, key=lambda n: n[1])[0] if near else p
            moved += bool((new != p).any())
            out[k] = new
        return out

    return mapped(g, ring), moved


# Validity.
ERRORS = {"non-finite", "out-of-range", "self-intersection", "too-few-points", "hole-outside-shell", "rings-intersect", "ring-not-closed", "zero-area-ring"}


def validate(g: Geom) -> list[tuple[str, str, int, int]]:
    """Issues as (code, severity, part, ring)."""
    out: list[tuple[str, str, int, int]] = []

    def say(code, i, k):
        out.append((code, "error" if code in ERRORS else "warning", i, k))

    for i, part in enumerate(g[1]):
        own = [np.asarray(r, float).reshape(-1, 2) for r in part]
        for k, r in enumerate(own):
            if not np.isfinite(r).all():
                say("non-finite", i, k)
                continue
            if (np.abs(r) > [180, 90]).any():
                say("out-of-range", i, k)
            if len(r) > 1 and (np.abs(np.diff(r[:, 0])) > 180).any():
                say("antimeridian-crossing", i, k)
            if len(r) > 1 and (np.diff(r, axis=0) == 0).all(axis=1).any():
                say("repeated-point", i, k)
            if areal(g):
                if len(r) < 4:
                    say("too-few-points", i, k)
                    continue
                if (r[0] != r[-1]).any():
                    say("ring-not-closed", i, k)
                c, d = pl.closed(r), np.diff(pl.closed(r), axis=0)
                d = d[(d != 0).any(axis=1)]
                e = np.roll(d, -1, axis=0)
                if len(d) and ((d[:, 0] * e[:, 1] == d[:, 1] * e[:, 0]) & ((d * e).sum(1) < 0)).any():
                    say("spike", i, k)
                turn = pl.ring_sum(c)
                if turn == 0:
                    say("zero-area-ring", i, k)
                elif (turn > 0) != (k == 0):
                    say("wrong-winding", i, k)
                if len(pl.kinks([[c]])):
                    say("self-intersection", i, k)
            elif "Line" in g[0]:
                if len(r) < 2:
                    say("too-few-points", i, k)
                elif len(pl.kinks([[r]])):
                    say("line-self-intersection", i, k)
        if areal(g) and len(own) > 1 and not any(x[2] == i and x[1] == "error" for x in out):
            shell = pl.segments([pl.closed(own[0])])
            for k, h in enumerate(own[1:], 1):
                where = pl._locate(h, "Polygon", [[own[0]]], pl.extent(own[0]) * pl.GRID)
                if (where == 2).any():
                    say("hole-outside-shell" if (where == 2).all() else "rings-intersect", i, k)
                elif len(pl.crossings(pl.segments([pl.closed(h)]), shell, 0.0)[0]) > 2:
                    say("rings-intersect", i, k)
    return out


def make_valid(g: Geom, snap_grid: float = 0.0, min_area: float = 0.0, clean_tolerance: float = 0.0) -> tuple[Geom | None, list[str]]:
    """A repaired area and what was done: snapped, cleaned, closed, rebuilt, small parts dropped, rewound."""
    fixes = []
    if not areal(g):
        return g, fixes
    f = Frame(g)
    if snap_grid:
        g, fixes = mapped(g, lambda r: f.back(np.round(f.to(r) / snap_grid) * snap_grid)), [*fixes, "snapped"]
    if clean_tolerance:
        g, fixes = clean_coords(g, clean_tolerance), [*fixes, "cleaned"]
    codes = {x[0] for x in validate(g)}
    if "ring-not-closed" in codes:
        fixes.append("closed")
    g = mapped(g, pl.closed)
    if codes & {"self-intersection", "rings-intersect", "hole-outside-shell"}:
        parts = pl.union(g[1])
        g, fixes = ("Polygon" if len(parts) == 1 else "MultiPolygon", parts), [*fixes, "rebuilt"]
    if min_area and len(g[1]) > 1:
        keep = [p for p in g[1] if geo.area([[pl.closed(r) for r in p]]) >= min_area]
        if len(keep) < len(g[1]):
            g, fixes = (g[0], keep), [*fixes, "dropped"]
    if "wrong-winding" in codes:
        fixes.append("rewound")
    g = (g[0], pl.rewound(g[1]))
    return (g if g[1] else None), fixes


def unkinked(g: Geom) -> list[Geom]:
    fixed, _ = make_valid(g)
    return [("Polygon", [p]) for p in fixed[1]] if fixed else []


# Sets.
def voronoi_frame(x0: float, y0: float, x1: float, y1: float) -> tuple[Frame, np.ndarray]:
    """A plane and, in it, the corners of the sites' box, wider by a tenth on each side or as far as a plane reaches."""
    lo, hi = np.array([x0, y0]), np.array([x1, y1])
    for k in range(21):
        pad = np.maximum(hi - lo, 1e-9) * (0.1 - k / 200)
        a, b = lo - pad, hi + pad
        try:
            f = Frame(("MultiPoint", [[np.array([a, b])]]))
            break
        except ValueError:
            if k == 20:
                raise
    return f, f.to(np.array([[a[0], a[1]], [b[0], a[1]], [b[0], b[1]], [a[0], b[1]]]))


def isolines(x: np.ndarray, y: np.ndarray, z: np.ndarray, level: float) -> list[np.ndarray]:
    """Contour chains over a lattice z[j, i]; cells are cut in two triangles, holes (NaN) in none."""
    segs = []
    for a, b, c in _triangles(x, y, z):
        pts = []
        for p, q in ((a, b), (b, c), (c, a)):
            if (p[2] >= level) != (q[2] >= level):
                t = (level - p[2]) / (q[2] - p[2])
                pts.append((round(p[0] + t * (q[0] - p[0]), 12), round(p[1] + t * (q[1] - p[1]), 12)))
        if len(pts) == 2 and pts[0] != pts[1]:
            segs.append(tuple(pts))
    return stitched(segs)


def _triangles(x, y, z):
    for j in range(len(y) - 1):
        for i in range(len(x) - 1):
            q = [(x[i], y[j], z[j, i]), (x[i + 1], y[j], z[j, i + 1]), (x[i + 1], y[j + 1], z[j + 1, i + 1]), (x[i], y[j + 1], z[j + 1, i])]
            if not any(math.isnan(v[2]) for v in q):
                yield q[0], q[1], q[2]
                yield q[0], q[2], q[3]


def stitched(segs: list[tuple]) -> list[np.ndarray]:
    """Segments joined end to end into chains."""
    at: dict[tuple, list[int]] = {}
    for k, s in enumerate(segs):
        for e in s:
            at.setdefault(e, []).append(k)
    used, out = set(), []

    def grow(chain):
        while True:
            ways = [k for k in at[chain[-1]] if k not in used]
            if not ways:
                return
            used.add(ways[0])
            a, b = segs[ways[0]]
            chain.append(b if a == chain[-1] else a)

    for k in sorted(range(len(segs)), key=lambda k: min(len(at[e]) for e in segs[k])):
        if k not in used:
            used.add(k)
            chain = list(segs[k])
            grow(chain)
            chain.reverse()
            grow(chain)
            out.append(np.array(chain))
    return out


def isobands(x: np.ndarray, y: np.ndarray, z: np.ndarray, breaks: list[float]) -> list[tuple[float, float, Geom | None]]:
    """Areas between neighbouring breaks, each triangle cut to its share and all joined."""
    out = []
    for lo, hi in zip(sorted(breaks), sorted(breaks)[1:], strict=False):
        pieces = []
        for tri in _triangles(x, y, z):
            t = np.array(tri)
            for bound, sign in ((lo, -1), (hi, 1)):
                if len(t):
                    t = _clip_z(t, sign * (t[:, 2] - bound))
            if len(t) > 2:
                pieces.append([pl.closed(t[:, :2])])
        parts = pl.union(pieces) if pieces else []
        out.append((lo, hi, ("MultiPolygon", parts) if parts else None))
    return out


def _clip_z(t: np.ndarray, value: np.ndarray) -> np.ndarray:
    out = []
    for k in range(len(t)):
        a, b, va, vb = t[k], t[(k + 1) % len(t)], value[k], value[(k + 1) % len(t)]
        if va <= 0:
            out.append(a)
        if (va < 0 < vb) or (vb < 0 < va):
            out.append(a + (b - a) * (va / (va - vb)))
    return np.array(out).reshape(-1, 3)


def shortest_path(start, end, obstacles: list[Geom], resolution: float = 1000.0, pad: float = 0.0, most: int = 12_000_000) -> np.ndarray:
    """A path around obstacles: A* on a lattice in the plane without cut corners, then pulled straight."""
    start, end = np.asarray(start, float), np.asarray(end, float)
    box = ("MultiPoint", [[np.stack([start, end])]])
    f = Frame(box, *obstacles)
    a, b = f.to(np.stack([start, end]))
    blocks = [buffer(o, pad) if pad else o for o in obstacles]
    segs = [pl.segments([f.to(pl.closed(r)) for part in pl.rewound(o[1]) for r in part]) for o in blocks if o]
    solid = np.concatenate(segs) if segs else np.zeros((0, 4))

    def clear(p, q) -> bool:
        if not len(solid):
            return True
        if len(pl.crossings(np.array([[*p, *q]]), solid, 0.0)[0]):
            return False
        return not any(pl.winding(np.array([(p + q) / 2]), s)[0] for s in segs)

    if clear(a, b):
        return np.stack([start, end])
    pts = np.concatenate([np.stack([a, b]), solid.reshape(-1, 2)])
    lo, hi = pts.min(0) - 4 * resolution, pts.max(0) + 4 * resolution
    if np.prod((hi - lo) / resolution + 1) > most:
        raise ValueError("the lattice is too large")
    free: dict[tuple, bool] = {}

    def at(c):
        return a + np.array(c) * resolution

    def ok(c) -> bool:
        if c not in free:
            p = at(c)
            free[c] = bool((p >= lo).all() and (p <= hi).all()) and not any(pl.winding(p[None], s)[0] for s in segs)
        return free[c]

    goal = tuple(np.round((b - a) / resolution).astype(int))
    heap, cost, came = [(0.0, (0, 0))], {(0, 0): 0.0}, {}
    moves = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    while heap:
        _, c = heapq.heappop(heap)
        if c == goal:
            break
        for i, j in moves:
            n = (c[0] + i, c[1] + j)
            if not ok(n) or (i and j and not (ok((c[0] + i, c[1])) and ok((c[0], c[1] + j)))):
                continue
            g = cost[c] + math.hypot(i, j)
            if g < cost.get(n, math.inf):
                cost[n], came[n] = g, c
                heapq.heappush(heap, (g + math.hypot(goal[0] - n[0], goal[1] - n[1]), n))
    else:
        raise ValueError("no path")
    chain = [goal]
    while chain[-1] in came:
        chain.append(came[chain[-1]])
    path = [a, *[at(c) for c in chain[::-1]][1:-1], b]
    out, k = [path[0]], 0
    while k < len(path) - 1:
        j = next(j for j in range(min(len(path) - 1, k + 512), k, -1) if j == k + 1 or clear(path[k], path[j]))
        out.append(path[j])
        k = j
    out = f.back(np.array(out))
    out[0], out[-1] = start, end
    return out
