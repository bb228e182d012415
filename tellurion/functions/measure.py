"""Ellipsoidal measures in closed form or by fixed quadrature, as columns.

Everything here is a column expression; nothing leaves the JVM.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tellurion.functions import types as T
from tellurion.functions.crs import WGS84_A as A
from tellurion.functions.crs import WGS84_F, _rectifying, _series
from tellurion.functions.mathx import engine
from tellurion.functions.units import metres

E2 = WGS84_F * (2 - WGS84_F)
E1 = math.sqrt(E2)
B = A * (1 - WGS84_F)
#: Seven-point Gauss-Legendre on [0, 1]; a panel spans two degrees at most.
NODES, NODE_WEIGHTS = (np.polynomial.legendre.leggauss(7)[0] + 1) / 2, np.polynomial.legendre.leggauss(7)[1] / 2
PANEL = 2.0
# Meridian arc and footpoint latitude in the third flattening; odd or even powers only.
_ARC = [[-3 / 2, 0, 9 / 16, 0, -3 / 32], [15 / 16, 0, -15 / 32, 0, 135 / 2048], [-35 / 48, 0, 105 / 256], [315 / 512, 0, -189 / 512], [-693 / 1280], [1001 / 2048]]
_FOOT = [[3 / 2, 0, -27 / 32, 0, 269 / 512], [21 / 16, 0, -55 / 32, 0, 6759 / 4096], [151 / 96, 0, -417 / 128], [1097 / 512, 0, -15543 / 2560], [8011 / 2560], [293393 / 61440]]


def meridian_arc(phi):
    """Metres along the meridian from the equator to a latitude in radians."""
    m = engine(phi)
    n, radius = _rectifying(A, WGS84_F)
    out = phi
    for j, c in enumerate(_series(_ARC, n), 1):
        out = out + c * m.sin(2 * j * phi)
    return radius * out


def footpoint(arc):
    """The latitude, in radians, at a length along the meridian."""
    m = engine(arc)
    n, radius = _rectifying(A, WGS84_F)
    mu = arc / radius
    out = mu
    for j, c in enumerate(_series(_FOOT, n), 1):
        out = out + c * m.sin(2 * j * mu)
    return out


def isometric(phi):
    m = engine(phi)
    return m.asinh(m.tan(phi)) - E1 * m.atanh(E1 * m.sin(phi))


def normal_radius(phi):
    m = engine(phi)
    s = m.sin(phi)
    return A / m.sqrt(1 - E2 * s * s)


def _turn(d):
    """A difference of longitudes in [-pi, pi)."""
    m = engine(d)
    return d - 2 * math.pi * m.floor((d + math.pi) / (2 * math.pi))


def rhumb_distance(lon1, lat1, lon2, lat2, units: str = "kilometers"):
    m = engine(lon1)
    p1, p2, d = m.radians(lat1), m.radians(lat2), _turn(m.radians(lon2 - lon1))
    d_psi, d_arc = isometric(p2) - isometric(p1), meridian_arc(p2) - meridian_arc(p1)
    flat = m.abs(p2 - p1) < 1e-11
    q = m.where(flat, normal_radius(p1) * m.cos(p1), d_arc / m.where(flat, d_psi * 0 + 1.0, d_psi))
    return m.sqrt(d_arc * d_arc + q * d * (q * d)) / metres(units)


def rhumb_place(lon: Column, lat: Column) -> Column:
    """What a point brings to rhumb distances, so that pairs need no series: longitude, latitude, isometric latitude, arc, and its parallel's radius."""
    phi = F.radians(lat)
    return F.struct(F.radians(lon).alias("lam"), phi.alias("phi"), isometric(phi).alias("psi"), meridian_arc(phi).alias("arc"), (normal_radius(phi) * F.cos(phi)).alias("round"))


def rhumb_between(a: Column, b: Column) -> Column:
    """Metres between two ``rhumb_place``s."""
    d, d_arc = _turn(b["lam"] - a["lam"]), b["arc"] - a["arc"]
    q = F.when(F.abs(b["phi"] - a["phi"]) < 1e-11, a["round"]).otherwise(d_arc / F.nullif(b["psi"] - a["psi"], F.lit(0.0))) * d
    return F.sqrt(d_arc * d_arc + q * q)


def rhumb_bearing(lon1, lat1, lon2, lat2, final: bool = False):
    """Degrees in (-180, 180]; the final bearing is that from the end, turned about, in [0, 360)."""
    m = engine(lon1)
    d = _turn(m.radians(lon2 - lon1))
    b = m.degrees(m.atan2(d, isometric(m.radians(lat2)) - isometric(m.radians(lat1))))
    return m.where(b < 0, b + 360, b) if final else b


def rhumb_destination(lon, lat, distance, bearing, units: str = "kilometers"):
    m = engine(lon)
    p1, az, s = m.radians(lat), m.radians(bearing), distance * metres(units)
    p2 = footpoint(meridian_arc(p1) + s * m.cos(az))
    flat = m.abs(m.cos(az)) < 1e-9
    d = m.where(flat, s * m.sin(az) / (normal_radius(p1) * m.cos(p1)), m.tan(az) * (isometric(p2) - isometric(p1)))
    out = lon + m.degrees(d)
    return out - 360 * m.floor((out + 180) / 360), m.degrees(p2)


def _panels(p: Column, q: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(q["x"] - p["x"]), F.abs(q["y"] - p["y"])) / PANEL).cast("int"))


def _over_edge(p: Column, q: Column, f) -> Column:
    """Mean of ``f(latitude in radians)`` along the straight edge from p to q."""
    n = _panels(p, q)
    nodes = F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(w)).alias("w")) for t, w in zip(NODES, NODE_WEIGHTS, strict=True)])

    def panel(i: Column) -> Column:
        return F.aggregate(nodes, F.lit(0.0), lambda acc, k: acc + k["w"] * f(F.radians(p["y"] + (q["y"] - p["y"]) * ((i - 1 + k["t"]) / n))))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda acc, i: acc + panel(i)) / n


def edge_length(p: Column, q: Column) -> Column:
    """Metres along the straight longitude-latitude edge, on the ellipsoid."""
    d_phi, d_lam = F.radians(q["y"] - p["y"]), F.radians(q["x"] - p["x"])

    def speed(phi: Column) -> Column:
        w = 1 - E2 * F.sin(phi) * F.sin(phi)
        m, n = A * (1 - E2) / (w * F.sqrt(w)) * d_phi, A / F.sqrt(w) * F.cos(phi) * d_lam
        return F.sqrt(m * m + n * n)

    return _over_edge(p, q, speed)


def segments(r: Column) -> Column:
    """Pairs of neighbours: array<struct<p,q>>."""
    n = F.size(r)
    return F.when(n < 2, F.array().cast(f"array<struct<p:{T.POSITION},q:{T.POSITION}>>")).otherwise(F.zip_with(F.slice(r, F.lit(1), n - 1), F.slice(r, F.lit(2), n - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q"))))


def ring_length(r: Column) -> Column:
    return F.aggregate(segments(r), F.lit(0.0), lambda acc, s: acc + edge_length(s["p"], s["q"]))


def length(geom: Column, units: str = "kilometers") -> Column:
    """Lines and polygon rings with planar edges; points have none."""
    return F.aggregate(T.rings_of(geom), F.lit(0.0), lambda acc, r: acc + ring_length(r)) / metres(units)


def zone_area(phi: Column) -> Column:
    """Square metres a radian of longitude wide, from the equator to a latitude."""
    s = F.sin(phi)
    return B * B / 2 * (s / (1 - E2 * s * s) + F.atanh(E1 * s) / E1)


def ring_area(r: Column) -> Column:
    """Signed square metres inside a ring with planar edges; counter-clockwise is positive."""
    return -F.aggregate(segments(r), F.lit(0.0), lambda acc, s: acc + F.radians(s["q"]["x"] - s["p"]["x"]) * _over_edge(s["p"], s["q"], zone_area))


def area(geom: Column) -> Column:
    """Square metres with planar edges: shells less holes; none for points and lines."""
    def part(rings: Column) -> Column:
        holes = F.aggregate(F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0))), F.lit(0.0), lambda acc, r: acc + F.abs(ring_area(r)))
        return F.greatest(F.lit(0.0), F.abs(ring_area(F.element_at(rings, 1))) - holes)

    return F.when(geom["kind"].isin("Polygon", "MultiPolygon"), F.aggregate(geom["parts"], F.lit(0.0), lambda acc, p: acc + part(p))).otherwise(F.lit(0.0))


def center(geom: Column) -> Column:
    b = T.bbox(geom)
    return T.position((b["xmin"] + b["xmax"]) / 2, (b["ymin"] + b["ymax"]) / 2)


def centroid(geom: Column) -> Column:
    """Mean of the positions, closing ones left out."""
    ps = T.open_positions(geom)
    total = F.aggregate(ps, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), lambda a, p: F.struct((a["x"] + p["x"]).alias("x"), (a["y"] + p["y"]).alias("y")))
    return T.position(total["x"] / F.size(ps), total["y"] / F.size(ps))


def square(box: Column) -> Column:
    """The box with its short side padded evenly to the long one."""
    w, h = box["xmax"] - box["xmin"], box["ymax"] - box["ymin"]
    side = F.greatest(w, h)
    return F.struct((box["xmin"] - (side - w) / 2).alias("xmin"), (box["ymin"] - (side - h) / 2).alias("ymin"), (box["xmax"] + (side - w) / 2).alias("xmax"), (box["ymax"] + (side - h) / 2).alias("ymax"))
