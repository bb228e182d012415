"""Geodesics on the ellipsoid over NumPy arrays, and the columns made from them.

The geodesic's integrals for distance, longitude and area are smooth, so
fixed Gauss-Legendre rules give them to rounding; no series tables are needed.
The inverse problem is a bracketed Newton search for the first azimuth in
canonical position, which holds for antipodal points too. All steps work on whole
arrays, so that a column is solved one Arrow batch at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tellurion.functions.units import metres
from tellurion.session import ship

A, FLAT = 6378137.0, 1 / 298.257223563
B, E2 = A * (1 - FLAT), FLAT * (2 - FLAT)
EP2 = E2 / (1 - E2)
_X, _W = np.polynomial.legendre.leggauss(16)
#: Arcs up to so many radians take one short rule, which is as exact there.
SHORT, _X8, _W8 = 0.3, *np.polynomial.legendre.leggauss(8)
#: Rows that are solved at once, so that what they need stays in the processor's cache.
CHUNK = 1 << 14


def _rule(s1, s2):
    """Panels, nodes and weights that suit all arcs from s1 to s2."""
    if len(s1) and np.nanmax(np.abs(s2 - s1), initial=0.0) <= SHORT:
        return ((s1, s2),), _X8, _W8
    mid = (s1 + s2) / 2
    return ((s1, mid), (mid, s2)), _X, _W


def chunked(f, *args):
    """A function of arrays that gives arrays, over pieces of them."""
    args = np.broadcast_arrays(*(np.asarray(v, float) for v in args))
    shape, args = args[0].shape, [v.ravel() for v in args]
    if args[0].size <= CHUNK:
        return tuple(v.reshape(shape) for v in f(*args))
    out = [f(*(v[lo : lo + CHUNK] for v in args)) for lo in range(0, args[0].size, CHUNK)]
    return tuple(np.concatenate(v).reshape(shape) for v in zip(*out, strict=True))


def _integrals(s1, s2, sa0, what: str):
    """Integrals over arc length from s1 to s2 on the auxiliary sphere."""
    k2 = EP2 * (1 - sa0 * sa0)
    total, (panels, x, w) = 0.0, _rule(s1, s2)
    for lo, hi in panels:
        half = (hi - lo) / 2
        t = (hi + lo)[:, None] / 2 + half[:, None] * x
        root = np.sqrt(1 + k2[:, None] * np.sin(t) ** 2)
        if what == "distance":
            v = root
        elif what == "longitude":
            v = (2 - FLAT) / (1 + (1 - FLAT) * root)
        else:
            v = (root * root - 1) / root
        total = total + half * (v @ w)
    return total


def _wrap(d):
    return d - 360 * np.round(d / 360)


def inverse(lon1, lat1, lon2, lat2):
    """s12 in metres, and the azimuths in degrees at both ends, in (-180, 180]."""
    return chunked(lambda *a: _inverse(*a)[:3], lon1, lat1, lon2, lat2)


def _inverse(lon1, lat1, lon2, lat2):
    """As ``inverse``, and the area between the geodesic and the equator, positive for eastward ones in the north."""
    bad = ~(np.isfinite(lon1) & np.isfinite(lat1) & np.isfinite(lon2) & np.isfinite(lat2))
    lon1, lat1, lon2, lat2 = (np.where(bad, 0.0, v) for v in (lon1, lat1, lon2, lat2))
    d = _wrap(lon2 - lon1)
    east = np.where(d < 0, -1.0, 1.0)
    lam = np.radians(np.abs(d))
    # Canonical: the first point is southern and no nearer to the equator.
    swap = np.where(np.abs(lat1) < np.abs(lat2), -1.0, 1.0)
    p1, p2 = np.where(swap < 0, lat2, lat1), np.where(swap < 0, lat1, lat2)
    north = np.where(p1 > 0, -1.0, 1.0)
    b1 = np.arctan2((1 - FLAT) * np.sin(np.radians(p1 * north)), np.cos(np.radians(p1)))
    b2 = np.arctan2((1 - FLAT) * np.sin(np.radians(p2 * north)), np.cos(np.radians(p2)))
    c1, c2 = np.maximum(np.cos(b1), 1e-16), np.maximum(np.cos(b2), 1e-16)
    z1, z2 = -np.abs(np.sin(b1)), np.sin(b2)  # an equatorial first point is a little south

    def solve(a1, c1=c1, c2=c2, z1=z1, z2=z2):
        sa1, ca1 = np.sin(a1), np.cos(a1)
        sa0 = sa1 * c1
        ca2c2 = np.sqrt(np.maximum(0, (ca1 * c1) ** 2 + np.where(c2 > c1, (c2 - c1) * (c1 + c2), (z1 - z2) * (z1 + z2))))
        sig1, sig2 = np.arctan2(z1, ca1 * c1), np.arctan2(z2, ca2c2)
        om1, om2 = np.arctan2(sa0 * z1, ca1 * c1), np.arctan2(sa0 * z2, ca2c2)
        sig2 = np.where(sig2 < sig1, sig1, sig2)
        om12 = np.mod(om2 - om1, 2 * np.pi)
        om12 = np.where(om12 > 2 * np.pi - 1e-9, 0.0, om12)
        got = om12 - FLAT * sa0 * _integrals(sig1, sig2, sa0, "longitude")
        k2 = EP2 * (1 - sa0 * sa0)
        j = _integrals(sig1, sig2, sa0, "reduced")
        m = np.sqrt(1 + k2 * np.sin(sig2) ** 2) * np.cos(sig1) * np.sin(sig2) - np.sqrt(1 + k2 * np.sin(sig1) ** 2) * np.sin(sig1) * np.cos(sig2) - np.cos(sig1) * np.cos(sig2) * j
        flat = ca2c2 < 1e-14
        slope = np.where(flat, -2 * np.sqrt(np.maximum(0, 1 - E2 * c1 * c1)) / np.where(z1 == 0, -1e-300, z1), m / np.where(flat, 1.0, ca2c2))
        return got, slope, sig1, sig2, sa0, ca2c2

    # A spherical start, then Newton steps that never leave the bracket.
    w = np.sqrt(np.maximum(1e-12, 1 - E2 * ((c1 + c2) / 2) ** 2))
    om = lam / w
    sph = np.arctan2(c2 * np.sin(om), c1 * z2 - z1 * c2 * np.cos(om))
    a1 = np.clip(np.where((om < np.pi) & (sph > 0), sph, np.pi / 2), 1e-300, np.pi)
    lo, hi, at = np.zeros_like(a1), np.full_like(a1, np.pi), np.arange(len(a1))
    for _ in range(80):
        own = a1[at]
        got, slope, *_ = solve(own, c1[at], c2[at], z1[at], z2[at])
        v = got - lam[at]
        lo[at], hi[at] = np.where(v < 0, own, lo[at]), np.where(v > 0, own, hi[at])
        with np.errstate(all="ignore"):
            step = own - v / slope
        ok = np.isfinite(step) & (step > lo[at]) & (step < hi[at]) & (slope > 0)
        new = np.where(v == 0, own, np.where(ok, step, (lo[at] + hi[at]) / 2))
        a1[at] = new
        at = at[(np.abs(new - own) > 1e-15) & (hi[at] - lo[at] > 1e-15)]  # the rest have converged
        if not len(at):
            break
    a1 = np.where(lam == 0, 0.0, a1)
    _, _, sig1, sig2, sa0, ca2c2 = solve(a1)
    sa1, ca1, sa2, ca2 = np.sin(a1), np.cos(a1), sa0 / c2, ca2c2 / c2
    # Meridians, where both azimuths are known.
    same = lam == 0
    sig2 = np.where(same, np.arctan2(z2, c2), sig2)
    sig1 = np.where(same, np.arctan2(z1, c1), sig1)
    s12 = B * _integrals(sig1, np.maximum(sig1, sig2), sa0, "distance")
    # Both on the equator, and near enough to stay on it.
    equator = (z1 == 0) & (z2 == 0) & (lam <= (1 - FLAT) * np.pi)
    s12 = np.where(equator, A * lam, s12)
    sa1, ca1, sa2, ca2 = (np.where(equator, v, x) for v, x in ((1.0, sa1), (0.0, ca1), (1.0, sa2), (0.0, ca2)))
    nothing = (lam == 0) & (lat1 == lat2)
    s12 = np.where(nothing, 0.0, s12)
    sa1, sa2 = np.where(swap < 0, sa2, sa1), np.where(swap < 0, sa1, sa2)
    ca1, ca2 = np.where(swap < 0, ca2, ca1), np.where(swap < 0, ca1, ca2)
    sign, turn = east, swap * north
    strip = np.where(same | equator | nothing, 0.0, east * north * _strip(sig1, np.maximum(sig1, sig2), sa0, np.hypot(np.cos(a1), np.sin(a1) * z1)))
    az1, az2 = np.degrees(np.arctan2(sa1 * sign, ca1 * turn)), np.degrees(np.arctan2(sa2 * sign, ca2 * turn))
    az1, az2 = (np.where(v == -180, 180.0, v) for v in (az1, az2))
    return tuple(np.where(bad, np.nan, v) for v in (s12, az1, az2, strip))


def _strip(s1, s2, sa0, ca0):
    """Area between the equator and a geodesic's arc: zones' areas over the longitude that it passes."""
    ca0 = ca0[:, None]
    k2, total, (panels, x, w) = EP2 * ca0 * ca0, 0.0, _rule(s1, s2)
    for lo, hi in panels:
        half = (hi - lo) / 2
        t = np.sin((hi + lo)[:, None] / 2 + half[:, None] * x)
        sin_b = ca0 * t
        cos2 = np.maximum(1e-32, 1 - sin_b * sin_b)
        turn = sa0[:, None] * (1 / cos2 - FLAT * (2 - FLAT) / (1 + (1 - FLAT) * np.sqrt(1 + k2 * t * t)))
        total = total + half * ((_zone_of(sin_b / np.sqrt(sin_b * sin_b + (1 - FLAT) ** 2 * cos2)) * turn) @ w)
    return total


def direct(lon, lat, azimuth, s12):
    """lon2, lat2 and the azimuth there, after s12 metres."""
    return chunked(_direct, lon, lat, azimuth, s12)


def _direct(lon, lat, azimuth, s12):
    sa1, ca1 = np.sin(np.radians(azimuth)), np.cos(np.radians(azimuth))
    b1 = np.arctan2((1 - FLAT) * np.sin(np.radians(lat)), np.cos(np.radians(lat)))
    c1 = np.maximum(np.cos(b1), 1e-16)
    sa0 = sa1 * c1
    ca0 = np.hypot(ca1, sa1 * np.sin(b1))
    sig1 = np.arctan2(np.sin(b1), ca1 * c1)
    k2 = EP2 * ca0 * ca0
    sig2 = sig1 + s12 / (B * np.sqrt(1 + k2 / 2))
    for _ in range(8):
        step = (s12 / B - _signed(sig1, sig2, sa0, "distance")) / np.sqrt(1 + k2 * np.sin(sig2) ** 2)
        sig2 = sig2 + step
        if (np.abs(step[np.isfinite(step)]) < 1e-15).all():
            break
    b2 = np.arctan2(ca0 * np.sin(sig2), np.hypot(sa0, ca0 * np.cos(sig2)))
    # Longitude on the sphere, unrolled with the arc so that it keeps its turns.
    e = np.where(sa0 < 0, -1.0, 1.0)
    om12 = e * (sig2 - sig1 - (np.arctan2(np.sin(sig2), np.cos(sig2)) - np.arctan2(np.sin(sig1), np.cos(sig1))) + np.arctan2(e * sa0 * np.sin(sig2), np.cos(sig2)) - np.arctan2(e * sa0 * np.sin(sig1), np.cos(sig1)))
    lam = om12 - FLAT * sa0 * _signed(sig1, sig2, sa0, "longitude")
    lon2 = _wrap(lon + np.degrees(lam))
    lat2 = np.degrees(np.arctan2(np.sin(b2), (1 - FLAT) * np.cos(b2)))
    az2 = np.degrees(np.arctan2(sa0, ca0 * np.cos(sig2)))
    return lon2, lat2, az2


def _signed(s1, s2, sa0, what):
    """As above; long arcs take more halves."""
    parts = int(np.clip(np.ceil(np.nanmax(np.abs(s2 - s1), initial=0.0) / np.pi), 1, 64)) if len(s1) else 1
    cuts = [s1 + (s2 - s1) * i / parts for i in range(parts + 1)]
    return sum(_integrals(a, b, sa0, what) for a, b in zip(cuts, cuts[1:], strict=False))


def _zone_of(s):
    """Area from the equator to the latitude with this sine, square metres a radian of longitude."""
    e = np.sqrt(E2)
    return B * B / 2 * (s / (1 - E2 * s * s) + np.arctanh(e * s) / e)


def strips(lon1, lat1, lon2, lat2):
    """Signed areas between geodesic edges and the equator, square metres."""
    return chunked(lambda *a: _inverse(*a)[3:], lon1, lat1, lon2, lat2)[0]


def ring_area(lon, lat) -> float:
    """Signed area inside a closed ring of geodesic edges, square metres; counter-clockwise is positive."""
    lon, lat = np.asarray(lon, float), np.asarray(lat, float)
    return -float(strips(lon[:-1], lat[:-1], lon[1:], lat[1:]).sum())


def area(parts) -> float:
    """Parts of rings of (n, 2) arrays: shells less holes."""
    return float(sum(max(0.0, abs(ring_area(*p[0].T)) - sum(abs(ring_area(*h.T)) for h in p[1:])) for p in parts))


def feet(ax, ay, bx, by, px, py):
    """Of geodesics from a to b, the places nearest to p: x, y, distance, and metres along; found by steps that end."""
    return chunked(_feet, ax, ay, bx, by, px, py)


def _feet(ax, ay, bx, by, px, py):
    size, az, _ = inverse(ax, ay, bx, by)
    s, zp, _ = inverse(ax, ay, px, py)
    t, open_ = np.clip(s * np.cos(np.radians(zp - az)), 0, size), np.arange(len(size))
    for _ in range(60):
        x, y, z = direct(ax[open_], ay[open_], az[open_], t[open_])
        s, zp, _ = inverse(x, y, px[open_], py[open_])
        new = np.clip(t[open_] + s * np.cos(np.radians(zp - z)), 0, size[open_])
        still = np.abs(new - t[open_]) > 1e-6
        t[open_] = new
        open_ = open_[still]
        if not len(open_):
            break
    x, y, _ = direct(ax, ay, az, t)
    return x, y, inverse(x, y, px, py)[0], t


def _struct(*names: str) -> StructType:
    return StructType([StructField(n, DoubleType()) for n in names])


# Columns. Each solves a batch of rows at once.
@F.pandas_udf(_struct("s12", "azi1", "azi2"))
def inverse_udf(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.DataFrame:
    s, a, b = inverse(*(v.to_numpy(float) for v in (lon1, lat1, lon2, lat2)))
    return pd.DataFrame({"s12": s, "azi1": a, "azi2": b})


@F.pandas_udf(DoubleType())
def distance_udf(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
    return pd.Series(inverse(*(v.to_numpy(float) for v in (lon1, lat1, lon2, lat2)))[0])


@F.pandas_udf(_struct("x", "y"))
def direct_udf(lon: pd.Series, lat: pd.Series, azimuth: pd.Series, s12: pd.Series) -> pd.DataFrame:
    x, y, _ = direct(*(v.to_numpy(float) for v in (lon, lat, azimuth, s12)))
    return pd.DataFrame({"x": x, "y": y})


@F.pandas_udf(_struct("x", "y", "dist", "along"))
def foot_udf(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series, px: pd.Series, py: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(("x", "y", "dist", "along"), feet(*(v.to_numpy(float) for v in (ax, ay, bx, by, px, py))), strict=True)))


def foot(ax, ay, bx, by, px, py) -> Column:
    """The place of a segment that is nearest to a point: struct of x, y, dist and along, in metres."""
    ship()
    return foot_udf(ax, ay, bx, by, px, py)


def _null(c: Column) -> Column:
    return F.when(F.isnan(c), None).otherwise(c)


def distance(lon1, lat1, lon2, lat2, units: str = "kilometers") -> Column:
    """Geodesic distance; null where a coordinate is. A literal origin makes it one-to-many."""
    ship()
    return _null(distance_udf(lon1, lat1, lon2, lat2)) / metres(units)


def bearing(lon1, lat1, lon2, lat2, final: bool = False) -> Column:
    """First azimuth in (-180, 180], or the last one in [0, 360)."""
    ship()
    both = inverse_udf(lon1, lat1, lon2, lat2)
    if not final:
        return _null(both["azi1"])
    return _null(F.when(both["azi2"] < 0, both["azi2"] + 360).otherwise(both["azi2"]))


def destination(lon, lat, length, azimuth, units: str = "kilometers") -> Column:
    ship()
    return direct_udf(lon, lat, azimuth, length * metres(units))


def midpoint(lon1, lat1, lon2, lat2) -> Column:
    ship()
    both = inverse_udf(lon1, lat1, lon2, lat2)
    return direct_udf(lon1, lat1, both["azi1"], both["s12"] / 2)


def angle(ax, ay, bx, by, cx, cy, explementary: bool = False) -> Column:
    """The angle at b in [0, 180], or what it lacks of 360."""
    d = bearing(bx, by, cx, cy) - bearing(bx, by, ax, ay)
    inner = F.abs(F.pmod(d + 180, F.lit(360.0)) - 180)
    return 360 - inner if explementary else inner
