"""Coordinate reference systems: WGS84, CGCS2000, GCJ-02, BD-09, Web Mercator and transverse Mercator.

``convert`` gives the expressions for a pair of systems, for columns or arrays.
The systems are known when a plan is built, so parameters are literals and equal
systems cost nothing.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellurion.functions.mathx import engine

# Ellipsoids.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
GRS80_A, GRS80_F = 6378137.0, 1 / 298.257222101
# Web Mercator.
MERCATOR_R, MERCATOR_LAT = 6378137.0, 85.05112877980659
# The published GCJ-02 series (Krasovsky ellipsoid) and the box in which it holds.
GCJ_A, GCJ_E2 = 6378245.0, 0.00669342162296594323
GCJ_BOX = (72.004, 137.8347, 0.8293, 55.8271)
BD_PI = math.pi * 3000 / 180
#: Fixed-point steps of the inverses; four reach 1e-10 degrees anywhere in the box.
INVERSE_STEPS = 5


@dataclass(frozen=True)
class Crs:
    """A system: its kind and, for a transverse Mercator, its parameters."""

    name: str
    kind: str
    lon0: float = 0.0
    k0: float = 1.0
    east: float = 0.0
    north: float = 0.0
    a: float = WGS84_A
    f: float = WGS84_F


def tmerc(lon0: float, k0: float = 1.0, east: float = 500000.0, north: float = 0.0, ellps: str = "WGS84", name: str | None = None) -> Crs:
    a, f = (GRS80_A, GRS80_F) if ellps.upper() in ("GRS80", "CGCS2000") else (WGS84_A, WGS84_F)
    return Crs(name or f"TMERC({lon0})", "tmerc", lon0, k0, east, north, a, f)


# Accepted names.
ALIASES = {
    "WGS84": "WGS84", "EPSG:4326": "WGS84", "CRS84": "WGS84", "GPS": "WGS84", "4326": "WGS84",
    "CGCS2000": "CGCS2000", "EPSG:4490": "CGCS2000", "4490": "CGCS2000",
    "GCJ02": "GCJ02", "AMAP": "GCJ02", "GAODE": "GCJ02", "MARS": "GCJ02",
    "BD09": "BD09", "BAIDU": "BD09", "BD09LL": "BD09",
    "WEBMERCATOR": "EPSG:3857", "EPSG:3857": "EPSG:3857", "EPSG:900913": "EPSG:3857", "900913": "EPSG:3857", "3857": "EPSG:3857",
}
KINDS = {"WGS84": "geographic", "CGCS2000": "geographic", "GCJ02": "gcj", "BD09": "bd", "EPSG:3857": "mercator"}


def epsg(code: int) -> Crs | None:
    """UTM (326xx, 327xx) and Gauss-Krueger on CGCS2000 (4491 to 4554)."""
    name = f"EPSG:{code}"
    if 32601 <= code <= 32660 or 32701 <= code <= 32760:
        return tmerc((code % 100) * 6 - 183.0, 0.9996, 500000.0, 1e7 if code >= 32700 else 0.0, name=name)
    if 4491 <= code <= 4501:  # 6 degree zones 13 to 23, with prefix
        return tmerc((code - 4491) * 6 + 75.0, 1.0, (code - 4491 + 13) * 1e6 + 5e5, ellps="GRS80", name=name)
    if 4502 <= code <= 4512:  # the same by central meridian
        return tmerc((code - 4502) * 6 + 75.0, ellps="GRS80", name=name)
    if 4513 <= code <= 4533:  # 3 degree zones 25 to 45, with prefix
        return tmerc((code - 4513) * 3 + 75.0, 1.0, (code - 4513 + 25) * 1e6 + 5e5, ellps="GRS80", name=name)
    if 4534 <= code <= 4554:
        return tmerc((code - 4534) * 3 + 75.0, ellps="GRS80", name=name)
    return None


def normalize_crs(name: str | Crs) -> Crs:
    """A system by any of its names; case, dashes, underscores and spaces don't count."""
    if isinstance(name, Crs):
        return name
    key = re.sub(r"[-_ ]", "", name).upper()
    if key in ALIASES:
        found = ALIASES[key]
        return Crs(found, KINDS[found])
    m = re.fullmatch(r"(?:EPSG:)?(\d+)", key)
    if m and (found := epsg(int(m[1]))):
        return found
    raise ValueError(f"unknown CRS: {name}")


def gauss_kruger_crs(lon: float, zone_width: int = 3, zone_prefix: bool = False) -> Crs:
    """The CGCS2000 Gauss-Krueger zone of a longitude."""
    if zone_width == 3:
        zone = math.floor(lon / 3 + 0.5)
        code = (4513 if zone_prefix else 4534) + zone - 25
        if not 25 <= zone <= 45:
            return tmerc(zone * 3.0, 1.0, zone * 1e6 + 5e5 if zone_prefix else 5e5, ellps="GRS80")
    else:
        zone = math.floor(lon / 6) + 1
        code = (4491 if zone_prefix else 4502) + zone - 13
        if not 13 <= zone <= 23:
            return tmerc(zone * 6 - 3.0, 1.0, zone * 1e6 + 5e5 if zone_prefix else 5e5, ellps="GRS80")
    return epsg(code)


def utm_crs(lon: float, lat: float) -> Crs:
    zone = min(60, max(1, math.floor((lon + 180) / 6) + 1))
    return epsg((32700 if lat < 0 else 32600) + zone)


def utm_zone(lon: Column) -> Column:
    return F.least(F.lit(60), F.greatest(F.lit(1), (F.floor((lon + 180) / 6) + 1).cast("int")))


def gauss_kruger_zone(lon: Column, zone_width: int = 3) -> Column:
    return (F.floor(lon / 3 + 0.5) if zone_width == 3 else F.floor(lon / 6) + 1).cast("int")


def _gcj_shift(lon, lat):
    m = engine(lon)
    x, y, pi = lon - 105.0, lat - 35.0, math.pi
    root = m.sqrt(m.abs(x))
    wave = (20 * m.sin(6 * x * pi) + 20 * m.sin(2 * x * pi)) * (2 / 3)
    d_lat = -100 + 2 * x + 3 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * root + wave
    d_lat = d_lat + (20 * m.sin(y * pi) + 40 * m.sin(y * (pi / 3))) * (2 / 3) + (160 * m.sin(y * (pi / 12)) + 320 * m.sin(y * (pi / 30))) * (2 / 3)
    d_lon = 300 + x + 2 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * root + wave
    d_lon = d_lon + (20 * m.sin(x * pi) + 40 * m.sin(x * (pi / 3))) * (2 / 3) + (150 * m.sin(x * (pi / 12)) + 300 * m.sin(x * (pi / 30))) * (2 / 3)
    phi = m.radians(lat)
    w = 1 - GCJ_E2 * m.sin(phi) * m.sin(phi)
    return m.degrees(d_lon * m.sqrt(w) / (GCJ_A * m.cos(phi))), m.degrees(d_lat * w * m.sqrt(w) / (GCJ_A * (1 - GCJ_E2)))


def _in_box(lon, lat):
    x0, x1, y0, y1 = GCJ_BOX
    return (lon >= x0) & (lon <= x1) & (lat >= y0) & (lat <= y1)


def wgs84_to_gcj02(lon, lat):
    m, inside = engine(lon), _in_box(lon, lat)
    dx, dy = _gcj_shift(lon, lat)
    return m.where(inside, lon + dx, lon), m.where(inside, lat + dy, lat)


def _fixed_point(lon, lat, forward):
    """The inverse of a small shift. For columns each step is a struct in a fold, so that plans stay small."""
    if not isinstance(lon, Column):
        x, y = lon, lat
        for _ in range(INVERSE_STEPS):
            fx, fy = forward(x, y)
            x, y = x + (lon - fx), y + (lat - fy)
        return x, y

    def step(acc, _):
        fx, fy = forward(acc["x"], acc["y"])
        return F.struct((acc["x"] + (lon - fx)).alias("x"), (acc["y"] + (lat - fy)).alias("y"))

    start = F.struct(lon.cast("double").alias("x"), lat.cast("double").alias("y"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(INVERSE_STEPS)), start, step)
    return found["x"], found["y"]


def gcj02_to_wgs84(lon, lat):
    m, inside = engine(lon), _in_box(lon, lat)
    x, y = _fixed_point(lon, lat, wgs84_to_gcj02)
    return m.where(inside, x, lon), m.where(inside, y, lat)


def gcj02_to_bd09(lon, lat):
    m = engine(lon)
    z = m.sqrt(lon * lon + lat * lat) + 0.00002 * m.sin(lat * BD_PI)
    t = m.atan2(lat, lon) + 0.000003 * m.cos(lon * BD_PI)
    return z * m.cos(t) + 0.0065, z * m.sin(t) + 0.006


def bd09_to_gcj02(lon, lat):
    return _fixed_point(lon, lat, gcj02_to_bd09)


def to_mercator(lon, lat):
    m = engine(lon)
    y = m.radians(m.clip(lat, -MERCATOR_LAT, MERCATOR_LAT))
    return MERCATOR_R * m.radians(lon), MERCATOR_R * m.log(m.tan(math.pi / 4 + y / 2))


def from_mercator(x, y):
    m = engine(x)
    return m.degrees(x / MERCATOR_R), m.degrees(2 * m.atan(m.exp(y / MERCATOR_R)) - math.pi / 2)


def _series(rows: list[list[float]], n: float) -> list[float]:
    """Row j holds the coefficients of n^j, n^(j+1), and so on."""
    return [sum(c * n ** (j + i) for i, c in enumerate(row)) for j, row in enumerate(rows, 1)]


# Krueger's series to the sixth order, forward and reverse.
FORWARD = [
    [1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800],
    [13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360],
    [61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440],
    [49561 / 161280, -179 / 168, 6601661 / 7257600],
    [34729 / 80640, -3418889 / 1995840],
    [212378941 / 319334400],
]
REVERSE = [
    [1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800],
    [1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720],
    [17 / 480, -37 / 840, -209 / 4480, 5569 / 90720],
    [4397 / 161280, -11 / 504, -830251 / 7257600],
    [4583 / 161280, -108847 / 3991680],
    [20648693 / 638668800],
]


def _rectifying(a: float, f: float) -> tuple[float, float]:
    n = f / (2 - f)
    return n, a / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)


def tmerc_forward(lon, lat, lon0=0.0, k0: float = 1.0, east: float = 0.0, north: float = 0.0, a: float = WGS84_A, f: float = WGS84_F):
    """Plane coordinates; ``lon0`` may be a column or array too."""
    m, e = engine(lon), math.sqrt(f * (2 - f))
    n, big_a = _rectifying(a, f)
    d, phi = m.radians(lon - lon0), m.radians(lat)
    s = m.sin(phi)
    t = m.sinh(m.atanh(s) - e * m.atanh(e * s))
    xi0, eta0 = m.atan2(t, m.cos(d)), m.asinh(m.sin(d) / m.sqrt(t * t + m.cos(d) * m.cos(d)))
    xi, eta = xi0, eta0
    for j, c in enumerate(_series(FORWARD, n), 1):
        xi = xi + c * m.sin(2 * j * xi0) * m.cosh(2 * j * eta0)
        eta = eta + c * m.cos(2 * j * xi0) * m.sinh(2 * j * eta0)
    return k0 * big_a * eta + east, k0 * big_a * xi + north


def tmerc_reverse(x, y, lon0=0.0, k0: float = 1.0, east: float = 0.0, north: float = 0.0, a: float = WGS84_A, f: float = WGS84_F):
    m, e = engine(x), math.sqrt(f * (2 - f))
    n, big_a = _rectifying(a, f)
    xi0, eta0 = (y - north) / (k0 * big_a), (x - east) / (k0 * big_a)
    xi, eta = xi0, eta0
    for j, c in enumerate(_series(REVERSE, n), 1):
        xi = xi - c * m.sin(2 * j * xi0) * m.cosh(2 * j * eta0)
        eta = eta - c * m.cos(2 * j * xi0) * m.sinh(2 * j * eta0)
    chi = m.asin(m.sin(xi) / m.cosh(eta))
    psi = m.atanh(m.sin(chi))
    if isinstance(x, Column):
        s = F.aggregate(F.sequence(F.lit(1), F.lit(8)), m.sin(chi), lambda s, _: F.tanh(psi + e * F.atanh(e * s)))
    else:
        s = m.sin(chi)
        for _ in range(8):
            s = m.tanh(psi + e * m.atanh(e * s))
    return m.degrees(m.atan2(m.sinh(eta), m.cos(xi))) + lon0, m.degrees(m.asin(s))


def _to_wgs84(c: Crs, x, y):
    if c.kind == "geographic":
        return x, y
    if c.kind == "gcj":
        return gcj02_to_wgs84(x, y)
    if c.kind == "bd":
        return gcj02_to_wgs84(*bd09_to_gcj02(x, y))
    if c.kind == "mercator":
        return from_mercator(x, y)
    return tmerc_reverse(x, y, c.lon0, c.k0, c.east, c.north, c.a, c.f)


def _from_wgs84(c: Crs, x, y):
    if c.kind == "geographic":
        return x, y
    if c.kind == "gcj":
        return wgs84_to_gcj02(x, y)
    if c.kind == "bd":
        return gcj02_to_bd09(*wgs84_to_gcj02(x, y))
    if c.kind == "mercator":
        return to_mercator(x, y)
    return tmerc_forward(x, y, c.lon0, c.k0, c.east, c.north, c.a, c.f)


def convert(x, y, source: str | Crs, target: str | Crs):
    """Coordinates in another system, as a pair of columns or arrays."""
    s, t = normalize_crs(source), normalize_crs(target)
    if s == t or {s.kind, t.kind} == {"geographic"}:
        return x, y
    if (s.kind, t.kind) == ("gcj", "bd"):
        return gcj02_to_bd09(x, y)
    if (s.kind, t.kind) == ("bd", "gcj"):
        return bd09_to_gcj02(x, y)
    return _from_wgs84(t, *_to_wgs84(s, x, y))


def convert_columns(df: DataFrame, source: str | Crs, target: str | Crs, x: str = "lon", y: str = "lat") -> DataFrame:
    """The table with its coordinate columns replaced."""
    nx, ny = convert(F.col(x), F.col(y), source, target)
    return df.withColumns({x: nx, y: ny})


def transform(geom: Column, source: str | Crs, target: str | Crs) -> Column:
    """A whole geometry in another system; nothing leaves the JVM."""
    from tellurion.functions import types as T

    return T.map_positions(geom, lambda p: T.position(*convert(p["x"], p["y"], source, target)))
