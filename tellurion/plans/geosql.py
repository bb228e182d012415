"""Geodesics in SQL, for the queries' SQL: the auxiliary sphere's triangle, corrected until it settles.

Longitude on the sphere is found by repetition, and lengths, longitudes and areas
by a 16-point rule over the arc. The columns solve the same problems by a search
for the azimuth, so the two agree only if both are right. Arcs here are shorter
than a quarter of the earth.
"""

from __future__ import annotations

import math

import numpy as np

A, FLAT = 6378137.0, 1 / 298.257223563
B, E2 = A * (1 - FLAT), FLAT * (2 - FLAT)
EP2 = E2 / (1 - E2)
_NODES = list(zip(*np.polynomial.legendre.leggauss(16), strict=True))
D = "::DOUBLE"


def num(x: float) -> str:
    return f"({float(x)!r}{D})"


def integral(f, lo: str, hi: str) -> str:
    """Of ``f(node)`` from lo to hi."""
    terms = " + ".join(f"{num(w)} * ({f(f'(({hi} + {lo}) / 2 + ({hi} - {lo}) / 2 * {num(x)})')})" for x, w in _NODES)
    return f"(({hi} - {lo}) / 2 * ({terms}))"


def _root(t: str) -> str:
    return f"sqrt(1 + k2 * sin{t} * sin{t})"


def _longitude(t: str) -> str:
    return f"{num(2 - FLAT)} / (1 + {num(1 - FLAT)} * {_root(t)})"


def zone(s: str) -> str:
    """Area from the equator to the latitude of this sine, for a radian of longitude."""
    e = math.sqrt(E2)
    return f"({num(B * B / 2)} * ({s} / (1 - {num(E2)} * {s} * {s}) + atanh({num(e)} * {s}) / {num(e)}))"


def _strip(t: str) -> str:
    b = f"(ca0 * sin{t})"
    c2 = f"(1 - {b} * {b})"
    sine = f"({b} / sqrt({b} * {b} + {num((1 - FLAT) ** 2)} * {c2}))"
    return f"{zone(sine)} * sa0 * (1 / {c2} - {num(FLAT)} * {_longitude(t)})"


def _table(name: str, body: str) -> str:
    """Each step is a table of its own; merged steps would repeat their expressions without end."""
    return f"{name} AS MATERIALIZED ({body})"


def inverse(source: str, name: str, rounds: int = 9, area: bool = False) -> str:
    """Tables that end in ``name``: source(lon1, lat1, lon2, lat2, ..) with s12, az1, az2 and, if asked for, strip."""
    n = name
    out = [_table(f"{n}_0", f"SELECT *, atan({num(1 - FLAT)} * tan(radians(lat1))) AS b1, atan({num(1 - FLAT)} * tan(radians(lat2))) AS b2, radians(lon2 - lon1) AS lam, radians(lon2 - lon1) AS om FROM {source}")]
    extra = "ea, no, ss, sa0, ca1, sa1, ca0, k2, s1, s2"

    def triangle(k: int) -> list[str]:
        """The spherical triangle for the longitude ``om``, a few columns at a time."""
        return [
            _table(f"{n}_{k}a", f"SELECT *, cos(b2) * sin(om) AS ea, cos(b1) * sin(b2) - sin(b1) * cos(b2) * cos(om) AS no FROM {n}_{k}"),
            _table(f"{n}_{k}b", f"SELECT *, sqrt(ea * ea + no * no) AS ss FROM {n}_{k}a"),
            _table(f"{n}_{k}c", f"SELECT *, CASE WHEN ss = 0 THEN 0 ELSE cos(b1) * ea / ss END AS sa0, CASE WHEN ss = 0 THEN 1 ELSE no / ss END AS ca1, CASE WHEN ss = 0 THEN 0 ELSE ea / ss END AS sa1 FROM {n}_{k}b"),
            _table(f"{n}_{k}d", f"SELECT *, sqrt(ca1 * ca1 + power(sa1 * sin(b1), 2)) AS ca0, atan2(sin(b1), cos(b1) * ca1) AS s1 FROM {n}_{k}c"),
            _table(f"{n}_{k}t", f"SELECT *, {num(EP2)} * ca0 * ca0 AS k2, s1 + atan2(ss, sin(b1) * sin(b2) + cos(b1) * cos(b2) * cos(om)) AS s2 FROM {n}_{k}d"),
        ]

    for k in range(rounds):
        out += triangle(k)
        out.append(_table(f"{n}_{k + 1}", f"SELECT * EXCLUDE (om, {extra}), lam + {num(FLAT)} * sa0 * {integral(_longitude, 's1', 's2')} AS om FROM {n}_{k}t"))
    out += triangle(rounds)
    strip = f", {integral(_strip, 's1', 's2')} AS strip" if area else ""
    az2 = "degrees(atan2(cos(b1) * sin(om), cos(b1) * sin(b2) * cos(om) - sin(b1) * cos(b2)))"
    out.append(_table(n, f"SELECT * EXCLUDE (b1, b2, lam, om, {extra}), CASE WHEN ss = 0 THEN 0 ELSE {num(B)} * {integral(_root, 's1', 's2')} END AS s12, degrees(atan2(ea, no)) AS az1, {az2} AS az2{strip} FROM {n}_{rounds}t"))
    return ", ".join(out)


def direct(source: str, name: str, rounds: int = 6) -> str:
    """Tables that end in ``name``: source(lon1, lat1, az, s, ..) with x and y, where a geodesic of s metres ends."""
    n = name
    out = [
        _table(f"{n}_a", f"SELECT *, atan({num(1 - FLAT)} * tan(radians(lat1))) AS b1 FROM {source}"),
        _table(f"{n}_b", f"SELECT *, sin(radians(az)) * cos(b1) AS sa0, sqrt(power(cos(radians(az)), 2) + power(sin(radians(az)) * sin(b1), 2)) AS ca0, atan2(sin(b1), cos(radians(az)) * cos(b1)) AS s1 FROM {n}_a"),
        _table(f"{n}_0", f"SELECT *, {num(EP2)} * ca0 * ca0 AS k2, s1 + s / ({num(B)} * sqrt(1 + {num(EP2)} * ca0 * ca0 / 2)) AS s2 FROM {n}_b"),
    ]
    for k in range(rounds):
        out.append(_table(f"{n}_{k + 1}", f"SELECT * EXCLUDE (s2), s2 + (s / {num(B)} - {integral(_root, 's1', 's2')}) / {_root('(s2)')} AS s2 FROM {n}_{k}"))
    out.append(_table(f"{n}_z", f"SELECT *, atan2(sa0 * sin(s2), cos(s2)) - atan2(sa0 * sin(s1), cos(s1)) AS turn FROM {n}_{rounds}"))
    out.append(_table(n, f"""SELECT * EXCLUDE (b1, sa0, ca0, k2, s1, s2, turn), lon1 + degrees(turn - {num(2 * math.pi)} * round(turn / {num(2 * math.pi)}) - {num(FLAT)} * sa0 * {integral(_longitude, 's1', 's2')}) AS x,
  degrees(atan2(ca0 * sin(s2), {num(1 - FLAT)} * sqrt(sa0 * sa0 + power(ca0 * cos(s2), 2)))) AS y FROM {n}_z"""))
    return ", ".join(out)
