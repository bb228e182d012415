"""Predicates and changes of shape that are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tellurion.functions import types as T
from tellurion.functions.measure import segments


def signed_turn(r: Column) -> Column:
    """Twice the shoelace sum with the sign of a clockwise ring."""
    return F.aggregate(segments(r), F.lit(0.0), lambda acc, s: acc + (s["q"]["x"] - s["p"]["x"]) * (s["q"]["y"] + s["p"]["y"]))


def boolean_clockwise(r: Column) -> Column:
    return signed_turn(T.closed(r)) > 0


def boolean_counter_clockwise(r: Column) -> Column:
    return ~boolean_clockwise(r)


def boolean_concave(geom: Column) -> Column:
    """Whether a polygon's shell turns both ways."""
    shell = T.closed(F.element_at(F.element_at(geom["parts"], 1), 1))
    s = segments(shell)
    after = F.concat(F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, 1, 1))
    turns = F.zip_with(s, after, lambda a, b: (a["q"]["x"] - a["p"]["x"]) * (b["q"]["y"] - b["p"]["y"]) - (a["q"]["y"] - a["p"]["y"]) * (b["q"]["x"] - b["p"]["x"]))
    return F.exists(turns, lambda t: t > 0) & F.exists(turns, lambda t: t < 0)


def on_segment(s: Column, x: Column, y: Column) -> Column:
    cross = (s["q"]["x"] - s["p"]["x"]) * (y - s["p"]["y"]) - (s["q"]["y"] - s["p"]["y"]) * (x - s["p"]["x"])
    return (cross == 0) & x.between(F.least(s["p"]["x"], s["q"]["x"]), F.greatest(s["p"]["x"], s["q"]["x"])) & y.between(F.least(s["p"]["y"], s["q"]["y"]), F.greatest(s["p"]["y"], s["q"]["y"]))


def in_ring(r: Column, x: Column, y: Column) -> Column:
    """Even-odd ray cast; the boundary is dealt with by the caller."""
    def crosses(s: Column) -> Column:
        p, q = s["p"], s["q"]
        return ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.when(q["y"] == p["y"], 1.0).otherwise(q["y"] - p["y"]) + p["x"])

    return F.size(F.filter(segments(r), crosses)) % 2 == 1


def point_in_polygon(x: Column, y: Column, geom: Column, ignore_boundary: bool = False) -> Column:
    """Inside any part and in none of its holes; the boundary counts as inside unless it is ignored."""
    edge = F.exists(T.rings_of(geom), lambda r: F.exists(segments(r), lambda s: on_segment(s, x, y)))
    inside = F.exists(geom["parts"], lambda p: in_ring(F.element_at(p, 1), x, y) & ~F.exists(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda r: in_ring(r, x, y)))
    return inside & ~edge if ignore_boundary else inside | edge


def boxes_meet(a: Column, b: Column) -> Column:
    return (a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"]) & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"])


def segment_crossing(s: Column, t: Column) -> Column:
    """Where two segments meet in one point, touching included; null for none and for parallel ones."""
    rx, ry, sx, sy = s["q"]["x"] - s["p"]["x"], s["q"]["y"] - s["p"]["y"], t["q"]["x"] - t["p"]["x"], t["q"]["y"] - t["p"]["y"]
    d = rx * sy - ry * sx
    dx, dy = t["p"]["x"] - s["p"]["x"], t["p"]["y"] - s["p"]["y"]
    safe = F.when(d != 0, d)
    a, b = (dx * sy - dy * sx) / safe, (dx * ry - dy * rx) / safe
    return F.when(a.between(0, 1) & b.between(0, 1), T.position(s["p"]["x"] + a * rx, s["p"]["y"] + a * ry))


def flip(geom: Column) -> Column:
    return T.map_positions(geom, lambda p: T.position(p["y"], p["x"]))


def truncate(geom: Column, precision: int = 6) -> Column:
    return T.map_positions(geom, lambda p: T.position(F.round(p["x"], precision), F.round(p["y"], precision)))


def rewind(geom: Column) -> Column:
    """Shells counter-clockwise, holes clockwise."""
    areal = geom["kind"].isin("Polygon", "MultiPolygon")
    return T.map_rings(geom, lambda r, i: F.when(areal & (boolean_clockwise(r) == (i == 0)), F.reverse(r)).otherwise(r))


def clean_coords(geom: Column) -> Column:
    """Positions equal to the one before are left out; collinear ones stay."""
    def clean(r: Column, i: Column) -> Column:
        return F.filter(r, lambda p, k: (k == 0) | ~(p == F.element_at(r, F.greatest(k, F.lit(1)))))

    return T.map_rings(geom, clean)


def polygon_to_line(geom: Column) -> Column:
    return F.struct(F.lit("MultiLineString").alias("kind"), F.transform(T.rings_of(geom), lambda r: F.array(r)).alias("parts"))


def line_to_polygon(geom: Column) -> Column:
    """Closed rings of four positions and more; the first is the shell."""
    rings = F.filter(F.transform(T.rings_of(geom), T.closed), lambda r: F.size(r) >= 4)
    return F.struct(F.lit("MultiPolygon").alias("kind"), F.array(rings).alias("parts"))


def snap_round(geom: Column, grid: float, forward, back) -> Column:
    """Positions to the nearest node of a metric grid in the plane of ``forward`` and ``back``; repeats are left out."""
    def snapped(p: Column) -> Column:
        x, y = forward(p["x"], p["y"])
        x, y = back(F.round(x / grid) * grid, F.round(y / grid) * grid)
        return T.position(x, y)

    return clean_coords(T.map_positions(geom, snapped))


def relate_pattern(matrix: Column, pattern: str) -> Column:
    """Whether a DE-9IM matrix fits a pattern of 0, 1, 2, T, F and *."""
    if len(pattern) != 9 or set(pattern.upper()) - set("012TF*"):
        raise ValueError(f"no DE-9IM pattern: {pattern}")
    return F.rlike(matrix, F.lit("^" + "".join({"T": "[012]", "*": "."}.get(c, c) for c in pattern.upper()) + "$"))


# The patterns of the named relations; those that depend on dimensions are by (dim a, dim b).
RELATIONS = {
    "disjoint": ["FF*FF****"], "contains": ["T*****FF*"], "within": ["T*F**F***"], "equals": ["T*F**FFF*"],
    "covers": ["T*****FF*", "*T****FF*", "***T**FF*", "****T*FF*"], "coveredby": ["T*F**F***", "*TF**F***", "**FT*F***", "**F*TF***"],
    "touches": ["FT*******", "F**T*****", "F***T****"],
}


def boolean_relation(matrix: Column, name: str, dim_a: Column | int, dim_b: Column | int) -> Column:
    """A named relation from a DE-9IM matrix and the two dimensions."""
    key = name.lower().replace("-", "").replace("boolean", "")
    a, b = (d if isinstance(d, Column) else F.lit(d) for d in (dim_a, dim_b))
    fits = lambda *ps: _any([relate_pattern(matrix, p) for p in ps])
    if key == "intersects":
        return ~fits(*RELATIONS["disjoint"])
    if key in ("overlap", "overlaps"):
        return (a == b) & F.when(a == 1, fits("1*T***T**")).otherwise(fits("T*T***T**"))
    if key == "crosses":
        return F.when(a < b, fits("T*T******")).when(a > b, fits("T*****T**")).when(a == 1, fits("0********")).otherwise(F.lit(False))
    if key == "equal":
        key = "equals"
    if key not in RELATIONS:
        raise ValueError(f"no such relation: {name}")
    return fits(*RELATIONS[key])


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def planepoint(x: Column, y: Column, corners: list[tuple[Column, Column, Column]]) -> Column:
    """The value at a point on the plane through three corners (x, y, z) in plane coordinates."""
    (x1, y1, z1), (x2, y2, z2), (x3, y3, z3) = corners
    d = (y2 - y3) * (x1 - x3) + (x3 - x2) * (y1 - y3)
    u, v = ((y2 - y3) * (x - x3) + (x3 - x2) * (y - y3)) / d, ((y3 - y1) * (x - x3) + (x1 - x3) * (y - y3)) / d
    return u * z1 + v * z2 + (1 - u - v) * z3
