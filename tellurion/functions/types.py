"""Geometry columns.

A geometry is ``struct<kind, parts>``: parts hold rings, rings hold positions. A
point is one part with one ring of one position, a line one part with one ring,
a polygon one part with its shell and holes; multi-geometries have more parts.
A collection becomes several rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POSITION = "struct<x:double,y:double>"
RING = f"array<{POSITION}>"
PARTS = f"array<array<{RING}>>"
GEOMETRY = f"struct<kind:string,parts:{PARTS}>"
BBOX = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"
KINDS = ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon")


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x)) if isinstance(x, (int, float)) else F.col(x)


def position(x, y) -> Column:
    return F.struct(col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))


def ring(positions) -> Column:
    """A literal ring from (x, y) pairs of numbers or columns."""
    return F.array(*[position(x, y) for x, y in positions])


def geometry(kind: str, parts: Column) -> Column:
    if kind not in KINDS:
        raise ValueError(f"no such geometry: {kind}")
    return F.struct(F.lit(kind).alias("kind"), parts.alias("parts"))


def point(x, y) -> Column:
    return geometry("Point", F.array(F.array(F.array(position(x, y)))))


def multi_point(positions: Column) -> Column:
    return geometry("MultiPoint", F.transform(positions, lambda p: F.array(F.array(p))))


def line_string(positions: Column) -> Column:
    """At least two positions, or the row fails."""
    checked = F.when(F.size(positions) >= 2, positions).otherwise(F.raise_error(F.lit("a line needs two positions or more")).cast(RING))
    return geometry("LineString", F.array(F.array(checked)))


def multi_line_string(lines: Column) -> Column:
    return geometry("MultiLineString", F.transform(lines, lambda r: F.array(r)))


def closed(r: Column) -> Column:
    """The ring with its first position at its end."""
    return F.when(F.element_at(r, 1) == F.element_at(r, -1), r).otherwise(F.concat(r, F.slice(r, 1, 1)))


def polygon(rings: Column) -> Column:
    """Rings of at least four positions before they are closed, or the row fails."""
    checked = F.when(F.forall(rings, lambda r: F.size(r) >= 4), F.transform(rings, closed)).otherwise(F.raise_error(F.lit("a ring needs four positions or more")).cast(f"array<{RING}>"))
    return geometry("Polygon", F.array(checked))


def multi_polygon(parts: Column) -> Column:
    return geometry("MultiPolygon", parts)


def bbox_polygon(box: Column) -> Column:
    """The box as a polygon of five positions, counter-clockwise."""
    corners = [("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"), ("xmin", "ymin")]
    return geometry("Polygon", F.array(F.array(ring([(box[a], box[b]) for a, b in corners]))))


def rings_of(geom: Column) -> Column:
    """All rings, whatever part they belong to."""
    return F.flatten(geom["parts"])


def positions_of(geom: Column) -> Column:
    """All positions in order."""
    return F.flatten(rings_of(geom))


def open_positions(geom: Column) -> Column:
    """All positions without the closing one of each polygon ring."""
    areal = geom["kind"].isin("Polygon", "MultiPolygon")
    return F.flatten(F.transform(rings_of(geom), lambda r: F.when(areal, F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(0)))).otherwise(r)))


def map_positions(geom: Column, f) -> Column:
    """Every position through ``f(p) -> p``."""
    parts = F.transform(geom["parts"], lambda part: F.transform(part, lambda r: F.transform(r, f)))
    return F.struct(geom["kind"].alias("kind"), parts.alias("parts"))


def map_rings(geom: Column, f) -> Column:
    """Every ring through ``f(ring, number in its part) -> ring``."""
    return F.struct(geom["kind"].alias("kind"), F.transform(geom["parts"], lambda part: F.transform(part, f)).alias("parts"))


def bbox(geom: Column) -> Column:
    ps = positions_of(geom)
    xs, ys = F.transform(ps, lambda p: p["x"]), F.transform(ps, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))
