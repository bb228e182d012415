"""GeoJSON in and out: a row per feature, with an id that keeps the collection's order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurion.functions import types as T

#: How deep each kind's coordinates nest: wrapped up to parts, rings and positions.
DEPTH = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}


def _positions(text: Column, kind: str) -> Column:
    depth = DEPTH[kind]
    raw = F.from_json(text, "array<" * depth + "array<double>" + ">" * depth)
    p = lambda a: T.position(F.element_at(a, 1), F.element_at(a, 2))
    if kind == "Point":
        return F.array(F.array(F.array(p(raw))))
    if kind == "MultiPoint":
        return F.transform(raw, lambda a: F.array(F.array(p(a))))
    if kind == "LineString":
        return F.array(F.array(F.transform(raw, p)))
    if kind == "MultiLineString":
        return F.transform(raw, lambda r: F.array(F.transform(r, p)))
    if kind == "Polygon":
        return F.array(F.transform(raw, lambda r: F.transform(r, p)))
    return F.transform(raw, lambda part: F.transform(part, lambda r: F.transform(r, p)))


def from_geojson(text: Column) -> Column:
    """A geometry from the JSON text of one; null for a collection or what isn't one."""
    kind, coords = F.get_json_object(text, "$.type"), F.get_json_object(text, "$.coordinates")
    out = F.lit(None).cast(T.PARTS)
    for k in DEPTH:
        out = F.when(kind == k, _positions(coords, k)).otherwise(out)
    return F.when(kind.isin(list(DEPTH)) & coords.isNotNull(), F.struct(kind.alias("kind"), out.alias("parts")))


def parse_features(df: DataFrame, text: str = "value") -> DataFrame:
    """fid, member, id, properties (map of text) and geom for each geometry of each document.

    Documents are collections, features or bare geometries; a geometry
    collection gives a row for each member. ``fid`` counts features in order.
    """
    doc = F.col(text)
    kind = F.get_json_object(doc, "$.type")
    features = F.when(kind == "FeatureCollection", F.from_json(F.get_json_object(doc, "$.features"), "array<string>")).when(kind == "Feature", F.array(doc)).otherwise(F.array(F.concat(F.lit('{"type":"Feature","geometry":'), doc, F.lit("}"))))
    rows = df.select(F.posexplode(features).alias("fid", "f"))
    g = F.get_json_object("f", "$.geometry")
    members = F.when(F.get_json_object(g, "$.type") == "GeometryCollection", F.from_json(F.get_json_object(g, "$.geometries"), "array<string>")).otherwise(F.array(g))
    rows = rows.select("fid", F.get_json_object("f", "$.id").alias("id"), F.from_json(F.get_json_object("f", "$.properties"), "map<string,string>").alias("properties"), F.posexplode_outer(members).alias("member", "g"))
    return rows.select(F.col("fid").cast("long").alias("fid"), "member", "id", "properties", from_geojson(F.col("g")).alias("geom"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Each file is one document."""
    return parse_features(spark.read.text(path, wholetext=True))


def to_geojson(geom: Column) -> Column:
    """The JSON text of a geometry."""
    xy = lambda p: F.array(p["x"], p["y"])
    ring = lambda r: F.transform(r, xy)
    parts = geom["parts"]
    one = F.element_at(parts, 1)
    forms = {
        "Point": F.to_json(xy(F.element_at(F.element_at(one, 1), 1))),
        "MultiPoint": F.to_json(F.transform(parts, lambda p: xy(F.element_at(F.element_at(p, 1), 1)))),
        "LineString": F.to_json(ring(F.element_at(one, 1))),
        "MultiLineString": F.to_json(F.transform(parts, lambda p: ring(F.element_at(p, 1)))),
        "Polygon": F.to_json(F.transform(one, ring)),
        "MultiPolygon": F.to_json(F.transform(parts, lambda p: F.transform(p, ring))),
    }
    coords = F.lit(None).cast("string")
    for k, v in forms.items():
        coords = F.when(geom["kind"] == k, v).otherwise(coords)
    return F.concat(F.lit('{"type":"'), geom["kind"], F.lit('","coordinates":'), coords, F.lit("}"))


def write_features(df: DataFrame, path: str, geom: str = "geom") -> None:
    """A feature on each line; other columns are its properties."""
    props = F.to_json(F.struct(*[c for c in df.columns if c != geom]))
    df.select(F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":'), to_geojson(F.col(geom)), F.lit("}")).alias("value")).write.text(path)
