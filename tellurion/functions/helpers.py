"""Filters, samples and random features as table operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurion.functions import types as T


def sample(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, the same for the same seed and partitions."""
    return df.orderBy(F.rand(seed)).limit(n)


def random_points(spark: SparkSession, n: int, bbox=(-180.0, -90.0, 180.0, 90.0), seed: int = 0) -> DataFrame:
    x0, y0, x1, y1 = bbox
    return spark.range(n).select(F.col("id").alias("fid"), (x0 + (x1 - x0) * F.rand(seed)).alias("lon"), (y0 + (y1 - y0) * F.rand(seed + 1)).alias("lat"))


def random_lines(spark: SparkSession, n: int, vertices: int = 10, step: float = 0.0001, bbox=(-180.0, -90.0, 180.0, 90.0), seed: int = 0) -> DataFrame:
    """Walks of random steps from random starts."""
    rows = random_points(spark, n, bbox, seed)
    rows = rows.withColumn("dx", F.array(*[step * (2 * F.rand(seed + 2 + 2 * k) - 1) for k in range(vertices)])).withColumn("dy", F.array(*[step * (2 * F.rand(seed + 3 + 2 * k) - 1) for k in range(vertices)]))
    total = lambda c, k: F.aggregate(F.slice(c, F.lit(1), k), F.lit(0.0), lambda a, v: a + v)
    walk = F.transform(F.sequence(F.lit(1), F.lit(vertices)), lambda k: T.position(F.col("lon") + total(F.col("dx"), k), F.col("lat") + total(F.col("dy"), k)))
    return rows.select("fid", T.line_string(walk).alias("geom"))


def random_polygons(spark: SparkSession, n: int, vertices: int = 10, radius: float = 10.0, bbox=(-180.0, -90.0, 180.0, 90.0), seed: int = 0) -> DataFrame:
    """Star-shaped rings about random centres."""
    rows = random_points(spark, n, bbox, seed).withColumn("r", F.array(*[radius * (0.2 + 0.8 * F.rand(seed + 2 + k)) for k in range(vertices)]))
    turn = 6.283185307179586 / vertices
    ring = F.transform("r", lambda r, k: T.position(F.col("lon") + r * F.cos(k * turn), F.col("lat") + r * F.sin(k * turn)))
    return rows.select("fid", T.polygon(F.array(T.closed(ring))).alias("geom"))


def apply_filter(df: DataFrame, *tests) -> DataFrame:
    """A name asks for a value in that column, a dict for equal values; all tests must hold."""
    for t in tests:
        if isinstance(t, dict):
            for k, v in t.items():
                df = df.filter(F.col(k) == v)
        else:
            df = df.filter(F.col(t).isNotNull())
    return df


def filter_properties(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c in keys])


def coord_each(df: DataFrame, fid: str, geom: str = "geom", exclude_wrap: bool = False) -> DataFrame:
    """Each position with its part, ring and place."""
    areal = F.col(geom)["kind"].isin("Polygon", "MultiPolygon")
    rows = df.select(fid, areal.alias("_a"), F.posexplode(F.col(geom)["parts"]).alias("multi_idx", "_p")).select(fid, "_a", "multi_idx", F.posexplode("_p").alias("geom_idx", "_r"))
    ring = F.when(F.col("_a"), F.slice("_r", F.lit(1), F.size("_r") - 1)).otherwise(F.col("_r")) if exclude_wrap else F.col("_r")
    return rows.select(fid, "multi_idx", "geom_idx", F.posexplode(ring).alias("coord_idx", "p")).select(fid, "multi_idx", "geom_idx", "coord_idx", "p.x", "p.y")


def flatten_each(df: DataFrame, fid: str, geom: str = "geom") -> DataFrame:
    """Each part as a single geometry."""
    kind = F.regexp_replace(F.col(geom)["kind"], "^Multi", "")
    return df.select(fid, kind.alias("kind"), F.posexplode(F.col(geom)["parts"]).alias("multi_idx", "part")).select(fid, "multi_idx", F.struct("kind", F.array("part").alias("parts")).alias("geom"))


def find_point(df: DataFrame, fid: str, coord_idx: int, geom: str = "geom") -> DataFrame:
    """The position at an index, counted from the end if negative."""
    at = coord_idx + 1 if coord_idx >= 0 else coord_idx
    return df.select(fid, F.try_element_at(T.positions_of(F.col(geom)), F.lit(at)).alias("p"))


def find_segment(df: DataFrame, fid: str, index: int, geom: str = "geom") -> DataFrame:
    """p and q of each geometry's segment at an index over all its rings, counted from the end if negative; null beyond."""
    from tellurion.functions.measure import segments

    every = F.flatten(F.transform(T.rings_of(F.col(geom)), segments))
    at = index + 1 if index >= 0 else index
    return df.select(fid, F.try_element_at(every, F.lit(at)).alias("s")).select(fid, "s.p", "s.q")


def contains_number(c: Column) -> Column:
    """Whether an array holds finite numbers only, and any."""
    return (F.size(c) > 0) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def validate_bbox(c: Column) -> Column:
    """An array of four or six numbers, or the row fails."""
    ok = F.size(c).isin(4, 6) & contains_number(c)
    return F.when(ok, c).otherwise(F.raise_error(F.lit("a box has four or six numbers")).cast("array<double>"))


def get_coord(geom: Column) -> Column:
    """The position of a point, or the row fails."""
    return F.when(geom["kind"] == "Point", F.element_at(T.positions_of(geom), 1)).otherwise(F.raise_error(F.lit("not a point")).cast(T.POSITION))


def require_kind(geom: Column, kind: str) -> Column:
    """The geometry if it is of this kind, or the row fails."""
    return F.when(geom["kind"] == kind, geom).otherwise(F.raise_error(F.concat(F.lit(f"not a {kind}: "), geom["kind"])).cast(T.GEOMETRY))
