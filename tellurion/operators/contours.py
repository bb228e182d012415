"""Contour lines over a lattice of heights that is a table.

Nodes find their neighbours by joins on their places in the lattice, each cell is cut
in two triangles, and where a level crosses a triangle is a column. A crossing is
known by the lattice edge that it lies on, which two triangles share at most; so
segments link into chains by those edges, exactly, and a chain is gathered only
for its own row. No task holds a lattice or a level.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellurion.functions import types as T
from tellurion.operators.tables import components
from tellurion.session import land, ship


def lattice(df: DataFrame, key: str, x: str = "lon", y: str = "lat", z: str = "z") -> DataFrame:
    """key, i, j, x, y, z: nodes with their places, by the smallest step between the coordinates of each key.

    Steps within 1e-9 of the span are none. Nodes with nulls are holes.
    """
    rows = df.select(F.col(key).alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(z).cast("double").alias("z")).dropna(subset=["x", "y", "z"])
    out = rows
    for c, at in (("x", "i"), ("y", "j")):
        # As many coordinates as a lattice has columns.
        some = rows.select("key", c).distinct().withColumn("gap", F.col(c) - F.lag(c).over(Window.partitionBy("key").orderBy(c)))
        span = rows.groupBy(F.col("key").alias("of")).agg(F.min(c).alias("first"), (F.max(c) - F.min(c)).alias("span"))
        step = some.join(span, F.col("key").eqNullSafe(F.col("of"))).filter(F.col("gap") > 1e-9 * F.col("span")).groupBy("of", "first").agg(F.min("gap").alias("step"))
        step = span.select("of", "first").join(step.select(F.col("of").alias("of2"), "step"), F.col("of").eqNullSafe(F.col("of2")), "left").drop("of2")
        out = out.join(step, F.col("key").eqNullSafe(F.col("of"))).withColumn(at, F.coalesce(F.round((F.col(c) - F.col("first")) / F.col("step")), F.lit(0.0)).cast("long")).drop("of", "first", "step")
    return out.groupBy("key", "i", "j").agg(F.min(F.struct("x", "y", "z")).alias("n")).select("key", "i", "j", "n.x", "n.y", "n.z")


def triangles(nodes: DataFrame) -> DataFrame:
    """key, and three nodes a, b, c of each half of each cell; a is the lower left, c the upper right one."""
    node = lambda p, i=0, j=0: nodes.select(F.col("key").alias(f"{p}_key"), (F.col("i") - i).alias(f"{p}_i"), (F.col("j") - j).alias(f"{p}_j"), F.struct("i", "j", "x", "y", "z").alias(p))
    same = lambda p, q: F.col(f"{p}_key").eqNullSafe(F.col(f"{q}_key")) & (F.col(f"{p}_i") == F.col(f"{q}_i")) & (F.col(f"{p}_j") == F.col(f"{q}_j"))
    across = node("a").join(node("c", 1, 1), same("a", "c"))
    halves = [across.join(node("b", i, j), same("a", "b")).select(F.col("a_key").alias("key"), "a", "b", "c") for i, j in ((1, 0), (0, 1))]
    return halves[0].unionByName(halves[1])


def segments(nodes: DataFrame, breaks: list[float]) -> DataFrame:
    """key, level and the two crossings of each triangle that a level crosses: the lattice edge (i, j, di, dj) and x, y.

    A node at the level counts as above it.
    """
    rows = triangles(nodes).withColumn("level", F.explode(F.array(*[F.lit(float(b)) for b in breaks])))
    level = F.col("level")

    def crossing(p: Column, q: Column) -> Column:
        """``p`` comes before ``q`` in the lattice, so both triangles of an edge reckon alike."""
        t = (level - p["z"]) / (q["z"] - p["z"])
        edge = F.struct(p["i"].alias("i"), p["j"].alias("j"), (q["i"] - p["i"]).alias("di"), (q["j"] - p["j"]).alias("dj"))
        return F.when((p["z"] >= level) != (q["z"] >= level), F.struct(edge.alias("edge"), (p["x"] + t * (q["x"] - p["x"])).alias("x"), (p["y"] + t * (q["y"] - p["y"])).alias("y")))

    a, b, c = F.col("a"), F.col("b"), F.col("c")
    found = rows.select("key", "level", F.array_compact(F.array(crossing(a, b), crossing(b, c), crossing(a, c))).alias("at")).filter(F.size("at") == 2)
    return found.select("key", "level", F.element_at("at", 1).alias("p"), F.element_at("at", 2).alias("q"))


def isolines(df: DataFrame, key: str, breaks: list[float], x: str = "lon", y: str = "lat", z: str = "z") -> DataFrame:
    """The key, level, chain (the least edge on it) and a line for each contour; rings end where they begin.

    A level that crosses nothing has no row; an empty table or no breaks give an empty result.
    """
    kind = dict(df.dtypes)[key]
    if not breaks:
        return df.limit(0).select(F.col(key), F.lit(0.0).alias("level"), F.lit("").alias("chain"), F.lit(None).cast(T.GEOMETRY).alias("geom"))
    segs = land(segments(land(lattice(df, key, x, y, z)), breaks))
    name = lambda p: F.concat_ws("/", F.coalesce(F.col("key").cast("string"), F.lit("\0")), F.col("level").cast("string"), *(F.col(f"{p}.edge.{c}").cast("string") for c in ("i", "j", "di", "dj")))
    segs = segs.withColumns({"a": name("p"), "b": name("q")})
    label = components(segs.select("a", "b"))
    rows = segs.join(label, segs["a"] == label["id"]).select("key", "level", "root", "a", "b", F.col("p.x").alias("px"), F.col("p.y").alias("py"), F.col("q.x").alias("qx"), F.col("q.y").alias("qy"))

    def run(k, pdf: pd.DataFrame) -> pd.DataFrame:
        place, links = {}, {}
        for a, b, px, py, qx, qy in zip(*(pdf[c] for c in ("a", "b", "px", "py", "qx", "qy")), strict=True):
            place[a], place[b] = (px, py), (qx, qy)
            links.setdefault(a, []).append(b)
            links.setdefault(b, []).append(a)
        # A chain begins at its lesser end, a ring at its least edge.
        ends = sorted(n for n, to in links.items() if len(to) == 1)
        start = ends[0] if ends else min(links)
        at, before, line = start, None, [place[start]]
        while True:
            to = links[at]
            after = to[0] if len(to) == 1 or to[0] != before else to[1]
            if (len(to) == 1 and before is not None) or after == start:
                break
            before, at = at, after
            if place[at] != line[-1]:
                line.append(place[at])
        if not ends and line[0] != line[-1]:
            line.append(line[0])
        geom = {"kind": "LineString", "parts": [[[{"x": float(u), "y": float(v)} for u, v in line]]]} if len(line) > 1 else None
        return pd.DataFrame({key: [k[0]], "level": [k[1]], "chain": [k[2]], "geom": [geom]})

    ship()
    out = rows.groupBy("key", "level", "root").applyInPandas(run, f"`{key}` {kind}, level double, chain string, geom {T.GEOMETRY}")
    # A contour that touches one node alone is a point.
    return out.filter("geom is not null")
