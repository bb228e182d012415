"""Areas prepared for many points: cells that lie inside, and cells that the boundary passes with the edges that it has there.

An area gets about as many cells as it has edges. Where its boundary stands at
the middle of a row of cells is summed along the row, so each cell that the boundary
passes knows whether its left side is inside there, and the cells between are
inside or outside as a whole. A point in an inner cell needs no test; one in
a boundary cell is held against that cell's edges only: up or down the cell's
left side from the row's middle to the point's height, then across to the point.

Areas are even-odd over all their parts, so parts that overlap cancel. Cells are shifted by
an odd fraction, so that coordinates in round numbers don't lie on their sides.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellurion.functions.shapes import on_segment
from tellurion.operators.joins import fresh, segment_rows
from tellurion.session import land

SHIFT = 0.3713906763541037


class Prepared(NamedTuple):
    """Landed cells of areas: ``inner`` (id, level, i, j) and ``edge`` (the same with left, whether its left side is inside, and its edges)."""

    inner: DataFrame
    edge: DataFrame
    levels: list[int]


def _at(x: Column, size: Column) -> Column:
    return F.floor(x / size - SHIFT).cast("long")


def _line(i: Column, size: Column) -> Column:
    return (i + SHIFT) * size


def prepare(areas: DataFrame, area_id: str, geom: str = "geom") -> Prepared:
    """Cells of every area; ids must be unique. Null and empty areas have none."""
    segs = segment_rows(areas, area_id, geom, "s").select(F.col(area_id).alias("id"), "s", "s_box")
    about = segs.groupBy(F.col("id").alias("id2")).agg(F.count(F.lit(1)).alias("n"), F.min("s_box.xmin").alias("x0"), F.min("s_box.ymin").alias("y0"), F.max("s_box.xmax").alias("x1"), F.max("s_box.ymax").alias("y1"))
    extent = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1e-9))
    about = about.select("id2", F.ceil(F.log2(extent / F.sqrt("n"))).cast("int").alias("level"))
    segs = segs.join(about, F.col("id") == F.col("id2")).drop("id2").withColumn("size", F.pow(F.lit(2.0), F.col("level")))
    segs = land(segs)
    p, q, size = F.col("s.p"), F.col("s.q"), F.col("size")
    rows = segs.withColumn("i", F.explode(F.sequence(_at(F.col("s_box.xmin"), size), _at(F.col("s_box.xmax"), size)))).withColumn("j", F.explode(F.sequence(_at(F.col("s_box.ymin"), size), _at(F.col("s_box.ymax"), size))))
    # The edge's line passes the cell, or comes as near as rounding.
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    mx, my = _line(F.col("i") + 0.5, size), _line(F.col("j") + 0.5, size)
    meets = F.abs(dx * (my - p["y"]) - dy * (mx - p["x"])) <= (F.abs(dx) + F.abs(dy)) * size * 0.5 * (1 + 1e-9)
    cells = rows.filter(meets).groupBy("id", "level", "i", "j").agg(F.collect_list("s").alias("edges"))
    # Where edges cross the middles of rows.
    mid = _line(F.col("j") + 0.5, size)
    across = segs.withColumn("j", F.explode(F.sequence(_at(F.col("s_box.ymin"), size), _at(F.col("s_box.ymax"), size)))).filter((p["y"] > mid) != (q["y"] > mid))
    at = p["x"] + dx * ((mid - p["y"]) / dy)
    counts = across.groupBy("id", "level", _at(at, size).alias("i"), "j").agg(F.count(F.lit(1)).alias("m"))
    both = cells.join(counts, ["id", "level", "i", "j"], "left").withColumn("m", F.coalesce("m", F.lit(0)))
    by = Window.partitionBy("id", "level", "j").orderBy("i")
    both = land(both.withColumns({"sum": F.sum("m").over(by), "next": F.lead("i").over(by)}))
    inner = both.filter("sum % 2 = 1 and next > i + 1").select("id", "level", F.explode(F.sequence(F.col("i") + 1, F.col("next") - 1)).alias("i"), "j")
    edge = both.select("id", "level", "i", "j", ((F.col("sum") - F.col("m")) % 2 == 1).alias("left"), "edges")
    levels = sorted(r["level"] for r in about.select("level").distinct().collect())
    return Prepared(land(inner), land(edge), levels)


def contained(points: DataFrame, prepared: Prepared, area_id: str, x: str = "lon", y: str = "lat", ignore_boundary: bool = False) -> DataFrame:
    """Points with the id of each prepared area that they are in; a null coordinate is in none."""
    name = fresh(points)
    m, i, j = name("level"), name("i"), name("j")
    own = points.withColumn(m, F.explode(F.array(*map(F.lit, prepared.levels)).cast("array<int>")))
    size = F.pow(F.lit(2.0), F.col(m))
    own = own.withColumns({i: _at(F.col(x), size), j: _at(F.col(y), size)})

    def met(cells: DataFrame) -> DataFrame:
        return own.join(cells, (own[m] == cells["level"]) & (own[i] == cells["i"]) & (own[j] == cells["j"]))

    keep = [F.col(c) for c in points.columns]
    inner = met(prepared.inner).select(*(own[c] for c in points.columns), prepared.inner["id"].alias(area_id))
    # What the cells bring has names of its own.
    there = {c: name(f"c_{c}") for c in ("id", "level", "i", "j", "left", "edges")}
    edge = prepared.edge.select(*(F.col(c).alias(n) for c, n in there.items()))
    pairs = own.join(edge, (own[m] == edge[there["level"]]) & (own[i] == edge[there["i"]]) & (own[j] == edge[there["j"]]))
    px, py = F.col(x), F.col(y)
    lx, ly = _line(F.col(i).cast("double"), size), _line(F.col(j) + 0.5, size)

    def side(e: Column, a: Column, b: Column) -> Column:
        """Whether a place is on the left of an edge, rounded as a ray cast rounds it; one at a flat edge's height is above it, as rays have it."""
        p, q = e["p"], e["q"]
        return F.when(q["y"] == p["y"], b >= p["y"]).otherwise(a < (q["x"] - p["x"]) * (b - p["y"]) / (q["y"] - p["y"]) + p["x"])

    def crosses(e: Column) -> Column:
        up = ((e["p"]["x"] > lx) != (e["q"]["x"] > lx)) & (side(e, lx, ly) != side(e, lx, py))
        over = ((e["p"]["y"] > py) != (e["q"]["y"] > py)) & (side(e, lx, py) != side(e, px, py))
        return up.cast("int") + over.cast("int")

    turns = F.aggregate(there["edges"], F.lit(0), lambda n, e: n + crosses(e)) % 2 == 1
    inside = F.col(there["left"]) != turns
    on = F.exists(there["edges"], lambda e: on_segment(e, px, py))
    pairs = pairs.filter(inside & ~on if ignore_boundary else inside | on).select(*keep, F.col(there["id"]).alias(area_id))
    return inner.unionByName(pairs)
