"""Pairs of points within a rhumb distance, cell by cell as arrays, or sums over them without listing them.

A left point is listed under the cells that its circle meets, a right point under its own; rows are
dealt by cell and sorted, and a crowded cell is dealt out in blocks of its left points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tellurion.functions import measure
from tellurion.operators import segments
from tellurion.operators.segments import AT_ONCE, BLOCK, CELL
from tellurion.session import ship

PLACE = ("lam", "phi", "psi", "arc", "round")


def _rows(left: DataFrame, right: DataFrame, a: Column, b: Column, radius: float, l: tuple[str, str], r: tuple[str, str]) -> DataFrame:
    """Both sides' rows by cell; ``a`` and ``b`` are structs of what they bring."""
    from tellurion.operators.joins import halvings, level_of, levels_in_use, listed, placed, reach

    ship()
    x, y = (F.col(c).cast("double") for c in l)
    dx, dy = reach(y, radius)
    box = F.struct((x - dx).alias("xmin"), (y - dy).alias("ymin"), (x + dx).alias("xmax"), (y + dy).alias("ymax"))
    one = left.filter(x.isNotNull() & y.isNotNull()).select(a.alias("_a"), x.alias("_x"), y.alias("_y"), dx.alias("_dx"), dy.alias("_dy"), box.alias("_box"), measure.rhumb_place(x, y).alias("_p"))
    one = one.withColumn("_l", level_of(F.col("_box")) - halvings(right, radius, *r))
    levels = levels_in_use(one.select("_l")) or [0]
    one = listed(one, "_box", F.col("_l"), CELL[:3])
    # Cells of the box that the circle doesn't come near are left out, but for those about a pole.
    side = F.pow(F.lit(2.0), F.col("_m"))
    off = lambda c, v, most: F.greatest(F.lit(0.0), F.col(c) * side - F.col(v), F.col(v) - (F.col(c) + 1) * side) / F.col(most)
    one = one.filter((off("_cx", "_x", "_dx") ** 2 + off("_cy", "_y", "_dy") ** 2 <= 1 + 1e-9) | (F.col("_dx") > 60) | (F.abs("_y") > 80))
    u, v = (F.col(c).cast("double") for c in r)
    two = right.filter(u.isNotNull() & v.isNotNull()).select(b.alias("_o"), u.alias("_x"), v.alias("_y"), measure.rhumb_place(u, v).alias("_p"))
    two = placed(two, "_x", "_y", levels, CELL[:3])
    crowd = one.groupBy(*CELL[:3]).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > BLOCK)
    crowd = F.broadcast(crowd.select(*CELL[:3], F.ceil(F.col("_n") / BLOCK).cast("int").alias("_k")))
    blocks = F.coalesce("_k", F.lit(1))
    one = one.join(crowd, list(CELL[:3]), "left").withColumn("_b", F.pmod(F.xxhash64("_x", "_y"), blocks).cast("int"))
    two = two.join(crowd, list(CELL[:3]), "left").withColumn("_b", F.explode(F.sequence(F.lit(0), blocks - 1)))
    place = [F.col("_p")[c].alias(c) for c in PLACE]
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    rows = one.select(*CELL, F.lit(True).alias("_left"), *place, "_a", none(two, "_o")).unionByName(two.select(*CELL, F.lit(False).alias("_left"), *place, none(one, "_a"), "_o"))
    spark = left.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(parts, *CELL).sortWithinPartitions(*CELL)


def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Metres from each place to each other, as ``measure.rhumb_between`` has them."""
    at = lambda k: (a[:, None, k], b[None, :, k])
    (la, lb), (pa_, pb), (sa, sb), (ma, mb) = at(0), at(1), at(2), at(3)
    d = lb - la
    d = d - 2 * np.pi * np.floor((d + np.pi) / (2 * np.pi))
    arc = mb - ma
    flat = np.abs(pb - pa_) < 1e-11
    with np.errstate(all="ignore"):
        q = np.where(flat, a[:, None, 4], arc / (sb - sa)) * d
    return np.sqrt(arc * arc + q * q)


def pairs(left: DataFrame, right: DataFrame, radius: float, lx: str, ly: str, rx: str, ry: str, out: str) -> DataFrame:
    """The columns of both sides and the distance of every pair within ``radius`` metres."""
    rows = _rows(left, right, F.struct(*left.columns), F.struct(*right.columns), radius, (lx, ly), (rx, ry))
    schema = StructType([*left.schema.fields, *right.schema.fields, StructField(out, DoubleType())])
    return rows.mapInArrow(lambda batches: segments.each_cell(batches, _places, lambda at, i, j: _close(at, i, j, radius), lambda rows, at, found: _listed(rows, found, out)), schema)


def _places(rows):
    return np.stack([rows.column(c).to_numpy() for c in PLACE], axis=1)


def _close(at, i, j, radius):
    d = between(at[i], at[j])
    s, t = np.nonzero(d <= radius)
    return i[s], j[t], d[s, t]


def _listed(rows, found, out):
    s, t, d = found
    sides = (rows.column("_a").take(pa.array(s)), rows.column("_o").take(pa.array(t)))
    cols = {f.name: v for side in sides for f, v in zip(side.type, side.flatten(), strict=True)}
    yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(d)], names=[*cols, out])


def sums(left: DataFrame, right: DataFrame, radius: float, lx: str, ly: str, rx: str, ry: str, key: str, mine: list[str], theirs: list[str], f, names: list[str], but: str | None = None) -> DataFrame:
    """key and the sums ``names`` of each left point over the right ones within ``radius`` metres, one row for each; those without any are left out.

    ``but`` names the right points' key, of which a point's own isn't its neighbour. ``f(d, a, b)`` gives an array of the pairs' summands for each name, from their distances and the numbers ``mine`` and ``theirs``.
    """
    rows = _rows(left, right, F.struct(key, *(F.col(c).cast("double").alias(f"v{k}") for k, c in enumerate(mine))), F.struct(*(F.col(c).cast("double").alias(f"v{k}") for k, c in enumerate(theirs)), (F.col(but) if but else F.lit(1)).alias("key")), radius, (lx, ly), (rx, ry))
    schema = StructType([left.schema[key], *(StructField(n, DoubleType()) for n in names)])

    def state(rows):
        values = lambda c, n: [rows.column(c).field(f"v{k}").to_numpy(zero_copy_only=False) for k in range(n)]
        codes = None
        if but:
            keys = pa.concat_arrays([rows.column("_a").field(0), rows.column("_o").field("key")]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            codes = keys[: len(keys) // 2], keys[len(keys) // 2 :]
        return _places(rows), values("_a", len(mine)), values("_o", len(theirs)), codes

    def test(at, i, j):
        place, a, b, codes = at
        d = between(place[i], place[j])
        s, t = np.nonzero(d <= radius if codes is None else (d <= radius) & (codes[0][i][:, None] != codes[1][j][None]))
        if not len(s):
            return i[:0], i[:0], *(np.zeros(0) for _ in names)
        parts = f(d[s, t], [v[i[s]] for v in a], [v[j[t]] for v in b])
        has = np.unique(s)
        return i[has], i[has], *(np.bincount(s, p, len(i))[has] for p in parts)

    def finish(rows, at, found):
        key_of = rows.column("_a").field(0).take(pa.array(found[0]))
        yield pa.RecordBatch.from_arrays([key_of, *map(pa.array, found[2:])], names=[key, *names])

    part = rows.mapInArrow(lambda batches: segments.each_cell(batches, state, test, finish), schema)
    return part.groupBy(key).agg(*(F.sum(n).alias(n) for n in names))
