"""Where the segments of two tables meet, cell by cell.

A segment is listed under the cells that it passes, of a quarter of its extent and
no smaller than asked for, at its own level and at those in use above it; a pair meets
at the level of its larger one. Rows are dealt by cell and sorted, so a task
holds one cell at a time and tests its pairs as arrays; no table of pairs is made. A crowded cell
is dealt out in blocks of its left segments. A place counts in the cell that holds it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tellurion.functions import measure
from tellurion.functions import types as T
from tellurion.session import ship

#: Cells are finer than a segment's extent by so many halvings.
PASSES = 2
#: Left segments of a block of a crowded cell, and pairs that are tested at once.
BLOCK, AT_ONCE = 4096, 1 << 17
ENDS = ("px", "py", "qx", "qy")
CELL = ("_m", "_cx", "_cy", "_b")


def flat(lines: DataFrame, geom: str = "geom", *keep: str) -> DataFrame:
    """A row for each segment: the columns to keep, its number ``no`` on its ring, and px, py, qx, qy."""
    s = F.col("_s")
    rows = lines.select(*keep, F.explode(T.rings_of(F.col(geom))).alias("_ring")).select(*keep, F.posexplode(measure.segments(F.col("_ring"))).alias("no", "_s"))
    rows = rows.select(*keep, "no", *(s[c[0]][c[1]].alias(c) for c in ENDS))
    return rows.filter(" and ".join(f"{c} is not null" for c in ENDS))


def _span(axis: str) -> tuple[Column, Column]:
    p, q = F.col(f"p{axis}"), F.col(f"q{axis}")
    return F.least(p, q), F.greatest(p, q)


def _listed(rows: DataFrame, levels: list[int], bound: str | None) -> DataFrame:
    """A row for each cell that the segment passes, or as much of it as lies in the box ``bound``, at its level and above."""
    return passed(rows.withColumn("_m", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda m: m >= F.col("_l")))), bound)


def passed(rows: DataFrame, bound: str | None = None, wide: tuple[Column, Column] | None = None) -> DataFrame:
    """A row for each cell _cx, _cy of level _m that the segment passes; ``wide``: or comes so near, and whether cells off its line may be left out."""
    rows = rows.withColumn("_side", F.pow(F.lit(2.0), F.col("_m")))
    # What rounding may be off by.
    rows = rows.withColumn("_e", F.col("_side") * 1e-9 + 1e-14 * sum((F.abs(c) for c in ENDS), F.lit(0.0)))
    if wide is not None:
        rows = rows.withColumns({"_wide": wide[0], "_off": wide[1]}).withColumn("_e", F.col("_e") + F.col("_wide"))
    side, spare = F.col("_side"), F.col("_e")
    for c, axis in (("_cx", "x"), ("_cy", "y")):
        lo, hi = _span(axis)
        if bound:
            lo, hi = F.greatest(lo, F.col(bound)[f"{axis}min"]), F.least(hi, F.col(bound)[f"{axis}max"])
            rows = rows.filter(lo <= hi)
        rows = rows.withColumn(c, F.explode(F.sequence(F.floor((lo - spare) / side), F.floor((hi + spare) / side))))
    dx, dy = F.col("qx") - F.col("px"), F.col("qy") - F.col("py")
    off = dx * ((F.col("_cy") + 0.5) * side - F.col("py")) - dy * ((F.col("_cx") + 0.5) * side - F.col("px"))
    near = F.abs(off) <= (F.abs(dx) + F.abs(dy)) * (side * 0.5 + spare)
    return rows.filter(near if wide is None else near | ~F.col("_off")).drop("_side", "_e", "_wide", "_off")


def meetings(left: DataFrame, right: DataFrame, left_keep: list[str], right_keep: list[str], size: float, how: str = "touching", less: tuple[list[str], list[str]] | None = None, bound: str | None = None) -> DataFrame:
    """The columns to keep of both sides, x and y of every place where a left and a right segment meet.

    ``left`` and ``right`` have the columns of ``flat``. ``how`` is "touching" (in one point, ends
    included), "overlapping" (also the ends of collinear overlaps; places may come twice) or "proper" (within
    both). ``less`` names columns of each side that come in this order, the left's before the right's; ``bound``
    a box of each left row beyond which its places aren't asked for, though some may come.
    """
    from tellurion.operators.joins import level_of, levels_in_use

    ship()
    (x0, x1), (y0, y1) = _span("x"), _span("y")
    level = level_of({"xmin": x0, "ymin": y0, "xmax": x1, "ymax": y1}, size) - PASSES
    a, b = left.withColumn("_l", level), right.withColumn("_l", level)
    levels = levels_in_use(a.select("_l"), b.select("_l")) or [0]
    a, b = _listed(a, levels, bound), _listed(b, levels, None)
    crowd = a.groupBy("_m", "_cx", "_cy").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > BLOCK)
    crowd = F.broadcast(crowd.select("_m", "_cx", "_cy", F.ceil(F.col("_n") / BLOCK).cast("int").alias("_k")))
    blocks = F.coalesce("_k", F.lit(1))
    a = a.join(crowd, ["_m", "_cx", "_cy"], "left").withColumn("_b", F.pmod(F.xxhash64(*ENDS), blocks).cast("int"))
    b = b.join(crowd, ["_m", "_cx", "_cy"], "left").withColumn("_b", F.explode(F.sequence(F.lit(0), blocks - 1)))
    own = lambda keep: F.struct(*keep)
    none = lambda df, keep: F.lit(None).cast(df.select(own(keep).alias("k")).schema["k"].dataType)
    shared = [*CELL, "_l", *ENDS]
    rows = a.select(*shared, F.lit(True).alias("_left"), own(left_keep).alias("_a"), none(right, right_keep).alias("_o"))
    rows = rows.unionByName(b.select(*shared, F.lit(False).alias("_left"), none(left, left_keep).alias("_a"), own(right_keep).alias("_o")))
    # So many parts that each core has one, however few bytes there are.
    spark = left.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = rows.repartition(parts, *CELL).sortWithinPartitions(*CELL)
    fields = [left.schema[c] for c in left_keep] + [right.schema[c] for c in right_keep]
    schema = StructType([StructField(f.name, f.dataType) for f in fields] + [StructField(c, DoubleType()) for c in "xy"])
    found = rows.mapInArrow(lambda batches: _cells(batches, how, less), schema)
    if not less:
        return found
    before = lambda k: F.struct(*(F.col(c).alias(str(i)) for i, c in enumerate(less[k])))
    return found.filter(before(0) < before(1))


def _cells(batches, how: str, less):
    """Places of each cell."""

    def state(rows):
        is_left = rows.column("_left").to_numpy(zero_copy_only=False)
        return np.stack([rows.column(c).to_numpy() for c in ENDS], axis=1), _numbers(rows, is_left, less) if less else None

    def test(held, i, j):
        hit, t, x, y = _meet(held[0][i], held[0][j], how)
        return i[hit], j[t], x, y

    yield from each_cell(batches, state, test, lambda rows, held, found: _counted(rows, held[0], rows.column("_l").to_numpy(), _keys(rows), held[1], found))


def each_cell(batches, state, test, finish):
    """Whole cells of a task's rows, which come one cell after the other.

    ``state(rows)`` is made once for some whole cells, ``test(state, i, j)`` gives arrays for a cell's left
    rows i and others j, and ``finish(rows, state, arrays)`` the batches of what was found.
    """
    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = _keys(batch)
        new = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        if held and (key[0] != last).any():
            yield from _whole(held, state, test, finish)
            held = []
        if len(new):
            yield from _whole([*held, batch.slice(0, new[-1])], state, test, finish)
            held, batch = [], batch.slice(new[-1])
        held.append(batch)
        last = key[-1]
    if held:
        yield from _whole(held, state, test, finish)


def _keys(batch) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in CELL], axis=1)


def _whole(parts: list[pa.RecordBatch], state, test, finish):
    rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    key, is_left = _keys(rows), rows.column("_left").to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
    ends = np.append(starts[1:], len(key))
    lefts = np.add.reduceat(is_left.astype(np.int64), starts)
    both = (lefts > 0) & (lefts < ends - starts)
    if not both.any():
        return
    made = state(rows)
    found, n = [], 0
    together = lambda: tuple(np.concatenate(v) for v in zip(*found, strict=True))
    for lo, hi in zip(starts[both], ends[both], strict=True):
        side = is_left[lo:hi]
        i, j = lo + np.flatnonzero(side), lo + np.flatnonzero(~side)
        # Neither side's length sets how many pairs are tested at once.
        wide = min(len(j), AT_ONCE)
        step = max(1, AT_ONCE // wide)
        for k in range(0, len(i), step):
            for h in range(0, len(j), wide):
                hits = test(made, i[k : k + step], j[h : h + wide])
                if len(hits[0]):
                    found.append(hits)
                    n += len(hits[0])
                if n >= AT_ONCE:
                    yield from finish(rows, made, together())
                    found, n = [], 0
    if found:
        yield from finish(rows, made, together())


def _counted(rows, at, own, key, order, found):
    """The places that count in their cell, in order."""
    s, t, x, y = found
    m = key[s, 0]
    keep = np.maximum(own[s], own[t]) == m
    if order:
        before, same = np.zeros(len(s), bool), np.ones(len(s), bool)
        for one, two in order:
            before |= same & (one[s] < two[t])
            same &= one[s] == two[t]
        keep &= before
    # A place that rounding puts beyond an end counts at that end.
    for axis, v in ((0, x), (1, y)):
        p, q = at[s][:, axis::2], at[t][:, axis::2]
        inside = np.minimum(np.maximum(v, np.maximum(p.min(1), q.min(1))), np.minimum(p.max(1), q.max(1)))
        keep &= np.floor(inside / 2.0**m) == key[s, 1 + axis]
    if keep.any():
        s, t, x, y = s[keep], t[keep], x[keep], y[keep]
        sides = (rows.column("_a").take(pa.array(s)), rows.column("_o").take(pa.array(t)))
        cols = {f.name: v for side in sides for f, v in zip(side.type, side.flatten(), strict=True)}
        yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(x), pa.array(y)], names=[*cols, "x", "y"])


def _numbers(rows: pa.RecordBatch, is_left, less):
    """The columns that must come in order, if all are whole numbers; others are compared later."""
    out = []
    for one, two in zip(*less, strict=True):
        pair = [rows.column(c).field(n) for c, n in (("_a", one), ("_o", two))]
        if any(not pa.types.is_integer(v.type) or v.filter(pa.array(mine)).null_count for v, mine in zip(pair, (is_left, ~is_left), strict=True)):
            return None
        out.append([v.fill_null(0).to_numpy(zero_copy_only=False) for v in pair])
    return out


def _meet(s, t, how: str):
    """Numbers of the left and right segments that meet, and where; the same formula, term by term, as a column's."""
    rx, ry = (s[:, 2] - s[:, 0])[:, None], (s[:, 3] - s[:, 1])[:, None]
    sx, sy = (t[:, 2] - t[:, 0])[None], (t[:, 3] - t[:, 1])[None]
    dx, dy = t[None, :, 0] - s[:, None, 0], t[None, :, 1] - s[:, None, 1]
    d = rx * sy - ry * sx
    along = dx * sy - dy * sx
    with np.errstate(all="ignore"):
        a, b = along / d, (dx * ry - dy * rx) / d
    met = (a > 0) & (a < 1) & (b > 0) & (b < 1) if how == "proper" else (a >= 0) & (a <= 1) & (b >= 0) & (b <= 1)
    met &= d != 0
    i, j = np.nonzero(met)
    x, y = s[i, 0] + a[i, j] * rx[i, 0], s[i, 1] + a[i, j] * ry[i, 0]
    if how != "overlapping":
        return i, j, x, y
    found = [(i, j, x, y)]
    for one, many, left in ((s, t, True), (t, s, False)):
        for e in (0, 2):
            # Ends of the one side that lie on a segment of the other.
            px, py = one[:, None, e], one[:, None, e + 1]
            ax, ay, bx, by = (many[None, :, c] for c in range(4))
            on = ((bx - ax) * (py - ay) - (by - ay) * (px - ax) == 0) & (px >= np.minimum(ax, bx)) & (px <= np.maximum(ax, bx)) & (py >= np.minimum(ay, by)) & (py <= np.maximum(ay, by))
            p, q = np.nonzero(on)
            found.append((p, q, one[p, e], one[p, e + 1]) if left else (q, p, one[p, e], one[p, e + 1]))
    return tuple(np.concatenate(v) for v in zip(*found, strict=True))
