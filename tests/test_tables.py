"""Unions up a tree, and operators on empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tellurion.functions import types as T
from tellurion.operators import geodetic as g
from tellurion.operators import planar as pl
from tellurion.operators import tables


def cells(spark, n, size=0.05):
    i, j = F.col("id") % n, F.floor(F.col("id") / n)
    x, y = 110 + i * size, 30 + j * size
    ring = T.ring([(x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y)])
    return spark.range(n * n).select(F.col("id").alias("fid"), F.when(i < n / 2, "west").otherwise("east").alias("side"), T.polygon(F.array(ring)).alias("geom"))


def test_cells_dissolve_in_steps(spark, monkeypatch):
    """Cells of a board become two areas without inner edges; what is landed has fewer positions at each level."""
    sizes, keep = [], tables.land

    def counted(df):
        out = keep(df)
        if "_at" in out.columns:
            sizes.append(out.agg(F.sum(F.size(T.positions_of(F.col("geom"))))).first()[0])
        return out

    monkeypatch.setattr(tables, "land", counted)
    out = {r["side"]: (r["fid"], tables.unpack(r["j"])) for r in tables.dissolve(cells(spark, 18), "side").select("side", "fid", F.to_json("geom").alias("j")).collect()}
    assert {k: v[0] for k, v in out.items()} == {"west": 0, "east": 9}
    for _, (kind, parts) in out.values():
        assert kind == "Polygon" and len(parts) == 1 and len(parts[0]) == 1
    f = g.Frame(out["west"][1])
    whole = pl.closed(np.array([(110, 30), (110.45, 30), (110.45, 30.9), (110, 30.9)]))
    assert pl.area(f.plane(g.densified(out["west"][1]))) == pytest.approx(pl.area(f.plane(g.densified(("Polygon", [[whole]])))), rel=1e-7)
    assert len(sizes) >= 2 and all(b < a for a, b in zip(sizes, sizes[1:], strict=False))


def test_rows_are_numbered_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    assert [r["at"] for r in tables.dense(df, [F.col("v")], "at").orderBy("v").collect()] == list(range(1000))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, lon double, lat double")
    assert tables.convex_hull(none).count() == 0
    assert tables.kmeans(none, "id").count() == 0
    areas = cells(spark, 2).limit(0)
    assert tables.union_by(areas, None).count() == 0 and tables.dissolve(areas, "side").count() == 0
    nulls = cells(spark, 2).withColumn("geom", F.when(F.col("fid") == 0, F.col("geom")))
    assert tables.union_by(nulls, None).select(F.size("geom.parts").alias("n")).first()["n"] == 1


def test_components_of_chains(spark):
    """A long chain in random order of ids, a ring, a star, a pair and a loop."""
    rng = np.random.default_rng(1)
    chain = rng.permutation(400).tolist()
    links = [*zip(chain, chain[1:], strict=False), *((1000 + k, 1000 + (k + 1) % 7) for k in range(7)), *((2000, 2000 + k) for k in range(1, 50)), (3001, 3000), (4000, 4000)]
    got = {r["id"]: r["root"] for r in tables.components(spark.createDataFrame([(int(a), int(b)) for a, b in links], "a long, b long"), 30).collect()}
    assert got == {i: 1000 * (i // 1000) for i in {x for pair in links for x in pair}}
    assert tables.components(spark.createDataFrame([], "a long, b long")).count() == 0
