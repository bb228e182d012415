"""Contours of tables against the crossings of every triangle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tellurion.operators import contours


def surface(spark, nx, ny, f, g="g", drop=()):
    rows = [(g, 100 + i * 0.1, 30 + j * 0.05, float(f(i, j)), i) for i in range(nx) for j in range(ny) if (i, j) not in drop]
    return spark.createDataFrame(rows, "g string, lon double, lat double, z double, id int").repartition(3)


def crossings(df, level):
    """Every triangle's two crossing points."""
    rows = {(round((r["lon"] - 100) / 0.1), round((r["lat"] - 30) / 0.05)): r for r in df.collect()}
    out = []
    for i, j in rows:
        for b in ((i + 1, j), (i, j + 1)):
            t = [(i, j), b, (i + 1, j + 1)]
            if all(n in rows for n in t):
                at = []
                for p, q in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2])):
                    p, q = rows[p], rows[q]
                    if (p["z"] >= level) != (q["z"] >= level):
                        s = (level - p["z"]) / (q["z"] - p["z"])
                        at.append((p["lon"] + s * (q["lon"] - p["lon"]), p["lat"] + s * (q["lat"] - p["lat"])))
                if len(at) == 2 and np.hypot(*np.subtract(*at)) > 1e-12:
                    out.append(at)
    return out


def length(points):
    return float(np.hypot(*np.diff(np.array(points), axis=0).T).sum())


def lines(out):
    return [[(p["x"], p["y"]) for p in r["geom"]["parts"][0][0]] for r in out]


def test_ramp(spark):
    """The contours of a slope to the east are meridians, one each."""
    out = contours.isolines(surface(spark, 21, 11, lambda i, j: 100 + i * 0.1), "g", [100.55, 101.25]).collect()
    assert sorted(r["level"] for r in out) == [100.55, 101.25]
    for r, line in zip(out, lines(out), strict=True):
        assert np.ptp([x for x, _ in line]) < 1e-9 and line[0][0] == pytest.approx(100 + (r["level"] - 100)) and np.ptp([y for _, y in line]) == pytest.approx(0.5)


@pytest.mark.parametrize("seed", [0, 1])
def test_hills(spark, seed):
    """Rings and open chains: all crossings once, each chain without a break; heights at levels and holes too."""
    rng = np.random.default_rng(seed)
    z = np.round(rng.random((14, 12)) * 6)
    df = surface(spark, 14, 12, lambda i, j: z[i, j], drop={(3, 3), (7, 8), (13, 0)})
    for level in (2.5, 3.0):
        out = contours.isolines(df, "g", [level]).collect()
        own = lines(out)
        want = crossings(df, level)
        assert sum(len(x) - 1 for x in own) == len(want)
        assert sum(map(length, own)) == pytest.approx(sum(map(length, want)))
        ends = np.array([p for s in want for p in s]).round(9)
        _, times = np.unique(ends, axis=0, return_counts=True)
        if level == 2.5:
            assert sum(x[0] != x[-1] for x in own) * 2 == (times == 1).sum()


def test_a_gap_is_no_step(spark):
    """Columns that are left out make a hole, not wider cells."""
    df = surface(spark, 9, 4, lambda i, j: j).filter("id not in (4, 5)")
    own = lines(contours.isolines(df, "g", [1.5]).collect())
    assert sorted((round(min(x for x, _ in s), 6), round(max(x for x, _ in s), 6)) for s in own) == [(100.0, 100.3), (100.6, 100.8)]


def test_groups_and_empty(spark):
    df = surface(spark, 5, 5, lambda i, j: i).unionByName(surface(spark, 6, 6, lambda i, j: j, None))
    out = contours.isolines(df, "g", [1.5, 99.0])
    assert sorted(((r["g"] or ""), r["level"]) for r in out.collect()) == [("", 1.5), ("g", 1.5)]
    assert contours.isolines(df.filter("false"), "g", [1.5]).count() == 0 and contours.isolines(df, "g", []).count() == 0
    assert contours.isolines(df.withColumn("z", F.lit(None).cast("double")), "g", [1.5]).count() == 0
