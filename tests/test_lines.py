"""Slices of lines as arrays, and pieces that leave a task a few lines at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tellurion.functions import types as T
from tellurion.functions import udfs as u
from tellurion.operators import geodetic as g


def some_lines(seed=2):
    rng = np.random.default_rng(seed)
    return [np.array([100.0, 30.0]) + np.cumsum(rng.random((2 + k % 4, 2)) - 0.4, axis=0) for k in range(24)]


def test_slices_as_one_by_one():
    """Lines of mixed lengths, nulls, places in either order, at positions and beyond the ends."""
    rng = np.random.default_rng(3)
    own = some_lines()
    geoms = [None if k % 7 == 6 else ("LineString", [[r]]) for k, r in enumerate(own)]
    long = np.array([g._measures(r)[0][-1] for r in own])
    lo, hi = long * rng.uniform(-0.2, 0.5, len(own)), long * rng.uniform(0.6, 1.3, len(own))
    lo[::3], hi[::3] = hi[::3].copy(), lo[::3].copy()
    lo[1], lo[4] = g._measures(own[1])[0][-2] + 5e-5, np.nan
    b = u.Batch.of(u.Batch.from_geoms(geoms).arrow())
    for v, r, p, q in zip(u._between(b, lo, hi).geoms(), geoms, lo, hi, strict=True):
        if r is None or np.isnan(p + q):
            assert v is None
        else:
            want = g.line_between(r[1][0][0], float(p), float(q))
            assert v[0] == "LineString" and v[1][0][0].shape == want.shape and np.allclose(v[1][0][0], want, atol=1e-11)
    with pytest.raises(ValueError):
        u._between(b, np.zeros(len(own)), np.zeros(len(own)))


def test_pieces_in_small_batches(spark, monkeypatch):
    """The same positions as the column gives."""
    rows = spark.createDataFrame([(k, [{"x": float(x), "y": float(y)} for x, y in r]) for k, r in enumerate(some_lines())], f"user_id long, r {T.RING}")
    rows = rows.select("user_id", T.line_string(F.col("r")).alias("geom")).coalesce(1)
    want = rows.select("user_id", F.posexplode(T.positions_of(u.line_chunk(F.col("geom"), F.lit(7000.0)))).alias("i", "p")).select("user_id", "i", "p.x", "p.y").collect()
    monkeypatch.setattr(u, "CHUNKED", 5)
    out = u.line_chunk_positions(rows, "user_id", 7000.0)
    assert sorted(out.collect()) == sorted(want)
