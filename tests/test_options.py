"""Options of shapes and tests: steps, sharpness, tolerances."""

import pytest
from pyspark.sql import functions as F

from tellurion.functions import types as T
from tellurion.functions import udfs as u


@pytest.fixture(scope="module")
def one(spark):
    pts = lambda ps: T.line_string(T.ring(ps))
    return spark.range(1).select(
        F.lit(120.0).alias("x"), F.lit(30.0).alias("y"), pts([(120, 30), (120.1, 30), (120.1, 30.1)]).alias("bent"),
        pts([(120, 30), (120.1, 30)]).alias("flat"), pts([(120, 31), (120.1, 31.0005)]).alias("tilted"), pts([(120.02, 30.00001), (120.08, 30.00001)]).alias("beside"),
    )


def size(df, geom):
    return df.select(F.size(T.positions_of(geom)).alias("n")).first()["n"]


def test_steps(one):
    x, y = F.col("x"), F.col("y")
    assert size(one, u.circle(x, y, 1000.0)) == 65 and size(one, u.circle(x, y, 1000.0, steps=8)) == 9
    assert size(one, u.line_arc(x, y, 1000.0, 0.0, 90.0, steps=10)) == 11
    assert size(one, u.ellipse(x, y, 1000.0, 500.0, 0.0, steps=12)) == 13
    assert size(one, u.great_circle(x, y, 121.0, 31.0)) == 100 and size(one, u.great_circle(x, y, 121.0, 31.0, steps=7)) == 7
    assert size(one, u.sector(x, y, 1000.0, 0.0, 90.0)) - size(one, u.sector(x, y, 1000.0, 0.0, 90.0, 4)) == 60
    assert size(one, u.bezier_spline("bent", 0.85, 32)) > size(one, u.bezier_spline("bent"))
    assert size(one, u.line_offset("bent", -500.0, 4)) < size(one, u.line_offset("bent", -500.0))
    with pytest.raises(ValueError):
        u.circle(x, y, 1.0, steps=2)


def test_tolerances(one):
    out = one.select(u.boolean_parallel("flat", "tilted").alias("strict"), u.boolean_parallel("flat", "tilted", 1.0).alias("loose")).first()
    assert (out["strict"], out["loose"]) == (False, True)
    assert size(one, u.line_overlap("flat", "beside")) == 0 and size(one, u.line_overlap("flat", "beside", 5.0)) == 2
