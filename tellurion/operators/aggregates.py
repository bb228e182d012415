"""Aggregates and statistics over point tables.

Moments, counts and extremes are algebraic, so they are combined in each task
before anything is shuffled. What needs a plane uses a transverse Mercator frame
at the middle of the table's box, which is one row found by an aggregate first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellurion.functions import crs
from tellurion.functions import types as T
from tellurion.session import land
from tellurion.operators.joins import within_distance


def bbox(df: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    return df.agg(F.min(x).alias("xmin"), F.min(y).alias("ymin"), F.max(x).alias("xmax"), F.max(y).alias("ymax"))


def envelope(df: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    """The box of all points as a polygon."""
    return bbox(df, x, y).select(T.bbox_polygon(F.struct("xmin", "ymin", "xmax", "ymax")).alias("geom"))


def framed(df: DataFrame, x: str = "lon", y: str = "lat", px: str = "px", py: str = "py") -> DataFrame:
    """The table with plane coordinates px, py in metres, in the frame of its own box."""
    mid = bbox(df, x, y).select(((F.col("xmin") + F.col("xmax")) / 2).alias("_lon0"))
    rows = df.crossJoin(F.broadcast(mid))  # one row
    ex, ny = crs.tmerc_forward(F.col(x), F.col(y), F.col("_lon0"))
    return rows.withColumns({px: ex, py: ny}).drop("_lon0")


def center_mean(df: DataFrame, x: str = "lon", y: str = "lat", weight: str | None = None) -> DataFrame:
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    return df.agg((F.sum(F.col(x) * w) / F.sum(w)).alias("lon"), (F.sum(F.col(y) * w) / F.sum(w)).alias("lat"))


def center_median(df: DataFrame, x: str = "lon", y: str = "lat", weight: str | None = None, tolerance: float = 1e-3, rounds: int = 200) -> DataFrame:
    """Weiszfeld's iteration in the frame's plane; each round is one aggregate of a cached table."""
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    b = bbox(df, x, y).first()
    lon0 = (b["xmin"] + b["xmax"]) / 2
    px, py = crs.tmerc_forward(F.col(x), F.col(y), lon0)
    rows = df.select(px.alias("px"), py.alias("py"), w.alias("w")).persist()
    cx, cy = rows.agg(F.sum(F.col("px") * F.col("w")) / F.sum("w"), F.sum(F.col("py") * F.col("w")) / F.sum("w")).first()
    for _ in range(rounds):
        d = F.sqrt((F.col("px") - cx) ** 2 + (F.col("py") - cy) ** 2)
        v = F.when(d > 1e-9, F.col("w") / d)
        nx, ny, nw = rows.agg(F.sum(F.col("px") * v), F.sum(F.col("py") * v), F.sum(v)).first()
        if not nw:
            break
        moved = math.hypot(nx / nw - cx, ny / nw - cy)
        cx, cy = nx / nw, ny / nw
        if moved < tolerance:
            break
    rows.unpersist()
    lon, lat = crs.tmerc_reverse(*map(_array, (cx, cy)), lon0)
    return df.sparkSession.createDataFrame([(float(lon), float(lat))], "lon double, lat double")


def _array(v: float):
    import numpy as np

    return np.float64(v)


def combine(df: DataFrame, geom: str = "geom") -> DataFrame:
    """One multi-geometry for each dimension; properties go."""
    g = F.col(geom)
    base = F.regexp_replace(g["kind"], "^Multi", "")
    return df.select(F.concat(F.lit("Multi"), base).alias("kind"), g["parts"].alias("parts")).groupBy("kind").agg(F.flatten(F.collect_list("parts")).alias("parts")).select(F.struct("kind", "parts").alias("geom"))


def create_bins(df: DataFrame, prop: str, fid: str) -> DataFrame:
    """Each value of a property with the ids of its features, in order."""
    return df.groupBy(prop).agg(F.sort_array(F.collect_list(fid)).alias("features"))


def get_cluster(df: DataFrame, **props) -> DataFrame:
    for k, v in props.items():
        df = df.filter(F.col(k) == v)
    return df


def cluster_reduce(df: DataFrame, prop: str, *aggs: Column) -> DataFrame:
    return df.groupBy(prop).agg(*aggs)


def quadrat_analysis(df: DataFrame, x: str = "lon", y: str = "lat", nx: int = 4, ny: int = 4) -> DataFrame:
    """Counts of equal cells of the points' plane box against an even spread: chi-squared and its 95 % bound."""
    rows = framed(df, x, y)
    b = rows.agg(F.min("px").alias("x0"), F.max("px").alias("x1"), F.min("py").alias("y0"), F.max("py").alias("y1"))
    spot = lambda v, lo, hi, n: F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((F.col(v) - F.col(lo)) / F.when(F.col(hi) > F.col(lo), F.col(hi) - F.col(lo)).otherwise(1.0) * n))).cast("int")
    counts = rows.crossJoin(F.broadcast(b)).groupBy(spot("px", "x0", "x1", nx).alias("i"), spot("py", "y0", "y1", ny).alias("j")).agg(F.count(F.lit(1)).alias("n"))
    # Empty cells count too: their share of chi-squared is the expected number each.
    s = counts.agg(F.sum("n").alias("points"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.count(F.lit(1)).alias("filled"))
    cells, k = nx * ny, nx * ny - 1
    bound = k * (1 - 2 / (9 * k) + 1.6448536269514722 * math.sqrt(2 / (9 * k))) ** 3
    expected = F.col("points") / F.lit(float(cells))
    chi = F.col("squares") / expected - F.col("points")
    return s.select("points", F.lit(cells).alias("cells"), "filled", expected.alias("expected"), chi.alias("chi_squared"), F.lit(bound).alias("critical"), (chi > bound).alias("clustered"))


def standard_deviational_ellipse(df: DataFrame, x: str = "lon", y: str = "lat", weight: str | None = None) -> DataFrame:
    """Centre, rotation (degrees clockwise from north) and the two standard distances in metres."""
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    rows = framed(df, x, y).withColumn("_w", w)
    mean = rows.agg((F.sum(F.col("px") * F.col("_w")) / F.sum("_w")).alias("mx"), (F.sum(F.col("py") * F.col("_w")) / F.sum("_w")).alias("my"), (F.sum(F.col(x) * F.col("_w")) / F.sum("_w")).alias("_mlon"), (F.sum(F.col(y) * F.col("_w")) / F.sum("_w")).alias("_mlat"))
    dx, dy = F.col("px") - F.col("mx"), F.col("py") - F.col("my")
    s = rows.crossJoin(F.broadcast(mean)).groupBy("_mlon", "_mlat").agg(F.sum(dx * dx * F.col("_w")).alias("xx"), F.sum(dy * dy * F.col("_w")).alias("yy"), F.sum(dx * dy * F.col("_w")).alias("xy"), F.sum("_w").alias("n"))
    theta = F.atan2(F.col("xx") - F.col("yy") + F.sqrt((F.col("xx") - F.col("yy")) ** 2 + 4 * F.col("xy") ** 2), 2 * F.col("xy"))
    c, t = F.cos(theta), F.sin(theta)
    sx = F.sqrt(F.greatest(F.lit(0.0), 2 * (F.col("xx") * c * c - 2 * F.col("xy") * c * t + F.col("yy") * t * t) / (F.col("n") - 2)))
    sy = F.sqrt(F.greatest(F.lit(0.0), 2 * (F.col("xx") * t * t + 2 * F.col("xy") * c * t + F.col("yy") * c * c) / (F.col("n") - 2)))
    return s.select(F.col("_mlon").alias("lon"), F.col("_mlat").alias("lat"), F.degrees(theta).alias("rotation"), sx.alias("sigma_x"), sy.alias("sigma_y"))


def directional_mean(df: DataFrame, bearing: str = "bearing", length: str = "length") -> DataFrame:
    """Mean direction of lines from their start-to-end azimuths; lines without length are left out."""
    b, rows = F.radians(F.col(bearing)), df.filter(F.col(length) > 0)
    s = rows.agg(F.sum(F.sin(b)).alias("s"), F.sum(F.cos(b)).alias("c"), F.count(F.lit(1)).alias("n"), F.avg(length).alias("mean_length"))
    mean = F.degrees(F.atan2("s", "c"))
    return s.select(F.when(mean < 0, mean + 360).otherwise(mean).alias("mean_bearing"), (1 - F.sqrt(F.col("s") ** 2 + F.col("c") ** 2) / F.col("n")).alias("circular_variance"), "mean_length", "n")


def distance_weight(df: DataFrame, fid: str, threshold: float, x: str = "lon", y: str = "lat", alpha: float = -1.0, binary: bool = True, standardize: bool = True, distance=None) -> DataFrame:
    """Sparse spatial weights (i, j, w): 1, or distance to the power alpha, within so many metres; rows add up to 1."""
    a = df.select(F.col(fid).alias("i"), F.col(x).alias("lon"), F.col(y).alias("lat"))
    b = df.select(F.col(fid).alias("j"), F.col(x).alias("rlon"), F.col(y).alias("rlat"))
    if distance is None and standardize:
        from tellurion.operators import near

        # Sums come first, so that pairs needn't be dealt and sorted by i.
        total = near.sums(a, b, threshold, "lon", "lat", "rlon", "rlat", "i", [], [], lambda d, x, y: [_weight(d, alpha, binary)], ["_sum"], but="j")
        a = a.join(total, "i")
    d = within_distance(a, b, threshold, distance).filter("i != j")
    w = F.lit(1.0) if binary else F.when(F.col("distance") == 0, 1.0).otherwise(F.pow("distance", F.lit(alpha)))
    if distance is None and standardize:
        return d.select("i", "j", (w / F.col("_sum")).alias("w"))
    out = d.select("i", "j", w.alias("w"))
    return out.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("i"))) if standardize else out


def moran_index(df: DataFrame, weights: DataFrame, fid: str, value: str) -> DataFrame:
    """Moran's I with its expectation, variance under randomisation, z and p; four features or more."""
    v = df.select(F.col(fid).alias("id"), F.col(value).cast("double").alias("v"))
    mean = v.agg(F.avg("v").alias("mean"))
    z = v.crossJoin(F.broadcast(mean)).select("id", (F.col("v") - F.col("mean")).alias("z"))
    m = z.agg(F.sum(F.col("z") ** 2).alias("m2"), F.sum(F.col("z") ** 4).alias("m4"), F.count(F.lit(1)).cast("double").alias("n"))
    zi, zj = z.toDF("i", "zi"), z.toDF("j", "zj")
    s = weights.join(zi, "i").join(zj, "j").agg(F.sum(F.col("w") * F.col("zi") * F.col("zj")).alias("num"))
    back = weights.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("w").alias("wr"))
    s1 = weights.join(back, ["i", "j"], "left").agg(F.sum(F.when(F.col("wr").isNull(), 2 * F.col("w") ** 2).otherwise((F.col("w") + F.col("wr")) ** 2)).alias("twice"))
    ends = weights.select(F.col("i").alias("k"), "w").unionByName(weights.select(F.col("j").alias("k"), "w")).groupBy("k").agg(F.sum("w").alias("t"))
    s2, s0 = ends.agg(F.sum(F.col("t") ** 2).alias("s2")), weights.agg(F.sum("w").alias("s0"))
    return _moran(m.crossJoin(s).crossJoin(s1).crossJoin(s2).crossJoin(s0))  # one row each


def moran_within(df: DataFrame, fid: str, value: str, threshold: float, x: str = "lon", y: str = "lat") -> DataFrame:
    """``moran_index`` with the weights of ``distance_weight``, binary and standardised, without a table of pairs.

    Neighbours are each other's, so a pair's two weights are known from its points' numbers of neighbours. Ids must be unique.
    """
    from tellurion.operators import near

    v = df.select(F.col(fid).alias("id"), F.col(value).cast("double").alias("v"), F.col(x).alias("x"), F.col(y).alias("y"))
    mean = v.agg(F.avg("v").alias("mean"))
    z = v.crossJoin(F.broadcast(mean)).select("id", (F.col("v") - F.col("mean")).alias("z"), "x", "y")
    m = z.agg(F.sum(F.col("z") ** 2).alias("m2"), F.sum(F.col("z") ** 4).alias("m4"), F.count(F.lit(1)).cast("double").alias("n"))
    count = near.sums(z, z, threshold, "x", "y", "x", "y", "id", [], [], lambda d, a, b: [_weight(d, 0.0, True)], ["k"], but="id")
    own = land(z.join(count, "id").select("id", "z", "x", "y", (1 / F.col("k")).alias("w")))
    each = near.sums(own, own, threshold, "x", "y", "x", "y", "id", ["z", "w"], ["z", "w"], _products, ["num", "both", "back"], but="id")
    total = each.agg(F.sum("num").alias("num"), F.sum("both").alias("twice"), F.sum((1 + F.col("back")) ** 2).alias("s2"), F.count(F.lit(1)).cast("double").alias("s0"))
    return _moran(m.crossJoin(total))  # one row each


def _weight(d, alpha: float, binary: bool):
    import numpy as np

    return np.ones(len(d)) if binary else np.where(d == 0, 1.0, np.where(d == 0, 1.0, d) ** alpha)


def _products(d, a, b):
    """A pair's share of the products, the square of its two weights' sum, and its weight from the other side; a null value has no product."""
    import numpy as np

    product = a[1] * a[0] * b[0]
    return np.where(np.isnan(product), 0.0, product), (a[1] + b[1]) ** 2, b[1]


def _moran(one: DataFrame) -> DataFrame:
    n, c = F.col("n"), {k: F.col(k) for k in ("m2", "m4", "num", "twice", "s2", "s0")}
    half, k = c["twice"] / 2, n * c["m4"] / (c["m2"] * c["m2"])
    index, expected = n / c["s0"] * c["num"] / c["m2"], -1 / (n - 1)
    s02 = c["s0"] * c["s0"]
    var = (n * ((n * n - 3 * n + 3) * half - n * c["s2"] + 3 * s02) - k * ((n * n - n) * half - 2 * n * c["s2"] + 6 * s02)) / ((n - 1) * (n - 2) * (n - 3) * s02) - expected * expected
    out = one.select(index.alias("index"), expected.alias("expected"), var.alias("variance")).withColumn("z", (F.col("index") - F.col("expected")) / F.sqrt("variance"))
    return out.withColumn("p", 2 * (1 - normal_cdf(F.abs(F.col("z")))))


def normal_cdf(z: Column) -> Column:
    """Abramowitz and Stegun 7.1.26."""
    x = z / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    # The published coefficients.
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return (1 + (1 - poly * F.exp(-x * x))) / 2


def nearest_neighbor_analysis(df: DataFrame, fid: str, study_area: float, start: float, x: str = "lon", y: str = "lat") -> DataFrame:
    """Mean nearest distance in the frame's plane against that of a random pattern over ``study_area`` square metres."""
    from tellurion.operators.joins import nearest_point_plane

    rows = framed(df, x, y)
    d = nearest_point_plane(rows, fid, start)
    s = d.agg(F.avg("distance").alias("observed"), F.count(F.lit(1)).cast("double").alias("n"))
    expected, error = 0.5 / F.sqrt(F.col("n") / study_area), 0.26136 / F.sqrt(F.col("n") * F.col("n") / study_area)
    return s.select("observed", expected.alias("expected"), (F.col("observed") / expected).alias("nn_index"), ((F.col("observed") - expected) / error).alias("z"), F.col("n").cast("long").alias("n"))


def idw(samples: DataFrame, targets: DataFrame, target_id: str, z: str, radius: float, weight: float = 1.0, distance=None, lx: str = "lon", ly: str = "lat") -> DataFrame:
    """Inverse-distance means of the samples within ``radius`` metres; targets without any are left out.

    A sample at the target itself decides alone.
    """
    if distance is None:
        from tellurion.operators import near

        s = near.sums(targets, samples, radius, lx, ly, "lon", "lat", target_id, [], [z], lambda d, a, b: _shares(d, b[0], weight), ["same", "n", "wz", "w", "known"])
        return s.select(target_id, F.when(F.col("n") > 0, F.col("same") / F.col("n")).when(F.col("known") > 0, F.col("wz") / F.col("w")).alias("z"))
    own = samples.select(F.col("lon").alias("rlon"), F.col("lat").alias("rlat"), F.col(z).cast("double").alias("_z"))
    d = within_distance(targets.select(target_id, lx, ly), own, radius, distance, lx, ly)
    w = F.when(F.col("distance") >= 1e-9, F.pow("distance", F.lit(-float(weight))))
    s = d.groupBy(target_id).agg(F.avg(F.when(F.col("distance") < 1e-9, F.col("_z"))).alias("same"), F.sum(w * F.col("_z")).alias("wz"), F.sum(w).alias("w"))
    return s.select(target_id, F.coalesce("same", F.col("wz") / F.col("w")).alias("z"))


def _shares(d, z, weight: float):
    """Of pairs: heights and numbers of samples at their target, weighted heights and weights of the others, and how many of those have heights. A sample without one has its weight."""
    import numpy as np

    at, known = d < 1e-9, ~np.isnan(z)
    w = np.where(at, 0.0, np.where(at, 1.0, d) ** -float(weight))
    z = np.where(known, z, 0.0)
    return np.where(at, z, 0.0), (at & known).astype(float), w * z, w, (known & ~at).astype(float)


def network_nodes(lines: DataFrame, line_id: str, geom: str = "geom", digits: int = 9) -> DataFrame:
    """x, y, degree and the number of lines of each end point."""
    r = F.element_at(F.element_at(F.col(geom)["parts"], 1), 1)
    ends = lines.select(line_id, F.explode(F.array(F.element_at(r, 1), F.element_at(r, -1))).alias("p"))
    ends = ends.select(line_id, F.round("p.x", digits).alias("x"), F.round("p.y", digits).alias("y"))
    return ends.groupBy("x", "y").agg(F.count(F.lit(1)).alias("degree"), F.count_distinct(line_id).alias("lines"))


def network_duplicates(lines: DataFrame, line_id: str, geom: str = "geom") -> DataFrame:
    """Ids of lines that repeat an earlier one, read in either direction, with the first of them."""
    r = F.element_at(F.element_at(F.col(geom)["parts"], 1), 1)
    told = F.transform(r, lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string")))
    ahead, behind = F.concat_ws(";", told), F.concat_ws(";", F.reverse(told))
    keyed = lines.select(line_id, F.least(ahead, behind).alias("key"))
    first = keyed.groupBy("key").agg(F.min(line_id).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return keyed.join(first, "key").filter(F.col(line_id) != F.col("first")).select(line_id, "first")


