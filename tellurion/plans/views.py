"""The test tables as points, zones and tracks, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurion.functions import types as T

ZONE_W, ZONE_H = 12.26, 7.1


def pt(key):
    k = F.col(key) if isinstance(key, str) else key
    return 73.5 + (k * 7919) % 61300 / 1000, 18.0 + (k * 6151) % 35500 / 1000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def customer_pt(spark: SparkSession, sf: str) -> DataFrame:
    x, y = pt("c_custkey")
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), x.alias("lon"), y.alias("lat"), F.col("c_acctbal").alias("z"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))


def supplier_pt(spark: SparkSession, sf: str) -> DataFrame:
    x, y = pt("s_suppkey")
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sid"), x.alias("rlon"), y.alias("rlat"), F.col("s_acctbal").alias("sz"))


def zones(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    x0, y0 = 73.5 + ZONE_W * (n % 5), 18.0 + ZONE_H * F.floor(n / 5)
    x1, y1 = x0 + ZONE_W, y0 + ZONE_H
    rings = F.array(T.ring([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]))
    return table(spark, sf, "nation").select(n.cast("long").alias("zone"), F.col("n_name").alias("zone_name"), F.col("n_regionkey").alias("region"), T.geometry("Polygon", F.array(rings)).alias("geom"))


def pentagons(spark: SparkSession, sf: str) -> DataFrame:
    """A notched pentagon in each zone, which isn't a rectangle nor convex for odd zones."""
    n = F.col("n_nationkey")
    x0, y0 = 73.5 + ZONE_W * (n % 5), 18.0 + ZONE_H * F.floor(n / 5)
    inner = F.when(n % 2 == 1, y0 + 2.0).otherwise(y0 - 0.5)
    ring = T.ring([(x0 + 1.0, y0 + 0.5), (x0 + 6.0, inner), (x0 + 11.0, y0 + 0.5), (x0 + 9.0, y0 + 6.5), (x0 + 3.0, y0 + 6.5), (x0 + 1.0, y0 + 0.5)])
    return table(spark, sf, "nation").select(n.cast("long").alias("zone"), T.geometry("Polygon", F.array(F.array(ring))).alias("geom"))


def tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events in order of time as a line; users with one event have none."""
    x, y = pt("event_id")
    rows = table(spark, sf, "events").select("user_id", F.struct("ts", "event_id", x.alias("x"), y.alias("y")).alias("e"))
    line = rows.groupBy("user_id").agg(F.sort_array(F.collect_list("e")).alias("es")).filter(F.size("es") >= 2)
    return line.select("user_id", T.geometry("LineString", F.array(F.array(F.transform("es", lambda e: T.position(e["x"], e["y"]))))).alias("geom"))


def streets(spark: SparkSession, sf: str) -> DataFrame:
    """A short line of three positions from each customer's point."""
    k = F.col("id")
    mx, my = F.col("lon") + 1.25 + k % 7 * 0.1, F.col("lat") + 0.5 - k % 5 * 0.25
    ends = [("lon", "lat"), (mx, my), (mx + 1.0, my + (k % 3 - 1) * 1.0)]
    return customer_pt(spark, sf).select("id", T.geometry("LineString", F.array(F.array(T.ring(ends)))).alias("geom"))


def lattice(spark: SparkSession, sf: str) -> DataFrame:
    """A height for each nation at the nodes of a lattice of five by five: the mean balance of its customers."""
    n = F.col("c_nationkey")
    rows = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("h"))
    return rows.select(F.lit(1).alias("g"), (100 + n % 5 * 2.0).alias("lon"), (30 + F.floor(n / 5) * 1.5).alias("lat"), F.col("h").alias("z"))


# The same in SQL.
def sql_pt(k: str) -> tuple[str, str]:
    return f"(73.5::DOUBLE + (({k} * 7919) % 61300) / 1000::DOUBLE)", f"(18.0::DOUBLE + (({k} * 6151) % 35500) / 1000::DOUBLE)"


_cx, _cy = sql_pt("c_custkey")
_sx, _sy = sql_pt("s_suppkey")
_ex, _ey = sql_pt("event_id")
CUSTOMER = f"cp AS (SELECT c_custkey AS id, {_cx} AS lon, {_cy} AS lat, c_acctbal AS z, c_nationkey AS nation, c_mktsegment AS segment FROM customer)"
SUPPLIER = f"sp AS (SELECT s_suppkey AS sid, {_sx} AS rlon, {_sy} AS rlat, s_acctbal AS sz FROM supplier)"
ZONES = f"""zn AS (SELECT n_nationkey::BIGINT AS zone, n_name AS zone_name, n_regionkey AS region,
  73.5::DOUBLE + {ZONE_W}::DOUBLE * (n_nationkey % 5) AS x0, 18.0::DOUBLE + {ZONE_H}::DOUBLE * floor(n_nationkey / 5) AS y0 FROM nation),
z AS (SELECT *, x0 + {ZONE_W}::DOUBLE AS x1, y0 + {ZONE_H}::DOUBLE AS y1 FROM zn)"""
PENTAGONS = """pg AS (SELECT zone, unnest([x0 + 1.0::DOUBLE, x0 + 6.0::DOUBLE, x0 + 11.0::DOUBLE, x0 + 9.0::DOUBLE, x0 + 3.0::DOUBLE]) AS x,
  unnest([y0 + 0.5::DOUBLE, CASE WHEN zone % 2 = 1 THEN y0 + 2.0::DOUBLE ELSE y0 - 0.5::DOUBLE END, y0 + 0.5::DOUBLE, y0 + 6.5::DOUBLE, y0 + 6.5::DOUBLE]) AS y, unnest([0, 1, 2, 3, 4]) AS i FROM zn),
pe AS (SELECT a.zone, a.i, a.x AS px, a.y AS py, b.x AS qx, b.y AS qy FROM pg a JOIN pg b ON a.zone = b.zone AND b.i = (a.i + 1) % 5)"""
TRACKS = f"""tp AS (SELECT user_id, {_ex} AS x, {_ey} AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
t AS (SELECT * FROM tp WHERE n >= 2),
ts AS (SELECT a.user_id, a.i, a.x AS px, a.y AS py, b.x AS qx, b.y AS qy FROM t a JOIN t b ON a.user_id = b.user_id AND b.i = a.i + 1)"""
STREETS = CUSTOMER + """, sm AS (SELECT *, lon + 1.25::DOUBLE + id % 7 * 0.1::DOUBLE AS mx, lat + 0.5::DOUBLE - id % 5 * 0.25::DOUBLE AS my FROM cp),
sv AS (SELECT id, unnest([0, 1, 2]) AS i, unnest([lon, mx, mx + 1.0::DOUBLE]) AS x, unnest([lat, my, my + (id % 3 - 1) * 1.0::DOUBLE]) AS y FROM sm),
ss AS (SELECT a.id, a.i, a.x AS px, a.y AS py, b.x AS qx, b.y AS qy FROM sv a JOIN sv b ON a.id = b.id AND b.i = a.i + 1)"""
LATTICE = """ln AS (SELECT c_nationkey % 5 AS i, c_nationkey // 5 AS j, avg(c_acctbal) AS z FROM customer GROUP BY c_nationkey),
lx AS (SELECT *, 100 + i * 2.0::DOUBLE AS x, 30 + j * 1.5::DOUBLE AS y FROM ln),
tri AS (SELECT a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz
  FROM lx a JOIN lx c ON c.i = a.i + 1 AND c.j = a.j + 1 JOIN lx b ON (b.i = a.i + 1 AND b.j = a.j) OR (b.i = a.i AND b.j = a.j + 1))"""
