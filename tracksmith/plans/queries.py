"""Queries over the provided tables, and the same in SQL.

The tables hold no tracks, so events stand in: a user is a trip, (ts, event_id) its order, value and event_id % 1000 its position.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import clusters, costs, features, graph, mapmatch, routes, smoothing, spatial, tables, trips

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "ts", "event_id", "event_type", F.col("value").alias("x"), (F.col("event_id") % 1000).cast("double").alias("y"))


_CLASS_SQL = {k: f"p_size % 18 IN ({', '.join(map(str, v))})" for k, v in g.CLASSES.items()}


@query(
    "SELECT l_orderkey, round(sum(l_quantity), 2) AS length, round(sum(CASE WHEN p_size % 18 > 10 THEN l_quantity ELSE 0 END), 2) AS length_cycling, "
    + ", ".join(f"round(sum(CASE WHEN {c} THEN l_quantity ELSE 0 END), 2) AS length_{k}" for k, c in _CLASS_SQL.items())
    + ", count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey"
)
def features_by_class(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")
    s = line.join(table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 18).alias("kind")), F.col("l_partkey") == F.col("p_partkey"), "left")
    of = lambda name: F.round(F.sum(F.when(g.of_class(F.col("kind"), name), F.col("l_quantity")).otherwise(0.0)), 2).alias(f"length_{name}")
    return s.groupBy("l_orderkey").agg(F.round(F.sum("l_quantity"), 2).alias("length"), of("cycling"), *[of(c) for c in g.CLASSES], F.count_if(F.col("l_returnflag") == "R").alias("n_returned"))


@query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) >= 21601000000 THEN 1 ELSE 0 END AS new
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM g)
SELECT user_id, session, count(*) AS n, min(ts) AS started, max(ts) AS ended FROM s GROUP BY user_id, session""")
def sessionise(spark, sf_dir):
    s = trips.sessions_by_gap(tracks(spark, sf_dir), "user_id", "ts", 21600, "event_id")
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


@query("""WITH h AS (SELECT user_id, date_trunc('hour', ts) AS t, min(value) AS x FROM events GROUP BY 1, 2),
 n AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS nt FROM h)
SELECT user_id, CAST(sum(CASE WHEN nt IS NULL THEN 1 ELSE date_diff('hour', t, nt) END) AS BIGINT) AS n_rows,
  CAST(sum(CASE WHEN nt IS NULL THEN 0 ELSE date_diff('hour', t, nt) - 1 END) AS BIGINT) AS n_gaps, round(sum(x), 4) AS total FROM n GROUP BY user_id""")
def gap_fill(spark, sf_dir):
    h = tracks(spark, sf_dir).groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("t")).agg(F.min("x").alias("x"))
    filled = trips.fill_gaps(h, "user_id", "t", "'1' HOUR", "t", "x")
    return filled.groupBy("user_id").agg(F.count("*").alias("n_rows"), F.count_if("is_gap").alias("n_gaps"), F.round(F.sum("x"), 4).alias("total"))


_PAIR = """WITH p AS (SELECT user_id, ts, event_id, value AS x, CAST(event_id % 1000 AS DOUBLE) AS y,
  lead(value) OVER w AS nx, lead(CAST(event_id % 1000 AS DOUBLE)) OVER w AS ny FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) """


@query(_PAIR + "SELECT user_id, round(sum(sqrt((nx-x)*(nx-x)+(ny-y)*(ny-y))), 4) AS length, count(*) AS n_pairs FROM p WHERE nx IS NOT NULL GROUP BY user_id")
def pairwise_length(spark, sf_dir):
    p = trips.pairwise(tracks(spark, sf_dir), "user_id", ["ts", "event_id"], "x", "y")
    return p.groupBy("user_id").agg(F.round(F.sum(g.distance(F.col("x"), F.col("y"), F.col("next_x"), F.col("next_y"))), 4).alias("length"), F.count("*").alias("n_pairs"))


@query("""WITH p AS (SELECT user_id, ts, event_id, value - lag(value) OVER w AS dx, CAST(event_id % 1000 - lag(event_id % 1000) OVER w AS DOUBLE) AS dy
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 q AS (SELECT *, lead(dx) OVER w AS ex, lead(dy) OVER w AS ey FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 a AS (SELECT user_id, degrees(atan2(dx*ey - dy*ex, dx*ex + dy*ey)) AS angle FROM q)
SELECT user_id, count(*) FILTER (WHERE angle > 45) AS left_turn, count(*) FILTER (WHERE angle < -45) AS right_turn FROM a GROUP BY user_id""")
def turn_counts(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = tracks(spark, sf_dir)
    t = t.select("user_id", "ts", "event_id", (F.col("x") - F.lag("x").over(w)).alias("dx"), (F.col("y") - F.lag("y").over(w)).alias("dy"))
    angle = g.turn_angle(F.col("dx"), F.col("dy"), F.lead("dx").over(w), F.lead("dy").over(w))
    t = t.select("user_id", angle.alias("a"))
    return t.groupBy("user_id").agg(F.count_if(g.is_left_turn(F.col("a"))).alias("left_turn"), F.count_if(g.is_right_turn(F.col("a"))).alias("right_turn"))


@query("""WITH p AS (SELECT user_id, value AS x, CAST(event_id % 1000 AS DOUBLE) AS y, CAST(event_id % 7 AS DOUBLE) AS z, lead(value) OVER w AS nx,
  lead(CAST(event_id % 1000 AS DOUBLE)) OVER w AS ny, lead(CAST(event_id % 7 AS DOUBLE)) OVER w AS nz FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 d AS (SELECT user_id, sqrt((nx-x)*(nx-x)+(ny-y)*(ny-y)) AS d, nz - z AS dz FROM p)
SELECT user_id, round(sum(dz/d*dz/d*d), 4) AS elev_m2, round(sum(dz/d*dz/d*dz/d*d), 4) AS elev_m3 FROM d WHERE d > 0 GROUP BY user_id""")
def slope_moments(spark, sf_dir):
    t = tracks(spark, sf_dir).withColumn("z", (F.col("event_id") % 7).cast("double"))
    s = features.slope_sums(t, "user_id", ["ts", "event_id"], "x", "y", "z")
    return s.select("user_id", F.round("elev_m2", 4).alias("elev_m2"), F.round("elev_m3", 4).alias("elev_m3"))


@query("""SELECT user_id, arg_min(event_type, (ts, event_id)) AS origin, arg_max(event_type, (ts, event_id)) AS destination, date_diff('microsecond', min(ts), max(ts)) AS duration_us FROM events GROUP BY user_id""")
def od_pair(spark, sf_dir):
    at = F.struct("ts", "event_id")
    t = tracks(spark, sf_dir)
    return t.groupBy("user_id").agg(F.min_by("event_type", at).alias("origin"), F.max_by("event_type", at).alias("destination"), F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")).alias("duration_us"))


@query("""WITH m AS (SELECT l_returnflag, sum(l_quantity) AS w, sum(l_quantity*x) AS s1, sum(l_quantity*x*x) AS s2, sum(l_quantity*x*x*x) AS s3
  FROM (SELECT *, l_extendedprice / 1000 AS x FROM lineitem) GROUP BY 1)
SELECT l_returnflag, round(s1/w, 4) AS mean, round(s2/w - s1/w*(s1/w), 3) AS variance,
  round((s3/w - 3*(s1/w)*s2/w + 2*(s1/w)*(s1/w)*(s1/w)) / pow(s2/w - s1/w*(s1/w), 1.5), 4) AS skewness FROM m""")
def weighted_moments(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", (F.col("l_extendedprice") / 1000).alias("x"))
    m = line.groupBy("l_returnflag").agg(*trips.weighted_moments("l_quantity", "x"))
    return m.select("l_returnflag", F.round("mean", 4).alias("mean"), F.round("variance", 3).alias("variance"), F.round("skewness", 4).alias("skewness"))


_COV = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("SELECT " + ", ".join(f"round(covar_samp({a}, {b}), 3) AS c{i}{j}" for i, a in enumerate(_COV) for j, b in enumerate(_COV) if i <= j) + " FROM lineitem")
def covariance(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return line.agg(*[F.round(F.covar_samp(a, b), 3).alias(f"c{i}{j}") for i, a in enumerate(_COV) for j, b in enumerate(_COV) if i <= j])


@query("""SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_acctbal - 20 < s_acctbal + 20 AND s_acctbal - 20 < c_acctbal + 20
 AND c_custkey % 100 - 5 < s_suppkey % 100 + 5 AND s_suppkey % 100 - 5 < c_custkey % 100 + 5""")
def bbox_join(spark, sf_dir):
    def boxes(df, key, bal, p):
        x, y = F.col(bal), (F.col(key) % 100).cast("double")
        return df.select(key, (x - 20).alias(f"{p}0"), (y - 5).alias(f"{p}1"), (x + 20).alias(f"{p}2"), (y + 5).alias(f"{p}3"))

    c, s = boxes(table(spark, sf_dir, "customer"), "c_custkey", "c_acctbal", "c"), boxes(table(spark, sf_dir, "supplier"), "s_suppkey", "s_acctbal", "s")
    return spatial.box_join(c, s, ("c0", "c1", "c2", "c3"), ("s0", "s1", "s2", "s3"), 80.0, ("c_custkey", "s_suppkey")).select("c_custkey", "s_suppkey")


@query("""SELECT c_custkey, s_suppkey, CAST(rank AS INT) AS rank FROM (SELECT c_custkey, s_suppkey, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - s_acctbal), s_suppkey) AS rank
  FROM customer, supplier) WHERE rank <= 3""")
def knn_join(spark, sf_dir):
    near = spatial.nearest_on_axis(table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier"), "c_custkey", "c_acctbal", "s_suppkey", "s_acctbal", 3)
    return near.select("c_custkey", "s_suppkey", "rank")


@query("""WITH n AS (SELECT c_custkey, s_suppkey, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - s_acctbal), s_suppkey) AS r FROM customer, supplier)
SELECT s_suppkey, count(*) AS n_points, CAST(sum(c_custkey) AS BIGINT) AS sum_keys FROM n WHERE r = 1 GROUP BY s_suppkey""")
def nearest_assign(spark, sf_dir):
    near = spatial.nearest_on_axis(table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier"), "c_custkey", "c_acctbal", "s_suppkey", "s_acctbal", 1)
    return near.groupBy("s_suppkey").agg(F.count("*").alias("n_points"), F.sum("c_custkey").alias("sum_keys"))


_POLYGONS = {1: [(10, 10), (200, 50), (150, 500), (10, 10)], 2: [(250, 250), (400, 250), (400, 700), (250, 700), (250, 250)], 3: [(100, 400), (300, 300), (300, 900), (100, 900), (100, 400)]}


def _ray(ring) -> str:
    return "(" + " + ".join(f"CASE WHEN ({ay} > y) <> ({by} > y) AND x < ({bx} - {ax}) * (y - {ay}) / ({by - ay}.0) + {ax} THEN 1 ELSE 0 END" for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False) if ay != by) + ") % 2 = 1"


@query("SELECT event_id, CASE " + " ".join(f"WHEN {_ray(r)} THEN {k}" for k, r in _POLYGONS.items()) + " END AS region FROM (SELECT event_id, value AS x, CAST(event_id % 1000 AS DOUBLE) AS y FROM events)")
def point_in_polygon(spark, sf_dir):
    t, region = tracks(spark, sf_dir), None
    for k, ring in _POLYGONS.items():
        points = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ring])
        inside = g.in_polygon(points, F.col("x"), F.col("y"))
        region = F.when(inside, k) if region is None else region.when(inside, k)
    return t.select("event_id", region.alias("region"))


_REGIONS = """SELECT n_nationkey AS region, n_nationkey % 5 * 100.0 - 40 AS x0, n_nationkey % 5 * 100.0 + 85 AS x1, n_nationkey * 40.0 - 30 AS y0, n_nationkey * 40.0 + 90 AS y1 FROM nation"""


@query(f"""WITH r AS ({_REGIONS}), p AS (SELECT event_id, value + 0.003 AS x, CAST(event_id % 1000 AS DOUBLE) + 0.5 AS y FROM events)
SELECT event_id, min(region) AS region FROM p LEFT JOIN r ON x > x0 AND x < x1 AND y > y0 AND y < y1 GROUP BY event_id""")
def region_join(spark, sf_dir):
    """Boxes made of the nations' keys as rings; a point in several belongs to the first."""
    n = F.col("n_nationkey")
    x0, x1, y0, y1 = n % 5 * 100.0 - 40, n % 5 * 100.0 + 85, n * 40.0 - 30, n * 40.0 + 90
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))])
    regions = table(spark, sf_dir, "nation").select(n.alias("region"), ring.alias("ring"))
    t = tracks(spark, sf_dir).select("event_id", (F.col("x") + 0.003).alias("x"), (F.col("y") + 0.5).alias("y"))
    return spatial.regions_of(t, regions, "event_id", "x", "y", 100.0)


@query("""WITH c AS (SELECT c_custkey, CAST(c_custkey % 97 AS DOUBLE) AS x, CAST(c_custkey % 13 AS DOUBLE) AS y FROM customer), s AS (SELECT s_suppkey, CAST(s_suppkey % 31 AS DOUBLE) AS x, CAST(s_suppkey % 5 AS DOUBLE) AS y FROM supplier)
SELECT c_custkey, s_suppkey, round(distance, 6) AS distance, CAST(rank AS INT) AS rank FROM (SELECT c_custkey, s_suppkey, d AS distance, row_number() OVER (PARTITION BY c_custkey ORDER BY d, s_suppkey) AS rank
  FROM (SELECT c_custkey, s_suppkey, sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)) AS d FROM c, s)) WHERE rank <= 3""")
def plane_knn(spark, sf_dir):
    """Places on a small lattice, so that distances tie."""
    place = lambda df, key, a, b: df.select(key, (F.col(key) % a).cast("double").alias("x"), (F.col(key) % b).cast("double").alias("y"))
    near = spatial.nearest_in_plane(place(table(spark, sf_dir, "customer"), "c_custkey", 97, 13), place(table(spark, sf_dir, "supplier"), "s_suppkey", 31, 5), "c_custkey", "s_suppkey", 3, tables.saver(spark, "plane"))
    return near.select("c_custkey", "s_suppkey", F.round("distance", 6).alias("distance"), "rank")


@query(_PAIR.replace("lead(", "lag(") + "SELECT event_id, round(sum(CASE WHEN nx IS NULL THEN 0 ELSE sqrt((nx-x)*(nx-x)+(ny-y)*(ny-y)) END) OVER (PARTITION BY user_id ORDER BY ts, event_id), 3) AS travelled FROM p")
def cumulative_distance(spark, sf_dir):
    return trips.cumulative_distance(tracks(spark, sf_dir), "user_id", ["ts", "event_id"], "x", "y").select("event_id", F.round("travelled", 3).alias("travelled"))


@query("""WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS c FROM events)
SELECT user_id, max(CASE WHEN r = 1 THEN event_id END) AS first_id, CAST(sum(CASE WHEN r <= 5 THEN event_id ELSE 0 END) AS BIGINT) AS first_five, CAST(sum(CASE WHEN r > 5 THEN event_id ELSE 0 END) AS BIGINT) AS rest FROM n GROUP BY user_id""")
def take_and_drop(spark, sf_dir):
    t, by = tracks(spark, sf_dir).select("user_id", "ts", "event_id"), ["ts", "event_id"]
    one = trips.first(t, "user_id", by).select("user_id", F.col("event_id").alias("first_id"))
    five = trips.take(t, "user_id", by, 5).groupBy("user_id").agg(F.sum("event_id").alias("first_five"))
    rest = trips.drop(t, "user_id", by, 5).groupBy("user_id").agg(F.sum("event_id").alias("rest"))
    return one.join(five, "user_id").join(rest, "user_id", "left").withColumn("rest", F.coalesce("rest", F.lit(0).cast("long")))


@query("""WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click' AND event_id % 11 = 0), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND event_id % 7 = 0)
SELECT user_id, true AS entered FROM b WHERE user_id NOT IN (SELECT user_id FROM a) UNION ALL SELECT user_id, false FROM a WHERE user_id NOT IN (SELECT user_id FROM b)""")
def set_changes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return spatial.changes(e.where("event_type = 'click' AND event_id % 11 = 0"), e.where("event_type = 'purchase' AND event_id % 7 = 0"), "user_id")


@query("""SELECT c_custkey, c_mktsegment AS segment, CASE WHEN c_custkey % 2 = 0 THEN 'later' ELSE 'first' END AS status, CAST(CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END + 1 AS INT) AS n_keys FROM customer""")
def merge_maps(spark, sf_dir):
    even = F.col("c_custkey") % 2 == 0
    a = F.create_map(F.lit("segment"), F.lit("none"), F.lit("status"), F.lit("first"))
    b = F.when(even, F.create_map(F.lit("status"), F.lit("later"), F.lit("more"), F.lit("x"))).otherwise(F.create_map(F.lit("status"), F.lit("first")))
    m = table(spark, sf_dir, "customer").select("c_custkey", g.merge_maps(a, b, F.create_map(F.lit("segment"), F.col("c_mktsegment"))).alias("m"))
    return m.select("c_custkey", F.col("m")["segment"].alias("segment"), F.col("m")["status"].alias("status"), F.size("m").alias("n_keys"))


_CENTERS = [(1, 100.0, 100.0), (2, 250.0, 500.0), (3, 400.0, 900.0)]


@query("WITH c(label, cx, cy) AS (VALUES " + ", ".join(map(str, _CENTERS)) + ") SELECT DISTINCT label, user_id FROM events, c WHERE sqrt((value-cx)*(value-cx) + (event_id%1000-cy)*(event_id%1000-cy)) < 100")
def distance_join(spark, sf_dir):
    centers = spark.createDataFrame(_CENTERS, "label int, cx double, cy double")
    return spatial.within_distance(tracks(spark, sf_dir), centers, 100.0).select("label", "user_id").distinct()


@query("SELECT user_id FROM events WHERE event_type IN ('click', 'purchase', 'error') GROUP BY user_id HAVING count(DISTINCT event_type) = 3")
def relational_division(spark, sf_dir):
    return spatial.visits_all(table(spark, sf_dir, "events"), "user_id", "event_type", ["click", "purchase", "error"])


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_prune(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(orders, "c_custkey", "left_semi")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 7 = 0)")
def anti_prune(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(orders, "c_custkey", "left_anti")


_TRANSFORM = (0.0, 62.5, 0.0, 1000.0, 0.0, -62.5)


@query("""SELECT event_id, CAST(trunc((1000.0 - event_id % 1000) / 62.5) AS INT) AS line, CAST(trunc(value / 62.5) AS INT) AS pixel,
  CAST(trunc((1000.0 - event_id % 1000) / 62.5) * 10 + trunc(value / 62.5) AS DOUBLE) AS sampled FROM events""")
def raster_sample(spark, sf_dir):
    grid = spark.range(17 * 17).select((F.col("id") / 17).cast("int").alias("line"), (F.col("id") % 17).cast("int").alias("pixel"))
    grid = grid.withColumn("sampled", (F.col("line") * 10 + F.col("pixel")).cast("double"))
    t = tracks(spark, sf_dir).withColumn("at", g.pixel_of(_TRANSFORM, F.col("x"), F.col("y")))
    return t.select("event_id", "at.line", "at.pixel").join(F.broadcast(grid), ["line", "pixel"], "left").select("event_id", "line", "pixel", "sampled")


def _krueger() -> str:
    """The projection in SQL, from the same series."""
    e, radius, alpha, _ = g._series()
    x = " + ".join(["eta", *[f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(alpha, 1)]])
    y = " + ".join(["xi", *[f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(alpha, 1)]])
    return f"""WITH c AS (SELECT c_custkey, radians(-75 + c_custkey % 300 / 100 - {g.LON0!r}) AS lam, sin(radians(45 + c_custkey % 170 / 100)) AS s FROM customer),
 t AS (SELECT *, sinh(atanh(s) - {e!r} * atanh({e!r} * s)) AS t FROM c), a AS (SELECT *, atan2(t, cos(lam)) AS xi, asinh(sin(lam) / sqrt(t * t + cos(lam) * cos(lam))) AS eta FROM t)
SELECT c_custkey, round({g.FALSE_EASTING!r} + {g.K0 * radius!r} * ({x}), 3) AS x, round({g.K0 * radius!r} * ({y}), 3) AS y, CAST(0 AS DOUBLE) AS dlon, CAST(0 AS DOUBLE) AS dlat FROM a"""


@query(_krueger())
def tm_projection(spark, sf_dir):
    t = table(spark, sf_dir, "customer").select("c_custkey", (-75 + F.col("c_custkey") % 300 / 100).alias("lon"), (45 + F.col("c_custkey") % 170 / 100).alias("lat"))
    t = t.withColumn("p", g.to_plane(F.col("lon"), F.col("lat"))).withColumn("b", g.to_geographic(F.col("p.x"), F.col("p.y")))
    return t.select("c_custkey", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"), (F.round(F.col("b.lon") - F.col("lon"), 9) + 0.0).alias("dlon"), (F.round(F.col("b.lat") - F.col("lat"), 9) + 0.0).alias("dlat"))


def _horner() -> str:
    poly = repr(g.ERFC_FIT[-1])
    for c in reversed(g.ERFC_FIT[:-1]):
        poly = f"(({poly}) * t + ({c!r}))"
    return poly


@query(f"""WITH s AS (SELECT p_partkey, (p_size - 25) / 8.0 AS x FROM part), t AS (SELECT *, 1 / (1 + 0.5 * abs(x)) AS t FROM s),
 r AS (SELECT *, ln(t) - x * x + {_horner()} AS v FROM t) SELECT p_partkey, round(CASE WHEN x >= 0 THEN v ELSE ln(2 - exp(v)) END, 6) AS logerfc FROM r""")
def logerfc(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(g.log_erfc((F.col("p_size") - 25) / 8), 6).alias("logerfc"))


@query("SELECT event_id, round(value / 1.96, 6) AS sigma, date_trunc('second', ts) AS parsed FROM events")
def accuracy_scale(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.date_format(F.col("ts"), "yyyy-MM-dd HH:mm:ss")
    return e.select("event_id", F.round(trips.sigma_of(F.col("value")), 6).alias("sigma"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz").alias("parsed"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, 1 AS n_tags FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def tag_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>").alias("tags"))
    kept = F.map_filter("tags", lambda k, v: k.isin("k", "highway", "oneway"))
    return e.select("event_id", kept["k"].alias("k"), F.size(kept).alias("n_tags")).where(F.col("k").isNotNull())


@query("""SELECT 1 AS layer, c_custkey AS way_id, c_nationkey AS kind, c_mktsegment AS segment FROM customer
 UNION ALL SELECT 2, s_suppkey, s_nationkey + 10, NULL FROM supplier""")
def union_layers(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit(1).alias("layer"), F.col("c_custkey").alias("way_id"), F.col("c_nationkey").alias("kind"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.lit(2).alias("layer"), F.col("s_suppkey").alias("way_id"), (F.col("s_nationkey") + 10).alias("kind"))
    return c.unionByName(s, allowMissingColumns=True)


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type")
def later_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return spatial.latest(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""WITH f AS (SELECT user_id FROM events GROUP BY user_id ORDER BY min(ts), user_id LIMIT 10)
SELECT user_id, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM f) GROUP BY user_id""")
def limit_trips(spark, sf_dir):
    return trips.first_trips(tracks(spark, sf_dir), "user_id", "ts", 10).groupBy("user_id").agg(F.count("*").alias("n"))


_LINE = [(0.0, 0.0), (100.0, 300.0), (300.0, 300.0), (400.0, 900.0)]


def _line_sql() -> str:
    """The nearest place on _LINE, piece by piece: the least distance, the first piece among equals."""
    parts, done = [], 0.0
    for k, ((ax, ay), (bx, by)) in enumerate(zip(_LINE, _LINE[1:], strict=False)):
        dx, dy = bx - ax, by - ay
        t = f"least(greatest(((x - {ax}) * {dx} + (y - {ay}) * {dy}) / {dx * dx + dy * dy}, 0.0), 1.0)"
        size = math.hypot(dx, dy)
        parts.append(f"SELECT event_id, {k} AS k, sqrt(pow({ax} + {t} * {dx} - x, 2) + pow({ay} + {t} * {dy} - y, 2)) AS d, {done!r} + {t} * {size!r} AS m FROM p")
        done += size
    return ("WITH p AS (SELECT event_id, value AS x, CAST(event_id % 1000 AS DOUBLE) AS y FROM events), s AS (" + " UNION ALL ".join(parts)
            + "), b AS (SELECT event_id, arg_min(d, (d, k)) AS d, arg_min(m, (d, k)) AS m FROM s GROUP BY event_id)"
            " SELECT event_id, round(d, 4) AS distance, round(m, 4) AS measure, round(d, 4) AS back FROM b")  # fmt: skip


@query(_line_sql())
def linear_reference(spark, sf_dir):
    line = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in _LINE])
    t = tracks(spark, sf_dir).withColumn("near", g.nearest_on_line(line, F.col("x"), F.col("y")))
    t = t.withColumn("at", g.point_at(line, F.col("near.measure")))
    return t.select("event_id", F.round("near.distance", 4).alias("distance"), F.round("near.measure", 4).alias("measure"), F.round(g.distance(F.col("x"), F.col("y"), F.col("at.x"), F.col("at.y")), 4).alias("back"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS cost, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS norm FROM embeddings")
def dot_cost(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    weights = F.transform("v", lambda _: F.lit(1.0))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    return e.select("vec_id", F.round(dot("v", weights), 4).alias("cost"), F.round(F.sqrt(dot("v", "v")), 4).alias("norm"))


@query("""SELECT o_orderkey, (o_orderkey % 3 - 1 = 0) OR ((o_orderkey % 3 - 1 > 0) = ((o_custkey > o_orderkey) <> (o_orderstatus = 'F'))) AS valid,
 NOT ((o_orderkey % 3 - 1 = 0) OR ((o_orderkey % 3 - 1 > 0) = ((o_custkey > o_orderkey) <> (o_orderstatus = 'F')))) AS wrong FROM orders""")
def valid_circulation(spark, sf_dir):
    o, sens = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 3 - 1
    ordered = g.digitised_order(F.col("o_custkey"), F.col("o_orderkey"), F.col("o_orderstatus") == "F")
    return o.select("o_orderkey", g.circulation_ok(sens, ordered).alias("valid"), g.wrong_way(sens, ordered).alias("wrong"))


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS u, (n_nationkey + 1) % 25 AS v FROM nation UNION SELECT n_nationkey, (n_nationkey + 7) % 25 FROM nation),
 r(node, hops) AS (SELECT 0, 0 UNION SELECT e.v, r.hops + 1 FROM r JOIN e ON r.node = e.u WHERE r.hops < 25)
SELECT node, min(hops) AS hops FROM r GROUP BY node""")
def adjacency_paths(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("u"))
    edges = n.select("u", ((F.col("u") + 1) % 25).alias("v")).union(n.select("u", ((F.col("u") + 7) % 25).alias("v")))
    return graph.hops(edges, n.where("u = 0").select(F.col("u").alias("node")), tables.saver(spark, "hops"))


@query()
def snap_nodes(spark, sf_dir):
    """Lines between the positions of a user's events, 100 m to a unit, as streets."""
    t = trips.pairwise(tracks(spark, sf_dir), "user_id", ["ts", "event_id"], "x", "y")
    ends = F.array(*[F.struct((F.col(x) * 100).alias("x"), (F.col(y) * 100).alias("y")) for x, y in (("x", "y"), ("next_x", "next_y"))])
    lines = t.select(F.lit(0).alias("layer"), F.col("event_id").alias("seq"), F.lit(0).alias("part"), ends.alias("coords"))
    _, edges = graph.build_graph(graph.union_layers(lines), tables.saver(spark, "snap"))
    return edges.select(F.col("seq").alias("event_id"), "u", "v", "k", "ord", F.round("length", 4).alias("length"))


def _town(spark, n: int = 8, size: float = 200.0) -> DataFrame:
    """A square grid of streets, classes in turn."""
    at = spark.range(n * n).select(F.floor(F.col("id") / n).alias("i"), (F.col("id") % n).alias("j"), F.explode(F.array(F.lit(0), F.lit(1))).alias("across"))
    i2, j2 = F.col("i") + 1 - F.col("across"), F.col("j") + F.col("across")
    point = lambda i, j: F.struct((j * size).alias("x"), (i * size).alias("y"))
    return at.where((i2 < n) & (j2 < n)).select(
        (F.col("i") * n + F.col("j")).alias("u"), (i2 * n + j2).alias("v"), F.lit(0).alias("k"), ((F.col("i") + 2 * F.col("j") + F.col("across")) % 18).cast("int").alias("type"),
        F.lit(0).alias("sens"), F.lit(True).alias("ord"), F.array(point(F.col("i"), F.col("j")), point(i2, j2)).alias("coords"),
    )


def _rides(spark, sf_dir, samples: int, still: int = 0) -> DataFrame:
    """Points of a ride a supplier: east along a street from a crossing, after standing there, then north."""
    key = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(key.cast("string").alias("trip_id"), (key % 4 * 200).cast("double").alias("x0"), (key % 5 * 200).cast("double").alias("y0"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(samples + still).cast("long"))).alias("idx"))
    m = F.greatest(F.col("idx") - still, F.lit(0)) * 5.0
    x, y = F.col("x0") + F.least(m, F.lit(200.0)), F.col("y0") + F.greatest(m - 200.0, F.lit(0.0))
    return s.select("trip_id", "idx", x.alias("x"), y.alias("y"), F.when(F.col("idx") < still, 0.0).otherwise(5.0).alias("speed"), F.lit(2.0).alias("acc_h"), F.lit(2.0).alias("acc_v"))


@query()
def map_match(spark, sf_dir):
    states = tables.saver(spark, "match")(smoothing.smooth_trips(_rides(spark, sf_dir, 60)), "states")
    seg = mapmatch.match_trips(states, _town(spark))
    return seg.select("trip_id", "seg_no", "edge.u", "edge.v", "status", F.round("begin.projection", 3).alias("begin"), F.round("end.projection", 3).alias("end"))


@query()
def matched_features(spark, sf_dir):
    states = tables.saver(spark, "match")(smoothing.smooth_trips(_rides(spark, sf_dir, 60)), "states")
    f = features.trip_features(mapmatch.accepted(mapmatch.match_trips(states, _town(spark))), _town(spark))
    return f.select("trip_id", "left_turn", "right_turn", "intersections", "duration", *[F.round(c, 3).alias(c) for c in f.columns if c.startswith("length") or c == "avg_speed"])


@query()
def poi_cluster(spark, sf_dir):
    save = tables.saver(spark, "places")
    _, visits = clusters.cluster_trips(save(smoothing.smooth_trips(_rides(spark, sf_dir, 40, still=30)), "states"), save)
    return clusters.trips_by_place(visits)


def _ends(df: DataFrame, key) -> DataFrame:
    at = lambda k: ((key * k) % 1400).cast("double")
    return df.select(key.cast("string").alias("trip_id"), at(131).alias("x0"), at(373).alias("y0"), at(617).alias("x1"), at(911).alias("y1"))


@query()
def route_choice(spark, sf_dir):
    ends = _ends(table(spark, sf_dir, "supplier"), F.col("s_suppkey"))
    return routes.route_vectors(ends, _town(spark), costs.MATCH_WEIGHTS).select("trip_id", F.transform("vector", lambda v: F.round(v, 4)).alias("vector"))


@query()
def ioc_fit(spark, sf_dir):
    """The weights learnt from the cheapest routes between ends made of the suppliers' keys."""
    save = tables.saver(spark, "learn")
    ends, town = _ends(table(spark, sf_dir, "supplier"), F.col("s_suppkey")), save(_town(spark), "town")
    chosen = routes.route_vectors(ends, town, costs.MATCH_WEIGHTS).where("vector is not null").join(ends, "trip_id")
    examples = save(chosen.select("trip_id", "x0", "y0", "x1", "y1", *[F.col("vector")[k].alias(c) for k, c in enumerate(routes.VECTOR)]), "examples")
    weights, _, axes = routes.learn_weights(examples, town)
    return spark.createDataFrame([(c, round(float(w), 6)) for c, w in zip(routes.VECTOR, axes @ weights, strict=True)], "feature string, weight double")


@query()
def kalman_smooth(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = tracks(spark, sf_dir).withColumn("idx", (F.row_number().over(w) - 1).cast("long"))
    points = t.select(F.col("user_id").cast("string").alias("trip_id"), "idx", (F.col("idx") * 3 + F.col("x") / 500).alias("x"), (F.col("idx") * 2 + F.col("y") / 1000).alias("y"), F.lit(3.6).alias("speed"), F.lit(2.0).alias("acc_h"), F.lit(2.0).alias("acc_v"))
    s = smoothing.smooth_trips(points)
    return s.select("trip_id", "idx", F.round(F.col("x")[0], 6).alias("px"), F.round(F.col("x")[1], 6).alias("py"))
