"""Queries that write a table in one of the formats, read it back by the readers, and say what SQL says of the table; and single
steps of the estimator. Files go below the folder that driver and executors share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import smoothing, tables
from ..operators.kalman import State
from ..sources import described, geojson, gps, osm, raster, shapefile
from .queries import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]


@query("""WITH e AS (SELECT user_id, count(*) AS c, sum(row_number) AS s FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS row_number FROM events) GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS trip_id, (c - 1) * (1 + user_id % 3) + 1 AS n_rows, (c - 1) * (user_id % 3) AS n_gaps, CAST(s AS DOUBLE) AS speeds, CAST(1 AS DOUBLE) AS sigma FROM e""")
def csv_trips(spark, sf_dir):
    """A log of the users' events as CSV, a row every 1, 2 or 3 seconds, loaded as trips with a row for every second."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    e = table(spark, sf_dir, "events").select("user_id", n.alias("n"))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("n") * (1 + F.col("user_id") % 3))
    log = e.select(
        F.col("user_id").alias("id"), F.date_format(at, gps.TIME_FORMAT).alias("recorded_at"), (45 + F.col("n") % 100 / 1000).alias("latitude"), (-73 - F.col("n") % 100 / 1000).alias("longitude"),
        F.col("n").alias("speed"), F.lit(1.96).alias("hort_accuracy"),
    )
    log.repartitionByRange("id").sortWithinPartitions("id", "recorded_at").write.csv(to := f"{tables.folder(spark, 'csv')}/log", header=True)
    t = gps.load_trips(spark, to, runs=False)
    return t.groupBy("trip_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("x").isNull()).alias("n_gaps"), F.sum("speed").alias("speeds"), F.round(F.max("acc_h"), 9).alias("sigma"))


@query("SELECT c_custkey AS id, c_mktsegment AS segment, 'Point' AS type, CAST(c_custkey % 97 AS DOUBLE) AS x, c_acctbal AS y FROM customer")
def geojson_points(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.struct((F.col("c_custkey") % 97).cast("double").alias("x"), F.col("c_acctbal").cast("double").alias("y")).alias("p"))
    geojson.write_features(c, geojson.feature_text("Point", F.col("p"), id=F.col("c_custkey"), segment=F.col("c_mktsegment")), to := f"{tables.folder(spark, 'geojson')}/points")
    back = geojson.read_features(spark, to, "id: BIGINT, segment: STRING", lines=True).withColumn("c", F.from_json("coordinates", "array<double>"))
    return back.select("properties.id", "properties.segment", "type", F.col("c")[0].alias("x"), F.col("c")[1].alias("y"))


def _shapes(spark, sf_dir) -> str:
    raster.register(spark)
    k = F.col("s_suppkey")
    at = lambda a, b: F.struct((k % a).cast("double").alias("x"), (k % b).cast("double").alias("y"))
    lines = table(spark, sf_dir, "supplier").select(k.alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").cast("double").alias("balance"), F.array(F.array(at(10, 7), at(13, 9), at(17, 4))).alias("parts"))
    lines.write.format("shapefile").mode("append").save(to := f"{tables.folder(spark, 'shapes')}/lines")
    return to


@query("SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, 3 AS shape_type, 3 AS n_points, CAST(s_suppkey % 10 AS DOUBLE) AS x0, CAST(s_suppkey % 4 AS DOUBLE) AS y2 FROM supplier")
def shapefile_lines(spark, sf_dir):
    back = shapefile.read_folder(spark, _shapes(spark, sf_dir))
    line = F.col("parts")[0]
    return back.select("id", F.trim("name").alias("name"), F.round("balance", 2).alias("balance"), "shape_type", F.size(line).alias("n_points"), line[0].x.alias("x0"), line[2].y.alias("y2"))


@query("SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, false AS deleted FROM supplier")
def dbase_rows(spark, sf_dir):
    back = shapefile.read_folder(spark, _shapes(spark, sf_dir), "dbase")
    return back.select("id", F.trim("name").alias("name"), F.round("balance", 2).alias("balance"), F.col("_deleted").alias("deleted"))


@query("""SELECT p_partkey AS way_id, CASE WHEN p_partkey % 3 = 0 THEN 'path' ELSE 'steps' END AS highway, p_brand AS name, CAST(2 + p_partkey % 4 AS INT) AS n_nodes,
 CAST(p_partkey % 50 * (2 + p_partkey % 4) + (2 + p_partkey % 4) * (1 + p_partkey % 4) // 2 AS BIGINT) AS node_sum FROM part WHERE p_partkey % 5 <> 0""")
def osm_ways(spark, sf_dir):
    """Ways made of the parts' keys as XML; one in five has no highway tag."""
    k = F.col("p_partkey")
    refs = F.array_join(F.transform(F.sequence(F.lit(0), (1 + k % 4).cast("int")), lambda i: F.format_string('<nd ref="%d"/>', k % 50 + i)), "")
    tag = F.when(k % 5 != 0, F.format_string('<tag k="highway" v="%s"/>', F.when(k % 3 == 0, "path").otherwise("steps"))).otherwise('<tag k="building" v="yes"/>')
    xml = F.concat(F.format_string('<way id="%d">', k), refs, tag, F.format_string('<tag k="colour" v="red"/><tag k="name" v="old"/><tag k="name" v="%s"/></way>', F.col("p_brand")))

    def document(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:  # one a task
        yield pd.DataFrame({"value": ["<osm>"]})
        yield from batches
        yield pd.DataFrame({"value": ["</osm>"]})

    table(spark, sf_dir, "part").select(xml.alias("value")).mapInPandas(document, "value string").write.text(to := f"{tables.folder(spark, 'osm')}/ways")
    w = osm.read_ways(spark, to)
    return w.select("way_id", F.col("tags")["highway"].alias("highway"), F.col("tags")["name"].alias("name"), F.size("nodes").alias("n_nodes"), F.aggregate("nodes", F.lit(0).cast("long"), lambda a, x: a + x).alias("node_sum"))


@query("""SELECT CAST(n AS VARCHAR) AS trip_id, CASE WHEN n % 2 = 0 THEN total * 2 ELSE total END AS length, CASE WHEN n % 2 = 0 THEN NULL ELSE CAST(n AS INT) END AS left_turn
 FROM (SELECT s_nationkey AS n, round(sum(s_acctbal), 2) AS total FROM supplier GROUP BY s_nationkey)""")
def features_merged(spark, sf_dir):
    """Features written as JSON, some of them again as CSV: the later folder wins."""
    n = F.col("s_nationkey")
    f = table(spark, sf_dir, "supplier").groupBy(n).agg(F.round(F.sum("s_acctbal"), 2).cast("double").alias("length")).select(n.cast("string").alias("trip_id"), "length", n.cast("int").alias("left_turn"))
    at = tables.folder(spark, "described")
    described.write(f, f"{at}/all.json")
    described.write(f.where("left_turn % 2 = 0").select("trip_id", (F.col("length") * 2).alias("length"), F.lit(None).cast("int").alias("left_turn")), f"{at}/even.csv")
    return described.read(spark, [f"{at}/all.json", f"{at}/even.csv"], "trip_id STRING, length DOUBLE, left_turn INT")


@query("""WITH s AS (SELECT c_custkey, CAST(c_custkey % 17 AS DOUBLE) AS a, CAST(c_custkey % 5 AS DOUBLE) AS b, 1.0 + c_custkey % 7 AS p, 0.5 + c_custkey % 3 AS q, sqrt(abs(c_acctbal)) AS y, 2.0 + c_custkey % 4 AS r FROM customer),
 t AS (SELECT *, p + q + 2 AS pp, y - a - b AS gap FROM s), u AS (SELECT *, pp + r AS e, a + b + pp / (pp + r) * gap AS x0, b + q / (pp + r) * gap AS x1, pp - pp * pp / (pp + r) AS p00, q - pp * q / (pp + r) AS p01, q + 2 - q * q / (pp + r) AS p11 FROM t)
SELECT c_custkey, round(gap * gap / e / 2, 6) AS cost, round(x0, 6) AS place, round(x1, 6) AS speed, round(p00, 6) AS p00, round(p11, 6) AS p11, round(x1 * x1 / p11 / 2, 6) AS standing, round(x0 - p01 / p11 * x1, 6) AS held FROM u""")
def kalman_steps(spark, sf_dir):
    """A move, a measured place, the distance from standing still, and standing still imposed, on a state of a place and a speed."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        k, (k % 17).cast("double").alias("a"), (k % 5).cast("double").alias("b"), (1.0 + k % 7).alias("p"), (0.5 + k % 3).alias("q"), F.sqrt(F.abs("c_acctbal")).alias("y"), (2.0 + k % 4).alias("r")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f, place, speed = np.array([[1.0, 1.0], [0.0, 1.0]]), np.array([[1.0, 0.0]]), np.array([[0.0, 1.0]])
        for df in batches:
            out = []
            for v in df.itertuples(index=False):
                s = State([v.a, v.b], np.diag([v.p, v.q]))
                s.predict(f, 2 * np.eye(2))
                cost = s.measure([v.y], place, np.array([[v.r]]))
                standing = s.constraint_distance([0], speed)
                held = s.copy()
                held.constrain([0], speed)
                out.append((v.c_custkey, cost, *s.x, s.p[0, 0], s.p[1, 1], standing, held.x[0]))
            yield pd.DataFrame(out, columns=["c_custkey", "cost", "place", "speed", "p00", "p11", "standing", "held"])

    got = rows.mapInPandas(run, "c_custkey long, cost double, place double, speed double, p00 double, p11 double, standing double, held double")
    return got.select("c_custkey", *[F.round(c, 6).alias(c) for c in got.columns[1:]])


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS trip_id, CASE WHEN s_suppkey % 4 = 0 THEN 2 ELSE 3 END AS n_stops, CAST(30 + s_suppkey % 7 + CASE WHEN s_suppkey % 4 = 0 THEN 5 ELSE 25 END + 10 AS INT) AS last_idx FROM supplier""")
def stops_of_rides(spark, sf_dir):
    """Rides that start moving, stand still for 5 or 25 samples, and go on: the origin, a stop of 20 samples or more, the end."""
    k, n = F.col("s_suppkey"), 30 + F.col("s_suppkey") % 7
    rest = F.when(k % 4 == 0, 5).otherwise(25)
    s = table(spark, sf_dir, "supplier").select(k.cast("string").alias("trip_id"), n.alias("n"), rest.alias("rest"), F.explode(F.sequence(F.lit(0).cast("long"), n + rest + 10)).alias("idx"))
    x = F.least("idx", "n") * 50.0 + F.greatest(F.col("idx") - F.col("n") - F.col("rest"), F.lit(0)) * 50.0
    moving = (F.col("idx") < F.col("n")) | (F.col("idx") > F.col("n") + F.col("rest"))
    still = F.flatten(F.array(*[F.array(*[F.lit(float(i == j)) for j in range(4)]) for i in range(4)]))
    states = s.select("trip_id", "idx", F.array(x, F.lit(0.0), F.when(moving, 50.0).otherwise(0.0), F.lit(0.0)).alias("x"), still.alias("p"))
    return smoothing.stops_of(states).groupBy("trip_id").agg(F.count("*").cast("int").alias("n_stops"), F.max("idx").cast("int").alias("last_idx"))
