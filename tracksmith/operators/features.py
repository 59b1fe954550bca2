"""Features of matched trips: sums in one grouped aggregate, heights and regions by joins on the trip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import spatial


def segment_length(seg: DataFrame) -> Column:
    """On the network the difference of the end projections, off it the length of the line."""
    return F.when(F.col("edge").isNotNull(), F.abs(F.col("end.projection") - F.col("begin.projection"))).otherwise(g.line_length(F.col("geometry")))


def trip_features(segments: DataFrame, edges: DataFrame, nodes_in: dict[str, DataFrame] | None = None) -> DataFrame:
    """segments (trip_id, seg_no, edge struct<u,v,k>, geometry, begin, end) and edges (u, v, k, type, sens, ord, coords) to one row a trip.

    Lengths by class, lengths against the traffic, turns, intersections and those of each set in nodes_in (frames of node_id),
    duration in samples and mean speed. An edge is stored once: it is found by its ends in either order.
    """
    e = edges.select(F.least("u", "v").alias("_a"), F.greatest("u", "v").alias("_b"), F.col("k").alias("_k"), "type", "sens", "ord", "coords", F.col("u").alias("_u"))
    s = segments.withColumn("_len", segment_length(segments)).withColumn("_a", F.least("edge.u", "edge.v")).withColumn("_b", F.greatest("edge.u", "edge.v")).withColumn("_k", F.col("edge.k"))
    s = s.join(e, ["_a", "_b", "_k"], "left")
    ahead = F.col("edge.u") == F.col("_u")
    points = F.when(ahead, F.col("coords")).otherwise(F.reverse("coords"))
    n = F.size(points)
    s = s.withColumn("_out", F.struct((points[n - 1].x - points[n - 2].x).alias("x"), (points[n - 1].y - points[n - 2].y).alias("y")))
    s = s.withColumn("_in", F.struct((points[1].x - points[0].x).alias("x"), (points[1].y - points[0].y).alias("y")))
    w = Window.partitionBy("trip_id").orderBy("seg_no")
    s = s.withColumn("_next_in", F.lead("_in").over(w)).withColumn("_next_begin", F.lead("begin").over(w))
    s = s.withColumn("_turn", F.when(F.col("end.attached") & F.col("_next_begin.attached"), g.turn_angle(F.col("_out.x"), F.col("_out.y"), F.col("_next_in.x"), F.col("_next_in.y"))))
    at_node = F.col("edge").isNotNull() & F.col("end.attached")
    aggs = [F.sum("_len").alias("length"), F.sum(F.when(g.of_class(F.col("type"), "cycling"), F.col("_len")).otherwise(0.0)).alias("length_cycling")]
    aggs += [F.sum(F.when(g.of_class(F.col("type"), c), F.col("_len")).otherwise(0.0)).alias(f"length_{c}") for c in g.CLASSES]
    ordered = g.digitised_order(F.col("edge.u"), F.col("edge.v"), F.col("ord"))
    aggs.append(F.sum(F.when(g.wrong_way(F.col("sens"), ordered), F.col("_len")).otherwise(0.0)).alias("length_inverse"))
    aggs += [F.count_if(g.is_left_turn(F.col("_turn"))).alias("left_turn"), F.count_if(g.is_right_turn(F.col("_turn"))).alias("right_turn"), F.count_if(at_node).alias("intersections")]
    for name, nodes in (nodes_in or {}).items():
        s = s.join(nodes.select(F.col("node_id").alias("_node")).distinct().withColumn(f"_in_{name}", F.lit(True)), F.col("edge.v") == F.col("_node"), "left").drop("_node")
        aggs.append(F.count_if(at_node & F.coalesce(F.col(f"_in_{name}"), F.lit(False))).alias(name))
    aggs.append((F.max_by("end.idx", "seg_no") - F.min_by("begin.idx", "seg_no")).cast("long").alias("duration"))
    return s.groupBy("trip_id").agg(*aggs).withColumn("avg_speed", F.try_divide("length", "duration"))


def slope_sums(df: DataFrame, key: str, order: list[str], x: str, y: str, z: str) -> DataFrame:
    """Sums of squared and cubed slope times distance between neighbours; neighbours at one place count for nothing."""
    w = Window.partitionBy(key).orderBy(*order)
    nx, ny, nz = (F.lead(c).over(w) for c in (x, y, z))
    s = df.select(key, g.distance(F.col(x), F.col(y), nx, ny).alias("d"), (nz - F.col(z)).alias("dz")).where("d > 0")
    slope = F.col("dz") / F.col("d")
    return s.groupBy(key).agg(F.sum(slope * slope * F.col("d")).alias("elev_m2"), F.sum(slope * slope * slope * F.col("d")).alias("elev_m3"))


def trip_nodes(segments: DataFrame) -> DataFrame:
    """(trip_id, no, x, y): the first point of each segment, and the last point of the last one."""
    s = segments.select("trip_id", "seg_no", "geometry", F.max("seg_no").over(Window.partitionBy("trip_id")).alias("_last")).where(F.size("geometry") > 0)
    begin = F.struct(F.col("seg_no").alias("no"), F.element_at("geometry", 1).alias("p"))
    end = F.when(F.col("seg_no") == F.col("_last"), F.struct((F.col("seg_no") + 1).alias("no"), F.element_at("geometry", -1).alias("p")))
    return s.select("trip_id", F.explode(F.array_compact(F.array(begin, end))).alias("n")).select("trip_id", F.col("n.no").cast("long").alias("no"), "n.p.x", "n.p.y")


def all_features(segments: DataFrame, edges: DataFrame, nodes_in: dict[str, DataFrame], with_height, regions: DataFrame, cell: float) -> DataFrame:
    """trip_features with elev_m2 and elev_m3 along the segments, the regions of the first and last point (origin, destination), and
    n_segments: what a trip is described by as a whole.

    with_height(points) adds z to rows with x and y, for example by raster.sample; regions as spatial.regions_of takes them.
    """
    nodes = trip_nodes(segments)
    slopes = slope_sums(with_height(nodes), "trip_id", ["no"], "x", "y", "z")
    at = nodes.groupBy("trip_id").agg(F.min_by(F.struct("x", "y"), "no").alias("a"), F.max_by(F.struct("x", "y"), "no").alias("b"), (F.count("*") - 1).alias("n_segments"))
    ends = at.select("trip_id", F.explode(F.array(F.struct(F.lit(True).alias("first"), F.col("a").alias("p")), F.struct(F.lit(False).alias("first"), F.col("b").alias("p")))).alias("e"))
    ends = ends.select(F.struct("trip_id", "e.first").alias("end"), "e.p.x", "e.p.y")
    found = spatial.regions_of(ends, regions, "end", "x", "y", cell)
    names = found.groupBy(F.col("end.trip_id").alias("trip_id")).agg(F.max(F.when(F.col("end.first"), F.col("region"))).alias("origin"), F.max(F.when(~F.col("end.first"), F.col("region"))).alias("destination"))
    out = trip_features(segments, edges, nodes_in).join(slopes, "trip_id", "left").join(names, "trip_id", "left").join(at.select("trip_id", "n_segments"), "trip_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("elev_m2", "elev_m3")})
