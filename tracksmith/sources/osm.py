"""OpenStreetMap XML: highways with the nodes they use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import geojson

# The tags that are kept.
TAGS = ("highway", "cycleway", "oneway", "foot", "bicycle", "lanes", "lit", "width", "maxspeed", "name")


def read_ways(spark: SparkSession, path: str) -> DataFrame:
    """(way_id, nodes array<bigint>, tags map): the ways with a highway tag; of a tag that repeats the last value counts."""
    schema = "_id BIGINT, nd ARRAY<STRUCT<_ref: BIGINT>>, tag ARRAY<STRUCT<_k: STRING, _v: STRING>>"
    ways = spark.read.schema(schema).option("rowTag", "way").format("xml").load(path).where(F.exists("tag", lambda t: t._k == "highway"))
    kept = F.filter("tag", lambda t: t._k.isin(*TAGS))
    last = F.array_distinct(F.transform(kept, lambda t: t._k))
    tags = F.map_from_entries(F.transform(last, lambda k: F.struct(k.alias("k"), F.element_at(F.filter(kept, lambda t: t._k == k), -1)._v.alias("v"))))
    return ways.select(F.col("_id").alias("way_id"), F.coalesce(F.col("nd._ref"), F.array().cast("array<bigint>")).alias("nodes"), tags.alias("tags"))


def read_nodes(spark: SparkSession, path: str, ways: DataFrame | None = None) -> DataFrame:
    """(node_id, x, y) in metres; with ways, only the nodes that they use."""
    nodes = spark.read.schema("_id BIGINT, _lat DOUBLE, _lon DOUBLE").option("rowTag", "node").format("xml").load(path)
    nodes = nodes.select(F.col("_id").alias("node_id"), g.to_plane(F.col("_lon"), F.col("_lat")).alias("p")).select("node_id", "p.x", "p.y")
    return nodes if ways is None else nodes.join(ways.select(F.explode("nodes").alias("node_id")).distinct(), "node_id", "left_semi")


def way_lines(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way_id, tags, coords): the lines of the ways; nodes that are not there are left out."""
    at = ways.select("way_id", F.posexplode("nodes").alias("pos", "node_id")).join(nodes, "node_id")
    lines = at.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("c"))  # a way has 2,000 nodes at most
    return ways.select("way_id", "tags").join(lines, "way_id").select("way_id", "tags", F.transform("c", lambda p: F.struct(p.x.alias("x"), p.y.alias("y"))).alias("coords"))


def export(ways: DataFrame, nodes: DataFrame, path: str) -> None:
    """Writes the ways as lines: GeoJSON if path ends in .json, else a folder of shapefiles with the highway tag and the name."""
    lines = way_lines(ways, nodes).where("size(coords) > 1")
    if path.rstrip("/").endswith(".json"):
        geojson.write_features(lines, geojson.way_features(), path, crs=None)
    else:
        lines.select("way_id", F.col("tags")["highway"].alias("highway"), F.col("tags")["name"].alias("name"), F.array("coords").alias("parts")).write.format("shapefile").mode("overwrite").save(path)
