"""GeoJSON: street and cycling layers in, features out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g


def read_features(spark: SparkSession, paths: str | list[str], properties: str, lines: bool = False) -> DataFrame:
    """(seq, type, coordinates as JSON text, properties): seq is the order of the features. properties: their DDL.

    A FeatureCollection is one document, so one task reads a file; with lines a file has one feature a line and is split.
    """
    feature = f"STRUCT<geometry: STRUCT<type: STRING, coordinates: STRING>, properties: STRUCT<{properties}>>"
    if lines:
        df = spark.read.schema(f"geometry STRUCT<type: STRING, coordinates: STRING>, properties STRUCT<{properties}>").json(paths)
        df = df.select(F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos")).alias("seq"), F.struct("geometry", "properties").alias("f"))
    else:
        df = spark.read.schema(f"features ARRAY<{feature}>").json(paths, multiLine=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode("features").alias("pos", "f"))
        df = df.select(F.struct("file", F.lit(0).cast("long").alias("block"), F.col("pos").cast("long").alias("pos")).alias("seq"), "f")
    return df.select("seq", F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


def _points(pairs: Column, project: bool) -> Column:
    return F.transform(pairs, lambda p: g.to_plane(p[0], p[1]) if project else F.struct(p[0].alias("x"), p[1].alias("y")))


def lines_of(features: DataFrame, project: bool) -> DataFrame:
    """(seq, part, coords, properties): one row a line; the parts of a MultiLineString are lines of their own. Other geometry goes."""
    many = F.when(F.col("type") == "LineString", F.array(F.from_json("coordinates", "array<array<double>>"))).when(F.col("type") == "MultiLineString", F.from_json("coordinates", "array<array<array<double>>>"))
    return features.select("seq", F.posexplode(many).alias("part", "_line"), "properties").select("seq", "part", _points(F.col("_line"), project).alias("coords"), "properties").where("size(coords) > 1")


def read_streets(spark: SparkSession, paths: str | list[str], lines: bool = False) -> DataFrame:
    """The street layer, from degrees to metres: (layer 0, seq, part, way_id, link_id null, type, sens, coords)."""
    rows = lines_of(read_features(spark, paths, "ID_TRC: BIGINT, CLASSE: INT, SENS_CIR: INT", lines).where("type = 'LineString'"), project=True)
    p = "properties."
    return rows.select(F.lit(0).alias("layer"), "seq", "part", F.col(p + "ID_TRC").alias("way_id"), F.lit(None).cast("long").alias("link_id"), F.col(p + "CLASSE").alias("type"), F.col(p + "SENS_CIR").alias("sens"), "coords")


def read_cycling(spark: SparkSession, paths: str | list[str], lines: bool = False) -> DataFrame:
    """The cycling layer, in metres already: classes begin at 10, both directions are open."""
    rows = lines_of(read_features(spark, paths, "ID: BIGINT, ID_TRC_GEOBASE: BIGINT, TYPE_VOIE: INT", lines), project=False)
    p = "properties."
    return rows.select(F.lit(1).alias("layer"), "seq", "part", F.col(p + "ID").alias("way_id"), F.col(p + "ID_TRC_GEOBASE").alias("link_id"), (F.col(p + "TYPE_VOIE") + 10).alias("type"), F.lit(0).alias("sens"), "coords")


def feature_text(kind: str, coords: Column, **properties: Column) -> Column:
    """A GeoJSON feature as text. coords: struct(x, y) for a Point, an array of them for a LineString."""
    shape = F.array(coords.x, coords.y) if kind == "Point" else F.transform(coords, lambda p: F.array(p.x, p.y))
    named = F.struct(*[c.alias(k) for k, c in properties.items()]) if properties else F.from_json(F.lit("{}"), "map<string,string>")
    return F.to_json(F.struct(F.lit("Feature").alias("type"), named.alias("properties"), F.struct(F.lit(kind).alias("type"), shape.alias("coordinates")).alias("geometry")), {"ignoreNullFields": "false"})


def trip_lines(segments: DataFrame) -> Column:
    """Features of matched segments; filter on size(geometry) > 1 first."""
    return feature_text("LineString", F.col("geometry"), id=F.col("trip_id"), type=F.lit("segment"))


def edge_features() -> Column:
    return feature_text("LineString", F.col("coords"), first=F.col("u"), last=F.col("v"))


def center_features() -> Column:
    return feature_text("Point", F.struct(F.col("cx").alias("x"), F.col("cy").alias("y")), id=F.col("label"), type=F.lit("cluster"), label=F.col("label"))


def route_lines(key: str = "trip_id") -> Column:
    """Features of routes (key, coords)."""
    return feature_text("LineString", F.col("coords"), id=F.col(key), type=F.lit("ioc"))


def way_features() -> Column:
    """Features of the ways that osm.way_lines gives, their tags as properties."""
    return feature_text("LineString", F.col("coords"), id=F.col("way_id"), tags=F.col("tags"))


def wkt(x: Column, y: Column) -> Column:
    return F.format_string("POINT(%s %s)", x, y)


def write_features(df: DataFrame, feature: Column, path: str, *, crs: str | None = "urn:ogc:def:crs:EPSG::2950", one_file: bool = False) -> None:
    """Writes a folder of GeoJSON: one feature a line in as many files as there are tasks, or, one_file, one FeatureCollection.

    The latter passes through a single task as a stream, for layers that a viewer opens.
    """
    text = df.select(feature.alias("value"))
    if not one_file:
        text.write.mode("overwrite").text(path)
        return
    named = f'"crs": {{"type": "name", "properties": {{"name": "{crs}"}}}}, ' if crs else ""

    def wrap(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": ['{"type": "FeatureCollection", ' + named + '"features": [']})
        first = True
        for b in batches:
            if len(b):
                out = [("" if first and not k else ",") + v for k, v in enumerate(b.value)]
                first = False
                yield pd.DataFrame({"value": out})
        yield pd.DataFrame({"value": ["]}"]})

    text.coalesce(1).mapInPandas(wrap, "value string").write.mode("overwrite").text(path)
