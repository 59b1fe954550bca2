"""Single-band GeoTIFF rasters (strips or tiles, plain or deflate) as a Spark data source of (line, pixel, value), and sampling."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions import geometry as g
from . import dbase, files

# Field types (layout, bytes) and tags of a TIFF directory.
TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8)}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS_A_STRIP, STRIP_BYTES, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT, SCALE, TIE, TRANSFORM = 322, 323, 324, 325, 339, 33550, 33922, 34264
PLAIN, DEFLATE, OLD_DEFLATE = 1, 8, 32946


@dataclass(frozen=True)
class Raster:
    width: int
    height: int
    dtype: str
    compression: int
    predictor: int
    block: tuple[int, int]
    places: tuple[tuple[int, int], ...]
    transform: tuple[float, ...] | None


def describe(path: str) -> Raster:
    """The first image of a file: its size, blocks, and six-number transform (x0, dx, 0, y0, 0, dy)."""
    head = files.read_range(path, 0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or files.unpack(order + "H", head, 2)[0] != 42:
        raise ValueError(f"{path} is no TIFF")
    (at,) = files.unpack(order + "I", head, 4)
    (n,) = files.unpack(order + "H", files.read_range(path, at, 2))
    entries, tags = files.read_range(path, at + 2, 12 * n), {}
    for k in range(n):
        tag, kind, count = files.unpack(order + "HHI", entries, 12 * k)
        if kind in TYPES and kind not in (2, 5):
            layout, size = TYPES[kind]
            inside = count * size <= 4
            data = entries[12 * k + 8 : 12 * k + 12] if inside else files.read_range(path, files.unpack(order + "I", entries, 12 * k + 8)[0], count * size)
            tags[tag] = files.unpack(f"{order}{count}{layout}", data)
    width, height = tags[WIDTH][0], tags[HEIGHT][0]
    compression = tags.get(COMPRESSION, (PLAIN,))[0]
    if compression not in (PLAIN, DEFLATE, OLD_DEFLATE) or tags.get(SAMPLES, (1,))[0] != 1:
        raise ValueError(f"{path}: one band, plain or deflate, is what this reads")
    dtype = order + {1: "u", 2: "i", 3: "f"}[tags.get(FORMAT, (1,))[0]] + str(tags.get(BITS, (8,))[0] // 8)
    if TILES in tags:
        block, places = (tags[TILE_HEIGHT][0], tags[TILE_WIDTH][0]), zip(tags[TILES], tags[TILE_BYTES], strict=True)
    else:
        block, places = (min(tags.get(ROWS_A_STRIP, (height,))[0], height), width), zip(tags[STRIPS], tags[STRIP_BYTES], strict=True)
    transform = None
    if TRANSFORM in tags:
        m = tags[TRANSFORM]
        transform = (m[3], m[0], m[1], m[7], m[4], m[5])
    elif SCALE in tags and TIE in tags:
        (sx, sy), (i, j, _, x, y) = tags[SCALE][:2], tags[TIE][:5]
        transform = (x - i * sx, sx, 0.0, y + j * sy, 0.0, -sy)
    return Raster(width, height, dtype, compression, tags.get(PREDICTOR, (1,))[0], block, tuple(places), transform)


def block_of(path: str, r: Raster, k: int) -> tuple[int, int, np.ndarray]:
    """(first line, first pixel, values) of block k, cut to the image."""
    rows, cols = r.block
    across = -(-r.width // cols)
    line, pixel = k // across * rows, k % across * cols
    data = files.read_range(path, *r.places[k])
    if r.compression != PLAIN:
        data = zlib.decompress(data)
    values = np.frombuffer(data, r.dtype)
    values = values[: len(values) // cols * cols].reshape(-1, cols)
    if r.predictor == 2:
        values = np.cumsum(values, axis=1, dtype=values.dtype)
    return line, pixel, values[: r.height - line, : r.width - pixel]


class RasterSource(DataSource):
    """format("geotiff"): (line, pixel, value), a few blocks a task (option blocks_per_task)."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> StructType:
        return StructType([StructField("line", IntegerType()), StructField("pixel", IntegerType()), StructField("value", DoubleType())])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("blocks_per_task", 64)))


class _Reader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size, self.raster = path, size, describe(path)

    def partitions(self) -> list[dbase.Slice]:
        return dbase.slices(len(self.raster.places), self.size)

    def read(self, part: dbase.Slice) -> Iterator[tuple]:
        for k in range(part.first, part.first + part.count):
            line, pixel, values = block_of(self.path, self.raster, k)
            for i, row in enumerate(values.astype(float).tolist()):
                for j, v in enumerate(row):
                    yield line + i, pixel + j, v


def sample(points: DataFrame, raster: DataFrame, transform: tuple[float, ...], lon: Column, lat: Column, name: str = "elevation") -> DataFrame:
    """points with the value of the pixel that each lies in; null outside. A join on (line, pixel), so the raster may be of any size."""
    at = g.pixel_of(transform, lon, lat)
    cells = raster.select(F.col("line").alias("_line"), F.col("pixel").alias("_pixel"), F.col("value").alias(name))
    return points.withColumn("_at", at).join(cells, (F.col("_at.line") == F.col("_line")) & (F.col("_at.pixel") == F.col("_pixel")), "left").drop("_at", "_line", "_pixel")


def register(spark: SparkSession) -> None:
    """Makes dbase, shapefile and geotiff known to a session."""
    from .shapefile import ShapefileSource

    for source in (dbase.DbaseSource, ShapefileSource, RasterSource):
        spark.dataSource.register(source)
