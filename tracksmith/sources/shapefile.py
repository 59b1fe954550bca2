"""Shapefiles as a Spark data source, both ways: the .shp with its .shx index and .dbf attributes."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from . import dbase, files

CODE, VERSION, HEADER, SHAPES_A_TASK = 9994, 1000, 100, 50_000
# Shape types.
NULL, POINT, LINE, POLYGON, MULTIPOINT = 0, 1, 3, 5, 8
XY = StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])
SHAPE = [StructField("shape_no", LongType()), StructField("shape_type", IntegerType()), StructField("parts", ArrayType(ArrayType(XY)))]


def _sibling(path: str, ending: str) -> str:
    return path.removesuffix(".shp") + ending


def shape_type(path: str) -> int:
    """The file's shape type, after a check of its code."""
    head = files.read_range(path, 0, HEADER)
    if files.unpack(">i", head)[0] != CODE:
        raise ValueError(f"{path} is no shapefile")
    return files.unpack("<i", head, 32)[0]


def count(path: str) -> int:
    return (files.size_of(_sibling(path, ".shx")) - HEADER) // 8


def parse(body: bytes) -> tuple[int, list[list[tuple[float, float]]]]:
    """(type, parts) of a record: a point is one part of one point, a multipoint one part."""
    (kind,) = files.unpack("<i", body)
    if kind == NULL:
        return kind, []
    if kind % 10 == POINT:
        return kind, [[files.unpack("<2d", body, 4)]]
    if kind % 10 == MULTIPOINT:
        (n,) = files.unpack("<i", body, 36)
        flat = files.unpack(f"<{2 * n}d", body, 40)
        return kind, [list(zip(flat[::2], flat[1::2], strict=True))]
    if kind % 10 in (LINE, POLYGON):
        n_parts, n = files.unpack("<2i", body, 36)
        starts = [*files.unpack(f"<{n_parts}i", body, 44), n]
        flat = files.unpack(f"<{2 * n}d", body, 44 + 4 * n_parts)
        points = list(zip(flat[::2], flat[1::2], strict=True))
        return kind, [points[a:b] for a, b in zip(starts, starts[1:], strict=False)]
    raise ValueError(f"shape type {kind}")


def shapes(path: str, first: int, n: int) -> Iterator[tuple[int, int, list]]:
    """(number, type, parts) of the shapes from first on, found by the index and read in one piece."""
    index = files.read_range(_sibling(path, ".shx"), HEADER + 8 * first, 8 * n)
    places = [files.unpack(">2i", index, at) for at in range(0, len(index) - 7, 8)]
    if not places:
        return
    low = min(2 * at for at, _ in places)
    data = files.read_range(path, low, max(2 * (at + length) + 8 for at, length in places) - low)
    for k, (at, length) in enumerate(places):
        here = 2 * at - low
        number, words = files.unpack(">2i", data, here)
        if words != length:
            raise ValueError(f"{path}: shape {first + k} has another length than its index says")
        yield first + k, *parse(data[here + 8 : here + 8 + 2 * words])


class ShapefileSource(DataSource):
    """shape_no, shape_type, parts, and the attributes with _deleted where there is a .dbf. Option rows_per_task.

    Saving takes a column parts (or points: one part), writes every other column as an attribute, and gives one shapefile a task
    in the folder. Option shape_type (3 if not given).
    """

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> StructType:
        path, extra = self.options["path"], []
        if files.exists(_sibling(path, ".dbf")):
            extra = [StructField(f.name, f.type) for f in dbase.layout_of(_sibling(path, ".dbf")).fields] + [StructField("_deleted", BooleanType())]
        return StructType([*SHAPE, *extra])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("rows_per_task", SHAPES_A_TASK)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], schema, int(self.options.get("shape_type", LINE)))


class _Reader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size, self.type = path, size, shape_type(path)
        table = _sibling(path, ".dbf")
        self.table = dbase.layout_of(table) if files.exists(table) else None

    def partitions(self) -> list[dbase.Slice]:
        return dbase.slices(count(self.path), self.size)

    def read(self, part: dbase.Slice) -> Iterator[tuple]:
        rows = shapes(self.path, part.first, part.count)
        if self.table is None:
            yield from rows
            return
        attributes = dbase.records(_sibling(self.path, ".dbf"), self.table, part.first, part.count)
        for shape, record in zip(rows, attributes, strict=True):
            yield *shape, *record


@dataclass
class _Done(WriterCommitMessage):
    stem: str


class _Writer(DataSourceWriter):
    def __init__(self, path: str, schema: StructType, kind: int):
        self.path, self.kind, self.names = path.rstrip("/"), kind, schema.fieldNames()
        self.fields = [dbase.field_for(f.name, f.dataType) for f in schema.fields if f.name not in ("parts", "points")]

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get()
        stem = f"{self.path}/part-{task.partitionId():05d}-{task.taskAttemptId()}"
        write(stem + ".shp", self.kind, ((_parts(r), [r[f.name] for f in self.fields]) for r in rows), self.fields)
        return _Done(stem)

    def commit(self, messages: list) -> None:
        files.write_all(f"{self.path}/_SUCCESS", b"")

    def abort(self, messages: list) -> None:
        for m in messages:
            for ending in (".shp", ".shx", ".dbf") if m else ():
                system, inner = files.locate(m.stem + ending)
                system.delete_file(inner)


def _parts(row) -> list[list[tuple[float, float]]]:
    d = row.asDict()
    parts = d["parts"] if "parts" in d else [d["points"]]
    return [[(p["x"], p["y"]) for p in part] for part in parts]


def write(path: str, kind: int, rows, fields: list[dbase.Field]) -> None:
    """One shapefile of (parts, attributes) rows."""
    body, index, attributes, at, box = [], [], [], HEADER // 2, None
    for number, (parts, values) in enumerate(rows, 1):
        points = [p for part in parts for p in part]
        flat = struct.pack(f"<{2 * len(points)}d", *[v for p in points for v in p])
        if points:
            xs, ys = [p[0] for p in points], [p[1] for p in points]
            own = (min(xs), min(ys), max(xs), max(ys))
            box = own if box is None else (*map(min, box[:2], own[:2]), *map(max, box[2:], own[2:]))
        if not points:
            shape = struct.pack("<i", NULL)
        elif kind == POINT:
            shape = struct.pack("<i", POINT) + flat
        elif kind == MULTIPOINT:
            shape = struct.pack("<i4di", kind, *own, len(points)) + flat
        else:
            starts = [sum(map(len, parts[:k])) for k in range(len(parts))]
            shape = struct.pack(f"<i4d2i{len(parts)}i", kind, *own, len(parts), len(points), *starts) + flat
        body.append(struct.pack(">2i", number, len(shape) // 2) + shape)
        index.append(struct.pack(">2i", at, len(shape) // 2))
        at += 4 + len(shape) // 2
        attributes.append(tuple(values))

    def header(words: int) -> bytes:
        return struct.pack(">7i", CODE, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", VERSION, kind, *(box or (0, 0, 0, 0)), 0, 0, 0, 0)

    files.write_all(path, header(at) + b"".join(body))
    files.write_all(_sibling(path, ".shx"), header(HEADER // 2 + 4 * len(index)) + b"".join(index))
    if fields:
        dbase.write(_sibling(path, ".dbf"), fields, attributes)


def read_folder(spark, path: str, kind: str = "shapefile"):
    """The shapes of all files in a folder, as the writer leaves it, or (kind "dbase") only their attributes."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    ending = ".shp" if kind == "shapefile" else ".dbf"
    found = sorted(str(f.getPath().toString()) for f in listed if f.getPath().getName().endswith(ending))
    if not found:
        raise ValueError(f"{path} holds no {ending} file")
    out = None
    for one in found:
        df = spark.read.format(kind).load(one)
        out = df if out is None else out.unionByName(df)
    return out
