"""dBASE III tables as a Spark data source: spark.dataSource.register(DbaseSource); spark.read.format("dbase").load(path)."""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, DataType, DateType, DoubleType, LongType, StringType, StructField, StructType

from . import files

RECORDS_A_TASK, HEADER, DESCRIPTOR = 200_000, 32, 32


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    length: int
    decimals: int

    @property
    def type(self) -> DataType:
        if self.kind in "NF":
            return LongType() if self.kind == "N" and not self.decimals and self.length <= 18 else DoubleType()
        return {"D": DateType(), "L": BooleanType()}.get(self.kind, StringType())

    def value(self, raw: bytes):
        """The cell's value; null where blank or unreadable."""
        text = raw.decode("utf-8", "replace").rstrip(" \0") if self.kind == "C" else raw.decode("latin-1").strip(" \0")
        if self.kind == "C":
            return text
        try:
            if self.kind in "NF":
                return (int if isinstance(self.type, LongType) else float)(text)
            if self.kind == "D":
                return datetime.datetime.strptime(text, "%Y%m%d").date()
        except ValueError:
            return None
        if self.kind == "L":
            return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
        return text


@dataclass(frozen=True)
class Layout:
    n: int
    start: int
    width: int
    fields: tuple[Field, ...]


def layout_of(path: str) -> Layout:
    """Number of records, where they start, their width with the deletion flag, and the fields."""
    head = files.read_range(path, 0, HEADER)
    n, start, width = files.unpack("<IHH", head, 4)
    body = files.read_range(path, HEADER, max(0, start - HEADER))
    if len(head) < HEADER or len(body) < start - HEADER:
        raise ValueError(f"{path}: the header is cut short")
    fields = []
    for at in range(0, len(body) - DESCRIPTOR + 1, DESCRIPTOR):
        if body[at] == 0x0D:
            break
        name, kind, _, length, decimals = files.unpack("<11sc4sBB", body, at)
        fields.append(Field(name.split(b"\0")[0].decode("ascii", "replace"), kind.decode("ascii", "replace"), length, decimals))
    if sum(f.length for f in fields) + 1 > width:
        raise ValueError(f"{path}: the fields are wider than a record")
    return Layout(n, start, width, tuple(fields))


def records(path: str, layout: Layout, first: int, count: int) -> Iterator[tuple]:
    """Values and the deletion flag of records from first on."""
    data = files.read_range(path, layout.start + first * layout.width, count * layout.width)
    for at in range(0, len(data) - layout.width + 1, layout.width):
        row, pos = [], at + 1
        for f in layout.fields:
            row.append(f.value(data[pos : pos + f.length]))
            pos += f.length
        yield (*row, data[at : at + 1] == b"*")


def write(path: str, fields: list[Field], rows: list[tuple]) -> None:
    """One table; values that don't fit their field raise."""
    width = 1 + sum(f.length for f in fields)
    out = [_pack_header(len(rows), HEADER + DESCRIPTOR * len(fields) + 1, width)]
    out += [f.name.encode("ascii")[:10].ljust(11, b"\0") + f.kind.encode() + bytes(4) + bytes([f.length, f.decimals]) + bytes(14) for f in fields]
    out.append(b"\r")
    for row in rows:
        out.append(b" ")
        for f, v in zip(fields, row, strict=True):
            cell = _cell(f, v)
            if len(cell) > f.length:
                raise ValueError(f"{v!r} does not fit {f.name}")
            out.append(cell.rjust(f.length) if f.kind in "NF" else cell.ljust(f.length))
    files.write_all(path, b"".join(out) + b"\x1a")


def _pack_header(n: int, start: int, width: int) -> bytes:
    return b"\x03\x00\x01\x01" + n.to_bytes(4, "little") + start.to_bytes(2, "little") + width.to_bytes(2, "little") + bytes(20)


def _cell(f: Field, v) -> bytes:
    if v is None:
        return b""
    if f.kind == "L":
        return b"T" if v else b"F"
    if f.kind == "D":
        return v.strftime("%Y%m%d").encode()
    return (f"{v:.{f.decimals}f}" if f.kind in "NF" and f.decimals else str(v)).encode()


@dataclass
class Slice(InputPartition):
    first: int
    count: int


def slices(n: int, size: int) -> list[Slice]:
    return [Slice(k, min(size, n - k)) for k in range(0, n, size)] or [Slice(0, 0)]


class DbaseSource(DataSource):
    """Columns after the fields, and _deleted. Option rows_per_task."""

    @classmethod
    def name(cls) -> str:
        return "dbase"

    def schema(self) -> StructType:
        fields = [StructField(f.name, f.type) for f in layout_of(self.options["path"]).fields]
        return StructType([*fields, StructField("_deleted", BooleanType())])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema, int(self.options.get("rows_per_task", RECORDS_A_TASK)))


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, size: int):
        self.path, self.size, self.layout = path, size, layout_of(path)

    def partitions(self) -> list[Slice]:
        return slices(self.layout.n, self.size)

    def read(self, part: Slice) -> Iterator[tuple]:
        yield from records(self.path, self.layout, part.first, part.count)


def field_for(name: str, kind: DataType) -> Field:
    """The field that a column is written as."""
    simple = kind.simpleString()
    if simple in ("int", "bigint", "smallint", "tinyint"):
        return Field(name, "N", 18, 0)
    if simple in ("double", "float"):
        return Field(name, "N", 24, 8)
    return {"boolean": Field(name, "L", 1, 0), "date": Field(name, "D", 8, 0)}.get(simple, Field(name, "C", 254, 0))


__all__ = ["DbaseSource", "Field", "Layout", "field_for", "layout_of", "records", "slices", "write"]
