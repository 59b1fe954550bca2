"""Opening files by path or address on driver and executors, and bounds-checked reads of binary fields."""

from __future__ import annotations

import struct

from pyarrow import fs


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; a bare path is local."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def read_range(path: str, start: int, length: int | None = None) -> bytes:
    """length bytes from start (fewer at the end of the file), or all that follow."""
    system, inner = locate(path)
    with system.open_input_file(inner) as f:
        return f.read_at(f.size() - start if length is None else length, start)


def size_of(path: str) -> int:
    system, inner = locate(path)
    return system.get_file_info(inner).size


def exists(path: str) -> bool:
    system, inner = locate(path)
    return system.get_file_info(inner).type == fs.FileType.File


def write_all(path: str, data: bytes) -> None:
    system, inner = locate(path)
    if "/" in inner:
        system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(inner) as f:
        f.write(data)


def unpack(layout: str, data: bytes, at: int = 0) -> tuple:
    """struct.unpack_from, saying where the data ends too early."""
    if at + struct.calcsize(layout) > len(data):
        raise ValueError(f"{struct.calcsize(layout)} bytes wanted at {at}, the data has {len(data)}")
    return struct.unpack_from(layout, data, at)
