"""WARC archives of Zstandard frames: one frame a record, the dictionary in the leading skippable frame.

Tasks write archives of bounded size into the shared folder under names of their own and report them in a manifest, which
Spark's commit makes final; an archive of a task that died is in no manifest and is never read. Reading streams one frame at a
time, so memory holds one record.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

# Fixed values of the archive format.
DICT_MAGIC = 0x184D2A5D
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6f1c3f0a-6a0c-5d0e-9a53-3f1d8c1f7b11")

#: The dictionary of an archive is trained on its first records: so many, of so many bytes each and of this size at most.
DICT_RECORDS, DICT_RECORD_BYTES, DICT_BYTES = 400, 8_192, 16_384
ARCHIVE_BYTES, LEVEL = 64_000_000, 3
MANIFEST = "archive string, records long, bytes long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


class Corrupt(ValueError):
    """An archive that breaks the format; the message says where."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, str(page_id))}>"


def uri(url: str | None, page_id) -> str:
    """A header value on one line: blanks, controls and non-ASCII are percent-encoded."""
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "") or f"urn:page:{page_id}"


def encode_record(page_id, url: str | None, payload: bytes, payload_digest: str, payload_bytes: int, refers_to, date: str) -> bytes:
    """A response with its payload, or (refers_to given) a revisit without it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % payload_bytes
    block = http + payload if refers_to is None else http
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri(url, page_id)),
        ("WARC-Payload-Digest", f"sha1:{payload_digest}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(payload_bytes)),
    ]
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-ID", str(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def decode_record(raw: bytes, where: str) -> dict:
    """The parts of a record; Corrupt if version, headers, lengths or digests are wrong."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or lines[0] != VERSION:
        raise Corrupt(f"{where}: no {VERSION.decode()} header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        k, colon, v = line.decode().partition(":")
        if not colon or not k or k.lower() in fields:
            raise Corrupt(f"{where}: bad header line {line[:80]!r}")
        fields[k.lower()] = v.strip()
    if missing := {"warc-type", "warc-record-id", "warc-date", "warc-payload-digest", "x-payload-length", "content-length"} - set(fields):
        raise Corrupt(f"{where}: no {sorted(missing)}")
    if not re.fullmatch(r"\d+", fields["content-length"]) or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise Corrupt(f"{where}: the block isn't as long as Content-Length says")
    block = rest[:-4]
    if fields.get("warc-block-digest", f"sha1:{digest(block)}") != f"sha1:{digest(block)}":
        raise Corrupt(f"{where}: block digest")
    kind, n = fields["warc-type"], int(fields["x-payload-length"])
    http, sep, payload = block.partition(b"\r\n\r\n")
    if not sep or kind not in ("response", "revisit"):
        raise Corrupt(f"{where}: type {kind}")
    if kind == "response" and (len(payload) != n or f"sha1:{digest(payload)}" != fields["warc-payload-digest"]):
        raise Corrupt(f"{where}: the payload differs from its length or digest")
    if kind == "revisit" and ("x-refers-to-page-id" not in fields or payload):
        raise Corrupt(f"{where}: a revisit refers to a record and has no payload")
    return {
        "page_id": int(fields["x-page-id"]) if fields.get("x-page-id") else None,
        "payload_bytes": n,
        "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"),
        "record_type": kind,
        "refers_to": int(fields["x-refers-to-page-id"]) if kind == "revisit" else None,
        "url": fields.get("warc-target-uri"),
        "payload": payload if kind == "response" else None,
    }


def dictionary_of(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_BYTES:]


class Writer:
    """An archive in a binary stream. Records are held back until the dictionary can be trained."""

    def __init__(self, stream):
        self.stream, self.held, self.packer, self.records, self.bytes = stream, [], None, 0, 0

    def add(self, record: bytes) -> None:
        if self.packer is None:
            self.held.append(record)
            if len(self.held) >= DICT_RECORDS:
                self._start()
        else:
            self._write(self.packer.compress(record))
        self.records += 1

    def _write(self, data: bytes) -> None:
        self.stream.write(data)
        self.bytes += len(data)

    def _start(self) -> None:
        raw = dictionary_of([x[:DICT_RECORD_BYTES] for x in self.held])
        packed = zstandard.ZstdCompressor(level=19, write_checksum=True).compress(raw)
        self._write(struct.pack("<II", DICT_MAGIC, len(packed)) + packed)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None, write_checksum=True, write_content_size=True)
        for x in self.held:
            self._write(self.packer.compress(x))
        self.held = []

    def close(self) -> None:
        if self.packer is None:
            self._start()
        self.stream.close()


def read_archive(stream, name: str) -> Iterator[dict]:
    """The records of an archive, one frame at a time."""
    head = stream.read(8)
    if len(head) != 8 or struct.unpack("<I", head[:4])[0] != DICT_MAGIC:
        raise Corrupt(f"{name}: no dictionary frame at the start")
    packed = stream.read(n := struct.unpack("<I", head[4:])[0])
    if len(packed) != n:
        raise Corrupt(f"{name}: the dictionary is cut off")
    raw = zstandard.ZstdDecompressor().decompress(packed, max_output_size=1 << 27) if packed[:4] == zstandard.FRAME_HEADER else packed
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    rest, k = b"", 0
    while True:
        if not rest and not (rest := stream.read(1 << 20)):
            return
        frame, out = unpacker.decompressobj(), io.BytesIO()
        while not frame.eof:
            if not rest and not (rest := stream.read(1 << 20)):
                raise Corrupt(f"{name}: record {k} is cut off")
            try:
                out.write(frame.decompress(rest))
            except zstandard.ZstdError as e:
                raise Corrupt(f"{name}: record {k}: {e}") from e
            rest = frame.unused_data if frame.eof else b""
        yield decode_record(out.getvalue(), f"{name}: record {k}")
        k += 1


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def plan_records(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, payload_bytes, refers_to). Of equal payloads of min_bytes or more the largest page_id is the response.

    The group's largest id is found over digests alone, reduced before the shuffle; a hot payload's rows are split by the join.
    Null html is an empty payload. Rows that share the largest page_id are all responses, as are rows of groups without any id.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("key", F.concat(F.sha1("payload"), F.lit(":"), F.col("payload_bytes").cast("string")))
    first = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("key").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1").drop("n")
    out = rows.join(first, "key", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("top")) & F.col("top").isNotNull(), F.col("top"))
    return out.select("page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), "payload_bytes", F.unhex(F.substring_index("key", ":", 1)).alias("sha1"), refers.alias("refers_to"))


def write_archives(records: DataFrame, folder: str, *, date: str = "2020-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes plan_records' rows as archives under folder; gives the manifest (lazy: the archives come with its evaluation)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        store.create_dir(base, recursive=True)
        done, writer, name = [], None, ""
        for batch in batches:
            for r in batch.to_pylist():
                if writer is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    writer = Writer(store.open_output_stream(f"{base}/{name}"))
                writer.add(encode_record(r["page_id"], r["url"], r["payload"] or b"", base64.b32encode(r["sha1"]).decode(), r["payload_bytes"], r["refers_to"], date))
                if writer.bytes >= archive_bytes:
                    writer.close()
                    done.append((f"{folder}/{name}", writer.records, writer.bytes))
                    writer = None
        if writer is not None:
            writer.close()
            done.append((f"{folder}/{name}", writer.records, writer.bytes))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["archive", "records", "bytes"])

    return records.mapInArrow(write, MANIFEST)


def read_archives(manifest: DataFrame, *, payloads: bool = False, batch_bytes: int = 8_000_000) -> DataFrame:
    """The records of the manifest's archives, checked one by one; payload is null unless asked for."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.to_pylist():
                store, path = filesystem(m["archive"])
                rows, held, total = [], 0, 0
                with store.open_input_stream(path) as stream:
                    for r in read_archive(stream, m["archive"]):
                        if not payloads:
                            r["payload"] = None
                        rows.append(r)
                        total, held = total + 1, held + 300 + len(r["payload"] or b"")
                        if held >= batch_bytes:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if total != m["records"]:
                    raise Corrupt(f"{m['archive']}: {total} records, the manifest has {m['records']}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    # A large archive is a row of few bytes: deal the rows out so that each task has few of them.
    return manifest.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 2)).mapInArrow(read, RECORD)


def roundtrip(pages: DataFrame, **options) -> DataFrame:
    """pages written as archives in the shared folder and read back."""
    work = Workspace(pages.sparkSession, "warc")
    manifest = work.save(write_archives(plan_records(pages, **options), f"{work.path}/archives"), "manifest")
    return read_archives(manifest)
