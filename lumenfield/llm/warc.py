"""WARC 1.1 archives as a Spark data source.

``spark.read.format("warc")`` plans whole files into partitions of about ``partitionBytes``, takes
equality and membership filters on ``record_type`` and on the pushed header columns before any
payload is looked at, and parses a record's header first. A payload that is not wanted (the record
fails a filter, or option ``payload`` is ``none``) is skipped without decoding: each record is a
gzip member of its own whose extra field ``sl`` holds its compressed and uncompressed length, as
the format's annex on skip-lengths proposes, so the reader seeks to the next member. Members
without that field are decompressed through; a file may also be plain.

``df.write.format("warc")`` writes one file for each task attempt and lists the committed ones in
a manifest of its own, so an attempt that an executor's loss cut short is never read. Mode append
keeps what earlier writes committed, mode overwrite removes it.

Files are reached through pyarrow's file systems: local and shared folders, hdfs, s3.

Reader columns: uri, record_type, record_id, date, page_id, refers_to, payload_digest,
payload_bytes, payload. Defined results: a header that is missing is null; a record without a
payload has an empty one; an empty folder has no rows; a truncated last record raises an error. Of equal payloads the smallest
page_id's is the response; extra columns of a table that is written are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from .workspace import Workspace

MANIFEST = "_files-"
SCHEMA = "uri string, record_type string, record_id string, date string, page_id long, refers_to long, payload_digest string, payload_bytes long, payload binary"
#: Columns that come from one header each, and so can be filtered before a payload is read.
HEADERS = {
    "uri": "WARC-Target-URI", "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "date": "WARC-Date",
    "page_id": "X-Page-ID", "refers_to": "X-Refers-To-Page", "payload_digest": "WARC-Payload-Digest", "payload_bytes": "X-Payload-Length",
}
NUMBERS = ("page_id", "refers_to", "payload_bytes")
_END = b"\r\n\r\n"
_GZIP_HEAD = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _manifests(system, path: str) -> dict[str, list[str]]:
    """Names of the files that each finished write committed, by its manifest."""
    from pyarrow import fs

    out = {}
    for f in system.get_file_info(fs.FileSelector(path)):
        if f.base_name.startswith(MANIFEST):
            with system.open_input_stream(f.path) as s:
                out[f.path] = s.read().decode().split()
    return out


def _one_line(value) -> str:
    return str(value).replace("\r", "%0D").replace("\n", "%0A")


def encode_record(headers: dict[str, str | int | None], payload: bytes) -> bytes:
    """A record as a gzip member with skip-lengths."""
    lines = [b"WARC/1.1", *(f"{k}: {_one_line(v)}".encode() for k, v in headers.items() if v is not None), f"Content-Length: {len(payload)}".encode()]
    raw = b"\r\n".join(lines) + _END + payload + _END
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = squeeze.compress(raw) + squeeze.flush()
    size = len(_GZIP_HEAD) + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(raw) & 0xFFFFFFFF)
    return _GZIP_HEAD + struct.pack("<H", 12) + extra + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


class _Member:
    """The uncompressed bytes of one gzip member, read as far as asked for."""

    def __init__(self, source, start: int):
        self.source, self.start, self.length = source, start, None
        head = source.read(10)
        self.plain = not head.startswith(b"\x1f\x8b")
        self.done = len(head) == 0
        self.buffer = bytearray()
        self.inflate = None
        if self.plain:
            self.buffer += head
            return
        flags = head[3]
        if flags & 4:
            (n,) = struct.unpack("<H", source.read(2))
            extra, at = source.read(n), 0
            while at + 4 <= n:
                name, size = extra[at : at + 2], struct.unpack("<H", extra[at + 2 : at + 4])[0]
                if name == b"sl" and size == 8:
                    self.length = struct.unpack("<II", extra[at + 4 : at + 12])[0]
                at += 4 + size
        for bit in (8, 16):
            while flags & bit and source.read(1) not in (b"\0", b""):
                pass
        if flags & 2:
            source.read(2)
        self.inflate = zlib.decompressobj(-15)

    def fill(self) -> bool:
        if self.done:
            return False
        piece = self.source.read(1 << 14)
        if not piece:
            self.done = True
            return False
        if self.plain:
            self.buffer += piece
            return True
        self.buffer += self.inflate.decompress(piece)
        if self.inflate.eof:
            self.done = True
        return True

    def until(self, mark: bytes) -> bytes | None:
        at = 0
        while (found := self.buffer.find(mark, at)) < 0:
            at = max(0, len(self.buffer) - len(mark))
            if not self.fill():
                return None
        out = bytes(self.buffer[:found])
        del self.buffer[: found + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self.fill():
            pass
        if len(self.buffer) < n:
            raise EOFError(f"a record ends {n - len(self.buffer)} bytes early")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def read_records(source, wanted, payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, payload or None) of the records whose headers are wanted; ``source`` can seek."""
    at, plain = 0, None
    while True:
        if plain is None:
            source.seek(at)
            member = _Member(source, at)
            plain = member if member.plain else None
        head = member.until(_END)
        if head is None:
            if bytes(member.buffer).strip():
                raise EOFError("a record's header is cut short")
            return
        headers = dict(line.partition(": ")[::2] for line in head.decode("utf-8", "replace").strip().split("\r\n")[1:])
        size = int(headers.get("Content-Length", 0))
        keep = wanted(headers)
        skip = not (keep and payload)
        if skip and member.length:
            body = None
        else:
            body = member.take(size)
            member.take(len(_END))
        if keep:
            yield headers, body if payload else None
        if plain is not None:
            continue
        if member.length:
            at += member.length
        else:
            while not member.done and member.fill():
                member.buffer.clear()
            at = source.tell() - len(member.inflate.unused_data) + 8


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = options.get("payload", "bytes") != "none"
        self.target = int(options.get("partitionbytes", 64 << 20))
        self.filters: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if isinstance(f, (EqualTo, In)) and column in HEADERS:
                values = {str(v) for v in ([f.value] if isinstance(f, EqualTo) else f.value)}
                self.filters[column] = self.filters.get(column, values) & values
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        system, path = _filesystem(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.File:
            found = [info]
        else:
            found = system.get_file_info(fs.FileSelector(path))
            listed = _manifests(system, path)
            if listed:
                names = {name for names in listed.values() for name in names}
                found = [f for f in found if f.base_name in names]
        found = [f for f in found if f.type == fs.FileType.File and f.base_name.endswith((".warc", ".warc.gz")) and f.size]
        parts, size = [], self.target
        for f in sorted(found, key=lambda f: f.path):
            if size + f.size > self.target:
                parts.append(Files([]))
                size = 0
            parts[-1].paths.append(f.path)
            size += f.size
        return parts or [Files([])]

    def read(self, partition):
        system, _ = _filesystem(self.path)
        tests = [(HEADERS[c], v) for c, v in self.filters.items()]

        def wanted(headers):
            return all(headers.get(h) in v for h, v in tests)

        schema = pa.schema([(c, pa.int64() if c in NUMBERS else pa.string()) for c in HEADERS] + [("payload", pa.binary())])
        for path in partition.paths:
            with system.open_input_file(path) as source:
                rows, size = [], 0
                for headers, body in read_records(source, wanted, self.payload):
                    row = {c: headers.get(h) for c, h in HEADERS.items()}
                    row |= {c: int(row[c]) for c in NUMBERS if row[c] is not None} | {"payload": body}
                    rows.append(row)
                    size += len(body or b"") + 200
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class WarcWriter(DataSourceArrowWriter):
    """Takes the reader's columns; payload_digest and payload_bytes are those of the full payload."""

    def __init__(self, options, overwrite: bool = False):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, iterator):
        system, path = _filesystem(self.path)
        system.create_dir(path, recursive=True)
        name, out = f"part-{uuid.uuid4().hex}.warc.gz", None
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                headers = {h: row.get(c) for c, h in HEADERS.items()}
                out.write(encode_record(headers, row["payload"] or b""))
        if out is not None:
            out.close()
        return Written(name if out is not None else None)

    def commit(self, messages):
        system, path = _filesystem(self.path)
        system.create_dir(path, recursive=True)
        before = _manifests(system, path) if self.overwrite else {}
        with system.open_output_stream(f"{path}/{MANIFEST}{uuid.uuid4().hex}") as s:
            s.write("\n".join(m.name for m in messages if m is not None and m.name).encode())
        for manifest, names in before.items():
            system.delete_file(manifest)
            for name in names:
                system.delete_file(f"{path}/{name}")

    def abort(self, messages):
        system, path = _filesystem(self.path)
        for m in messages:
            if m is not None and m.name:
                system.delete_file(f"{path}/{m.name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def deduplicated(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Records of ``pages`` (page_id, url, html): revisits of equal payloads keep only their headers.

    Of equal payloads of at least ``least_bytes`` the smallest page_id is the response. Rows that
    repeat that page_id are responses too. A row with a null page_id is a response only if no row
    with the same payload has an id.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("uri"), body.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    firsts = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = firsts.where("n > 1").drop("n")
    # only repeated payloads come back; a hot one is split by adaptive execution
    rows = rows.join(firsts, "payload_digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select(
        "uri", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">")).alias("record_id"),
        F.lit("1970-01-01T00:00:00Z").alias("date"), "page_id", F.when(revisit, F.col("first")).alias("refers_to"),
        F.concat(F.lit("sha256:"), "payload_digest").alias("payload_digest"), "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def archive(pages: DataFrame, path: str, least_bytes: int = 100) -> None:
    """Writes a record for each row of ``pages``."""
    register(pages.sparkSession)
    deduplicated(pages, least_bytes).write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", "bytes" if payload else "none").load(path)


def verified(records: DataFrame) -> DataFrame:
    """Records whose digest and length, where they hold a payload, are taken from the payload itself."""
    full = F.col("record_type") == "response"
    return records.withColumns({
        "payload_digest": F.when(full, F.sha2("payload", 256)).otherwise(F.regexp_replace("payload_digest", "^sha256:", "")),
        "payload_bytes": F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")),
    })


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives ``pages`` in the shared folder and reads the archives back."""
    path = Workspace(pages.sparkSession, "warc").path("archive")
    archive(pages, path)
    return verified(read(pages.sparkSession, path))
