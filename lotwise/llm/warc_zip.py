"""WARC records in ZIP-packaged archives: writing and range reading.

An archive is a ZIP file with two stored (uncompressed) members:
``archive/data.warc.gz``, WARC records that are gzip members of their own, and
``indexes/index.cdxj``, one line per record with its offset and length in that
member.  The reader parses the ZIP end records (ZIP64 too) and the central
directory, finds both members, and reads each record by its byte range; nothing
is extracted.

Of records with equal payloads of ``least_bytes`` or more, the one with the
largest page id is a ``response``; the others are ``revisit`` records that
refer to it and carry the HTTP headers (with the full payload's length) alone.

Archives go to the shared folder through the file system that its URI names.
A task gives its archives names of its own and returns them in a manifest that
Spark commits, so the files of failed or repeated attempts are never read.

Defined results: a null html is an empty payload; null ids count as the
smallest, and a group without any id has only responses; rows that repeat the
largest id are all responses; a null url becomes an empty target; an empty table
gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm.tables import cut, scratch, table

LEAST_BYTES = 1000
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 4 << 20
RECORDS = "archive/data.warc.gz"
INDEX = "indexes/index.cdxj"
DATE = "1970-01-01T00:00:00Z"

WRITTEN = "archive string, records long"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def file_system(uri: str):
    """The file system that a URI names, and the path in it."""
    from pyarrow import fs
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


# --- records -----------------------------------------------------------------

def urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(value: str | None) -> int | None:
    number = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None,
           revisit: bool) -> bytes:
    """One WARC record."""
    target = "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(page_id)}",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {urn(refers_to)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _headers(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = block.partition(b"\r\n\r\n")
    fields = (line.split(":", 1) for line in head.decode().split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, v in fields}, rest


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""
    warc, rest = _headers(data)
    http, payload = _headers(rest[:int(warc["content-length"])])
    return warc, http, payload


# --- ZIP ---------------------------------------------------------------------

class _Counted(io.RawIOBase):
    """A write-only stream that knows its position."""

    def __init__(self, out):
        self.out, self.at = out, 0

    def writable(self):
        return True

    def write(self, data):
        self.out.write(bytes(data))
        self.at += len(data)
        return len(data)

    def tell(self):
        return self.at

    def flush(self):
        pass


class ArchiveWriter:
    """Streams records to a new archive; memory holds its index lines only."""

    def __init__(self, uri: str):
        self.uri = uri
        system, path = file_system(uri)
        self.stream = system.open_output_stream(path)
        self.zip = zipfile.ZipFile(_Counted(self.stream), "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(RECORDS, "w", force_zip64=True)
        self.lines: list[str] = []
        self.size = 0

    def add(self, page_id: int | None, data: bytes) -> None:
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        packed = packer.compress(data) + packer.flush()
        self.member.write(packed)
        entry = json.dumps({"offset": self.size, "length": len(packed)})
        self.lines.append(f"{urn(page_id)} 19700101000000 {entry}\n")
        self.size += len(packed)

    def close(self) -> None:
        self.member.close()
        self.zip.writestr(INDEX, "".join(self.lines))
        self.zip.close()
        self.stream.close()


class ArchiveReader:
    """Range reads over a ZIP file with stored members.

    ``source`` has ``size()`` and ``read_at(count, offset)``.
    """

    def __init__(self, source):
        self.source = source
        self.members = self._directory()

    def _read(self, offset: int, count: int) -> bytes:
        data = bytes(self.source.read_at(count, offset))
        if len(data) != count:
            raise ValueError("the archive ends early")
        return data

    def _directory(self) -> dict[str, tuple[int, int]]:
        """Name to (local header offset, size) of every member."""
        size = self.source.size()
        tail_at = max(0, size - 65557)  # the end record and its longest comment
        tail = self._read(tail_at, size - tail_at)
        at = len(tail) - 22
        while at >= 0 and not (tail[at:at + 4] == b"PK\x05\x06"
                               and at + 22 + int.from_bytes(tail[at + 20:at + 22], "little") == len(tail)):
            at -= 1
        if at < 0:
            raise ValueError("no ZIP end record")
        count, length, offset = struct.unpack("<HII", tail[at + 10:at + 20])
        locator = tail_at + at - 20
        if locator >= 0 and (place := self._read(locator, 20))[:4] == b"PK\x06\x07":
            end = self._read(int.from_bytes(place[8:16], "little"), 56)
            if end[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record")
            count, length, offset = struct.unpack("<QQQ", end[32:56])
        data, members, at = self._read(offset, length), {}, 0
        for _ in range(count):
            if data[at:at + 4] != b"PK\x01\x02":
                raise ValueError("bad central directory")
            method, = struct.unpack("<H", data[at + 10:at + 12])
            packed, full, name_n, extra_n, comment_n = struct.unpack("<IIHHH", data[at + 20:at + 34])
            header, = struct.unpack("<I", data[at + 42:at + 46])
            name = data[at + 46:at + 46 + name_n].decode()
            extra = data[at + 46 + name_n:at + 46 + name_n + extra_n]
            full, packed, header = self._wide(extra, full, packed, header)
            if method == 0:
                members[name] = (header, packed)
            at += 46 + name_n + extra_n + comment_n
        return members

    @staticmethod
    def _wide(extra: bytes, *values: int) -> list[int]:
        """Replace each value of all ones by the next one of the ZIP64 extra field."""
        at, wide = 0, b""
        while at + 4 <= len(extra):
            kind, size = struct.unpack("<HH", extra[at:at + 4])
            if kind == 1:
                wide = extra[at + 4:at + 4 + size]
            at += 4 + size
        out = []
        for value in values:
            if value == 0xFFFFFFFF:
                value, wide = int.from_bytes(wide[:8], "little"), wide[8:]
            out.append(value)
        return out

    def start(self, name: str) -> int:
        """Where a stored member's bytes begin."""
        header = self._read(self.members[name][0], 30)
        if header[:4] != b"PK\x03\x04":
            raise ValueError("bad local header")
        name_n, extra_n = struct.unpack("<HH", header[26:30])
        return self.members[name][0] + 30 + name_n + extra_n

    def records(self, read_bytes: int = READ_BYTES):
        """All records in index order; neighbouring ranges are read together."""
        begin = self.start(INDEX)
        index = self._read(begin, self.members[INDEX][1]).decode()
        ranges = [(e["offset"], e["length"]) for e in
                  (json.loads(line.split(" ", 2)[2]) for line in index.splitlines())]
        begin, k = self.start(RECORDS), 0
        while k < len(ranges):
            first, last = ranges[k][0], k
            while (last + 1 < len(ranges) and ranges[last + 1][0] == sum(ranges[last])
                   and sum(ranges[last + 1]) - first <= read_bytes):
                last += 1
            data = self._read(begin + first, sum(ranges[last]) - first)
            for offset, length in ranges[k:last + 1]:
                yield zlib.decompress(data[offset - first:offset - first + length], 31)
            k = last + 1


# --- Spark -------------------------------------------------------------------

def with_revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, payload, sha1, refers_to, revisit) for each page."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        payload.alias("payload"), F.sha1(payload).alias("sha1"))
    shared = (rows.where(F.octet_length("payload") >= least_bytes).groupBy("sha1")
              .agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
              .select(F.col("sha1").alias("s_sha1"), "response"))
    rows = rows.join(shared, F.col("sha1") == F.col("s_sha1"), "left")
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    return rows.select("page_id", "url", "payload", "sha1", F.when(revisit, F.col("response")).alias("refers_to"),
                       revisit.alias("revisit"))


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the records; returns the stored manifest (archive, records)."""
    system, path = file_system(folder)
    system.create_dir(path)

    def run(batches):
        writer, done = None, []
        for batch in batches:
            columns = [batch.column(n) for n in ("page_id", "url", "payload", "sha1", "refers_to", "revisit")]
            for values in zip(*columns):
                page_id, url, payload, sha1, refers_to, revisit = (v.as_py() for v in values)
                if writer is None:
                    writer = ArchiveWriter(f"{folder}/{uuid.uuid4().hex}.zip")
                writer.add(page_id, record(page_id, url, payload, sha1, refers_to, revisit))
                if writer.size >= archive_bytes:
                    writer.close()
                    done.append((writer.uri, len(writer.lines)))
                    writer = None
        if writer is not None:
            writer.close()
            done.append((writer.uri, len(writer.lines)))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()),
                                          pa.array([d[1] for d in done], pa.int64())], ["archive", "records"])

    return cut(rows.mapInArrow(run, WRITTEN), "manifest")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of the archives; payloads are checked against their digests."""

    def run(batches):
        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                system, path = file_system(uri)
                with system.open_input_file(path) as source:
                    held = []
                    for data in ArchiveReader(source).records():
                        held.append(row(*parse(data)))
                        if len(held) >= 1000:
                            yield as_batch(held)
                            held = []
                    yield as_batch(held)

    def row(warc, http, payload):
        sha1 = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
        kind = warc["warc-type"]
        if kind == "response" and hashlib.sha1(payload).hexdigest() != sha1:
            raise ValueError(f"bad payload of {warc['warc-record-id']}")
        return (page_of(warc["warc-record-id"]), warc["warc-target-uri"], int(http["content-length"]), sha1, kind,
                page_of(warc.get("warc-refers-to")), payload if payloads else None)

    def as_batch(held):
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
        return pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], kind) for i, kind in enumerate(kinds)], names)

    # a task of its own for each archive, as far as a few waves of tasks go
    waves = 4 * int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = max(1, min(manifest.count(), waves))
    return manifest.repartition(files).mapInArrow(run, READ + ", payload binary")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` written to archives and read back."""
    manifest = write_archives(with_revisits(table(spark, sf_dir, "pages")), scratch(spark, "archives"))
    return read_archives(manifest, payloads=False).drop("payload", "url")


OP2_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (
  SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest FROM p),
g AS (
  SELECT *, max(page_id) OVER (PARTITION BY digest) AS top FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM top AND top IS NOT NULL
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM g
"""
