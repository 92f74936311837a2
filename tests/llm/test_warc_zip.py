import hashlib
import io
import random
import zipfile

import pytest

from lotwise.llm.tables import scratch
from lotwise.llm.warc_zip import (INDEX, RECORDS, ArchiveReader, ArchiveWriter, parse, read_archives, record,
                                  with_revisits, write_archives)


class Source:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, count, offset):
        return self.data[offset:offset + count]


def archive(tmp_path, records):
    writer = ArchiveWriter(f"{tmp_path}/one.zip")
    for page_id, data in records:
        writer.add(page_id, data)
    writer.close()
    return (tmp_path / "one.zip").read_bytes()


def test_records_round_trip(tmp_path):
    rng = random.Random(1)
    payloads = [bytes(rng.randrange(256) for _ in range(rng.randint(0, 3000))) for _ in range(50)]
    payloads += [b"", b"\r\n\r\n", b"a\r\n\r\nWARC/1.1\r\n"]
    records = [(i, record(i, "http://h/é\n?q", p, hashlib.sha1(p).hexdigest(), None, False))
               for i, p in enumerate(payloads)]
    data = archive(tmp_path, records)
    for read_bytes in (1, 5000, 1 << 20):
        assert list(ArchiveReader(Source(data)).records(read_bytes)) == [r for _, r in records]
    assert [parse(r)[2] for _, r in records] == payloads
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and {RECORDS, INDEX} <= set(z.namelist())
        assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())


def test_zip64_comments_and_other_members():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = b"PK\x05\x06" + b"x" * 30  # looks like an end record, but is not
        z.writestr("packed", b"y" * 1000, zipfile.ZIP_DEFLATED)
        with z.open("stored", "w", force_zip64=True) as member:
            member.write(b"hello")
    reader = ArchiveReader(Source(out.getvalue()))
    assert set(reader.members) == {"stored"}
    begin = reader.start("stored")
    assert out.getvalue()[begin:begin + 5] == b"hello"


def test_zip64_end_record():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(66000):  # more than the plain end record can count
            z.writestr(f"m{i}", b"")
        z.writestr("last", b"tail")
    reader = ArchiveReader(Source(out.getvalue()))
    assert len(reader.members) == 66001
    begin = reader.start("last")
    assert out.getvalue()[begin:begin + 4] == b"tail"


@pytest.mark.parametrize("data", [b"", b"PK", b"x" * 100])
def test_no_archive(data):
    with pytest.raises(ValueError):
        ArchiveReader(Source(data))


def brute(pages):
    out = []
    for page_id, html in pages:
        payload = (html or "").encode()
        ids = [p for p, h in pages if (h or "").encode() == payload and p is not None]
        top = max(ids, default=None)
        revisit = len(payload) >= 1000 and top is not None and page_id != top
        out.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(),
                    "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=repr)


def test_matches_brute_force(spark):
    long, longer = "é" * 500, "x" * 5000
    pages = [(1, long), (2, long), (3, longer), (4, longer), (4, longer), (None, longer), (5, None), (6, ""),
             (7, "short"), (8, "short"), (9, "y" * 999), (10, "y" * 999), (None, "z" * 2000), (None, "z" * 2000)]
    frame = spark.createDataFrame([(p, f"http://h/{p}" if p != 3 else None, h, "x") for p, h in pages],
                                  "page_id long, url string, html string, sha1 string")
    folder = scratch(spark, "archives")
    manifest = write_archives(with_revisits(frame).repartition(3), folder, archive_bytes=200)
    assert manifest.agg({"records": "sum"}).first()[0] == len(pages)
    got = read_archives(manifest).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got),
                  key=repr) == brute(pages)
    payloads = {r.payload_digest: bytes(r.payload) for r in got if r.record_type == "response"}
    assert all(hashlib.sha1(p).hexdigest() == d for d, p in payloads.items())


def test_empty_table(spark):
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    assert read_archives(write_archives(with_revisits(frame), scratch(spark, "archives"))).collect() == []
