import hashlib
import io
import struct

import pytest
import zstandard
from pyarrow import fs
from pyspark.sql import functions as F

from labelweave.config import InvalidInput
from labelweave.llm import warc
from labelweave.llm.warc import BundleWriter, archive, read_bundles, read_records, seek_table

from .helpers import rows_of

LONG = "<p>" + "long é " * 40
ROWS = [
    (5, "http://a/", LONG, "x"),
    (3, "http://b/\r\nX: y", LONG, "x"),
    (9, None, LONG, "x"),
    (3, "http://b/", LONG, "x"),
    (None, "http://c/", LONG, "x"),
    (1, "u", "short", "x"),
    (2, "u", "short", "x"),
    (4, "u", None, "x"),
    (6, "u", "", "x"),
    (7, "u", "WARC/1.1\r\n\r\n" * 30, "x"),
    (8, "u", "z" * 99, "x"),
    (10, "u", "z" * 99, "x"),
    (11, "u", "y" * 100, "x"),
    (12, "u", "y" * 100, "x"),
]
SCHEMA = "page_id long, url string, html string, record_type string"


def wanted():
    out = []
    for page_id, _, html, _ in ROWS:
        raw = (html or "").encode()
        same = [r[0] for r in ROWS if (r[2] or "").encode() == raw and r[0] is not None]
        first = min(same)
        again = len(raw) >= 100 and page_id != first
        out.append(
            (
                page_id,
                len(raw),
                hashlib.sha256(raw).hexdigest(),
                "revisit" if again else "response",
                first if again else None,
            )
        )
    return sorted(out, key=repr)


COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_archives_give_every_page_back(spark, staging, monkeypatch):
    pages = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    index = archive(pages, staging=staging)
    records = read_bundles(index, with_payload=True)
    assert rows_of(records, *COLUMNS) == wanted()
    payloads = {r["page_id"]: bytes(r["payload"]) for r in records.collect()}
    assert payloads[3] == LONG.encode() and payloads[5] == b"" and payloads[4] == b""
    # Single records, found through the index alone.
    some = index.filter("page_id in (3, 7, 12)")
    assert rows_of(read_records(some), *COLUMNS) == [r for r in wanted() if r[0] in (3, 7, 12)]
    ids = {r["record_id"] for r in records.collect()}
    assert len(ids) == len(ROWS) and ids == {r["record_id"] for r in index.collect()}


def test_a_bundle_is_plain_zstandard_of_warc_records(spark, staging):
    index = archive(spark.createDataFrame(ROWS, SCHEMA).coalesce(1), staging=staging)
    name = index.first()["bundle"]
    system, path = fs.FileSystem.from_uri(name)
    raw = system.open_input_file(path).read()
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True)
    assert whole.read().count(b"WARC-Record-ID") == len(ROWS)


def test_empty_tables_write_nothing(spark, staging):
    index = archive(spark.createDataFrame([], SCHEMA), staging=staging)
    assert index.count() == 0 and read_bundles(index).count() == 0


class Kept(io.BytesIO):
    def close(self):
        pass


@pytest.mark.parametrize("frame_bytes", [1, 300, 1 << 20])
def test_frames_are_independent_and_listed(monkeypatch, frame_bytes):
    monkeypatch.setattr(warc, "FRAME_BYTES", frame_bytes)
    stream = Kept()
    writer = BundleWriter(stream)
    records = [b"a" * 100, b"b" * 5, b"", b"c" * 1000, b"d"]
    for k, data in enumerate(records):
        writer.add((f"r{k}", k), data)
    index = writer.close()
    raw = stream.getvalue()
    frames = seek_table(io.BytesIO(raw), len(raw))
    magic, size = struct.unpack_from("<II", raw, sum(n for _, n in frames))
    assert magic == 0x184D2A5E and len(raw) == sum(n for _, n in frames) + 8 + size
    for _, k, number, start, packed, offset, length in index:
        assert frames[number] == (start, packed)
        data = zstandard.ZstdDecompressor().decompress(raw[start : start + packed])
        assert data[offset : offset + length] == records[k]


def test_damage_is_noticed(spark, staging):
    index = archive(spark.createDataFrame(ROWS, SCHEMA).coalesce(1), staging=staging)
    with pytest.raises(Exception, match="holds"):
        read_bundles(index.filter("page_id <> 3")).count()
    with pytest.raises(InvalidInput):
        seek_table(io.BytesIO(b"0123456789"), 10)
    assert index.filter(F.col("offset") < 0).count() == 0
