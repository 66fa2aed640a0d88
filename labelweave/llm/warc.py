"""WARC archives in seekable Zstandard bundles.

A bundle is a series of independent Zstandard frames, each holding whole WARC records, and ends with
a skippable frame that lists the frames' sizes (the public seekable format).  Any Zstandard tool
reads a bundle from end to end; with the list a reader goes straight to one frame.  An index table
maps every record to its bundle, frame, and place within the frame.

Spark tasks write bundles under names of their own, so a task that is run again never touches what
another attempt wrote; the index holds the attempts that were committed, and only their bundles are
read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import InvalidInput
from ..session import Staging
from .shipping import map_arrow

#: Uncompressed bytes after which a frame is closed, and compressed bytes that close a bundle.
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 64 << 20
#: Payloads that are shorter are never replaced by a revisit.
LEAST_SHARED = 100
#: Parts that the rows of one frequent payload are dealt out to.
SALTS = 16

# Fixed values of the public formats.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
WARC_VERSION = b"WARC/1.1"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX_SCHEMA = (
    "record_id string, page_id {kind}, bundle string, frame long, frame_start long,"
    " frame_bytes long, offset long, length long"
)


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path within it."""
    return fs.FileSystem.from_uri(uri)


def record(
    page_id, url: str | None, payload: bytes, digest: str, record_type: str, refers_to
) -> tuple[str, bytes]:
    """Id and bytes of one record; a revisit names what it repeats and has an empty block."""
    record_id = f"urn:uuid:{uuid.uuid4()}"
    block = b"" if record_type == "revisit" else payload
    headers = [
        ("WARC-Type", record_type),
        ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Payload-Length", str(len(payload))),
        ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        headers.append(("Page-ID", str(page_id)))
    if url:
        # A line break would end the header.
        headers.append(("WARC-Target-URI", "".join(url.splitlines())))
    if record_type == "revisit":
        headers.append(("WARC-Profile", REVISIT_PROFILE.decode()))
        headers.append(("Refers-To-Page", str(refers_to)))
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in headers)
    return record_id, WARC_VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record that starts at a place, and where the next one does."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].split(b"\r\n")
    if version != WARC_VERSION:
        raise InvalidInput("not a WARC record")
    headers = dict(line.decode().split(": ", 1) for line in lines)
    start = end + 4
    stop = start + int(headers["Content-Length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise InvalidInput("a WARC record does not end where it should")
    return headers, data[start:stop], stop + 4


@dataclass
class BundleWriter:
    """Writes records to one bundle and remembers where each one went."""

    stream: object
    compressor: zstandard.ZstdCompressor = field(
        default_factory=lambda: zstandard.ZstdCompressor(level=3, write_checksum=True)
    )
    frames: list[tuple[int, int]] = field(default_factory=list)
    written: int = 0
    pending: bytearray = field(default_factory=bytearray)
    places: list[tuple] = field(default_factory=list)
    index: list[tuple] = field(default_factory=list)

    def add(self, key: tuple, data: bytes) -> None:
        self.places.append((key, len(self.pending), len(data)))
        self.pending += data
        if len(self.pending) >= FRAME_BYTES:
            self.end_frame()

    def end_frame(self) -> None:
        if not self.pending:
            return
        packed = self.compressor.compress(bytes(self.pending))
        number, start = len(self.frames), self.written
        self.index += [
            (*key, number, start, len(packed), at, size) for key, at, size in self.places
        ]
        self.stream.write(packed)
        self.frames.append((len(packed), len(self.pending)))
        self.written += len(packed)
        self.pending, self.places = bytearray(), []

    def close(self) -> list[tuple]:
        self.end_frame()
        table = b"".join(struct.pack("<II", *sizes) for sizes in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table) + len(footer)))
        self.stream.write(table + footer)
        self.stream.close()
        return self.index


def seek_table(stream, size: int) -> list[tuple[int, int]]:
    """Place and compressed size of every frame, read from the end of a bundle."""
    stream.seek(size - 9)
    number, _, magic = struct.unpack("<IBI", stream.read(9))
    if magic != SEEKABLE_MAGIC:
        raise InvalidInput("the bundle has no seek table")
    stream.seek(size - 9 - 8 * number)
    entries = struct.iter_unpack("<II", stream.read(8 * number))
    frames, at = [], 0
    for packed, _ in entries:
        frames.append((at, packed))
        at += packed
    return frames


def read_frame(stream, start: int, size: int) -> bytes:
    stream.seek(start)
    return zstandard.ZstdDecompressor().decompress(stream.read(size))


def decide(pages: DataFrame, id_column: str, url_column: str, payload_column: str) -> DataFrame:
    """``page_id, url, payload, digest, record_type, refers_to`` of every page.

    Payloads travel once: the first page of each repeated payload is found from digests alone and
    sent to ``SALTS`` places, over which the pages of one payload are dealt out.  Shorter payloads,
    of which many may be equal, meet nothing and are dealt out by their ids.
    """
    payload = F.coalesce(F.col(payload_column), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_column).alias("page_id"),
        F.col(url_column).cast("string").alias("url"),
        payload.alias("payload"),
    ).select("*", F.sha2("payload", 256).alias("digest"))
    first_salt, last_salt = F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")
    firsts = (
        rows.filter(F.octet_length("payload") >= LEAST_SHARED)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("digest", "first", F.explode(F.sequence(first_salt, last_salt)).alias("salt"))
    )
    spread = F.xxhash64("page_id", "url")
    short = F.octet_length("payload") < LEAST_SHARED
    # Negative numbers are no salts.
    salt = F.when(short, -1 - F.abs(F.shiftright(spread, 1))).otherwise(F.pmod(spread, F.lit(SALTS)))
    salted = rows.withColumn("salt", salt)
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return salted.join(firsts, ["digest", "salt"], "left").select(
        "page_id",
        "url",
        "payload",
        "digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"),
    )


def write_bundles(decided: DataFrame, folder: str) -> DataFrame:
    """Write every row of ``decide`` as a record below a folder that all executors reach.

    Returns the index, a frame to be written to a table at once: working it out writes bundles.
    """
    kind = decided.schema["page_id"].dataType.simpleString()
    names = [part.split()[0] for part in INDEX_SCHEMA.split(", ")]

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_folder(folder)
        writer, name, page_type = None, "", None

        def finish() -> pa.RecordBatch:
            rows = [(r, p, f"{folder}/{name}", *rest) for r, p, *rest in writer.close()]
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(columns[0]), pa.array(columns[1], page_type)]
            arrays += [pa.array(columns[2]), *(pa.array(c, pa.int64()) for c in columns[3:])]
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            page_type = batch.column(0).type
            for k in range(batch.num_rows):
                page_id, url, payload, digest, record_type, refers_to = (
                    batch.column(c)[k].as_py() for c in range(6)
                )
                if writer is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    system.create_dir(root, recursive=True)
                    # The frames are compressed here; the file system must not do it again.
                    stream = system.open_output_stream(f"{root}/{name}", compression=None)
                    writer = BundleWriter(stream)
                record_id, data = record(page_id, url, payload, digest, record_type, refers_to)
                writer.add((record_id, page_id), data)
                if writer.written >= BUNDLE_BYTES:
                    yield finish()
                    writer = None
        if writer is not None:
            yield finish()

    return map_arrow(decided, per_task, INDEX_SCHEMA.format(kind=kind))


RECORD_SCHEMA = (
    "record_id string, page_id {kind}, url string, payload_bytes long, payload_digest string,"
    " record_type string, refers_to {kind}, payload binary"
)


def _rows_to_batch(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = [pa.string()] * 3 + [pa.int64()] + [pa.string()] * 3 + [pa.binary()]
    names = [part.split()[0] for part in RECORD_SCHEMA.split(", ")]
    n = 8 if with_payload else 7
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns[:n], kinds[:n], strict=True)], names[:n]
    )


def _describe(headers: dict[str, str], block: bytes) -> tuple:
    """What a record says of its payload, checked against the payload where it has one."""
    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    size, record_type = int(headers["Payload-Length"]), headers["WARC-Type"]
    if record_type == "response" and (
        len(block) != size or hashlib.sha256(block).hexdigest() != digest
    ):
        raise InvalidInput("a payload does not match its digest")
    return (
        headers["WARC-Record-ID"].strip("<>"),
        headers.get("Page-ID"),
        headers.get("WARC-Target-URI"),
        size,
        digest,
        record_type,
        headers.get("Refers-To-Page"),
        block,
    )


def read_bundles(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """All records of the bundles in an index, read from the archives, one bundle after another.

    A bundle that holds another number of records than the index says is an error.
    """
    kind = index.schema["page_id"].dataType.simpleString()
    n_bundles = index.agg(F.countDistinct("bundle")).first()[0]
    # The names alone are few bytes, which would be merged into one task.
    bundles = index.groupBy("bundle").agg(F.count(F.lit(1)).alias("records"))
    bundles = bundles.repartition(max(1, n_bundles))

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, expected in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, path = open_folder(name)
                found = 0
                with system.open_input_file(path) as stream:
                    for start, size in seek_table(stream, stream.size()):
                        data, at, rows = read_frame(stream, start, size), 0, []
                        while at < len(data):
                            headers, block, at = parse(data, at)
                            rows.append(_describe(headers, block))
                        found += len(rows)
                        yield _rows_to_batch(rows, with_payload)
                if found != expected:
                    raise InvalidInput(f"{name} holds {found} records instead of {expected}")

    return _typed(map_arrow(bundles, per_task, _record_schema(with_payload)), kind)


def read_records(wanted: DataFrame) -> DataFrame:
    """Single records, given by rows of the index: only the frames that hold them are read."""
    kind = wanted.schema["page_id"].dataType.simpleString()
    places = wanted.select("bundle", "frame_start", "frame_bytes", "offset", "length")
    together = places.repartition("bundle").sortWithinPartitions("bundle", "frame_start")

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_frame, data, at_bundle, stream = None, b"", None, None
        for batch in batches:
            rows = []
            for name, start, size, offset, length in zip(
                *(c.to_pylist() for c in batch.columns), strict=True
            ):
                if name != at_bundle:
                    system, path = open_folder(name)
                    stream, at_bundle, at_frame = system.open_input_file(path), name, None
                if start != at_frame:
                    data, at_frame = read_frame(stream, start, size), start
                headers, block, _ = parse(data[offset : offset + length], 0)
                rows.append(_describe(headers, block))
            if rows:
                yield _rows_to_batch(rows, True)

    return _typed(map_arrow(together, per_task, _record_schema(True)), kind)


def _record_schema(with_payload: bool) -> str:
    schema = RECORD_SCHEMA.format(kind="string")
    return schema if with_payload else schema.rsplit(",", 1)[0]


def _typed(records: DataFrame, kind: str) -> DataFrame:
    return records.withColumn("page_id", F.col("page_id").cast(kind)).withColumn(
        "refers_to", F.col("refers_to").cast(kind)
    )


def archive(
    pages: DataFrame,
    folder: str | None = None,
    id_column: str = "page_id",
    url_column: str = "url",
    payload_column: str = "html",
    staging: Staging | None = None,
) -> DataFrame:
    """Write all pages to bundles and return the index.

    A null payload is empty.  Of equal payloads of at least ``LEAST_SHARED`` bytes the smallest id
    is the response, also every repeated row with that id; rows with another or a null id revisit
    it; if all ids are null, all are responses.  An empty table writes no bundle.  Columns other
    than the three named are not read.
    """
    staging = staging or Staging(pages.sparkSession)
    folder = folder or f"{staging.path}/bundles"
    decided = decide(pages, id_column, url_column, payload_column)
    return staging.write(write_bundles(decided, folder), "index")
