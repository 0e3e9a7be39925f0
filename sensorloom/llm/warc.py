"""WARC records in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding whole records, and ends in a
skippable frame with the seek table of the seekable format: the compressed and plain size of
each frame. An index table maps each record to its bundle, frame and offset in the plain frame,
so one record is read by decoding one frame.

Records with equal payloads are found by their SHA-1: the smallest page_id of a payload is the
response, the others are revisit records that name it and carry no payload. Only ids and
digests are shuffled for that; the pages themselves move once, by their id.

Tasks write their bundles through pyarrow's file systems into the given folder. A bundle's name
is new for each attempt and the index names only those of attempts that Spark has accepted, so
a lost or repeated task leaves no wrong record behind, only files nothing refers to.

Defined results: a null html is an empty payload; rows that repeat the response's page_id and
payload are responses too; a payload below `least_bytes` is always a response; a null page_id
is kept and refers like any other, but is referred to only by rows without an id.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20
LEVEL = 3
CAPTURED = "1970-01-01T00:00:00Z"  # the pages have no capture time of their own

# Fixed values of the seekable format and of WARC 1.1.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
VERSION = "WARC/1.1"
IDENTICAL_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_RECORD_NAMES = uuid.UUID("6f1d3c52-7a0e-5c7f-9a34-2d1f6b8e4c11")
_INDEX = "page_id long, record_id string, bundle string, frame int, offset long, length long"
_RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_RECORD_NAMES, str(page_id))}>"


def render(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record, header and block."""
    safe_url = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        VERSION,
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {CAPTURED}",
        f"WARC-Target-URI: {safe_url}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {IDENTICAL_PAYLOAD}", f"WARC-Refers-To: {_record_id(refers_to)}"]
        if refers_to is not None:
            lines.append(f"X-Refers-To-Page: {refers_to}")
    block = b"" if revisit else payload
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != VERSION:
        raise ValueError(f"not a record: {version[:40]!r}")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's block is not as long as it says")
    return fields, rest[:size]


class BundleWriter:
    """Appends records to bundles in a folder and remembers where each went."""

    def __init__(self, folder: str):
        self.system, self.path = fs.FileSystem.from_uri(folder)
        self.attempt, self.number, self.file = uuid.uuid4().hex, 0, None
        self.places: list[tuple] = []
        self._open_frame()

    def _open_frame(self) -> None:
        self.frame, self.held = [], 0

    def add(self, page_id: int | None, record: bytes) -> None:
        if self.held and self.held + len(record) > FRAME_BYTES:
            self._end_frame()
        if self.file is None:
            self.name = f"bundle-{self.attempt}-{self.number:05d}.warc.zst"
            self.system.create_dir(self.path, recursive=True)
            self.file = self.system.open_output_stream(f"{self.path}/{self.name}", compression=None)
            self.number, self.sizes, self.written = self.number + 1, [], 0
        self.places.append((page_id, _record_id(page_id), self.name, len(self.sizes), self.held, len(record)))
        self.frame.append(record)
        self.held += len(record)

    def _end_frame(self) -> None:
        data = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True).compress(b"".join(self.frame))
        self.file.write(data)
        self.sizes.append((len(data), self.held))
        self.written += len(data)
        self._open_frame()
        if self.written >= BUNDLE_BYTES:
            self._end_bundle()

    def _end_bundle(self) -> None:
        table = b"".join(struct.pack("<II", *sizes) for sizes in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        self.file.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table) + len(footer)) + table + footer)
        self.file.close()
        self.file = None

    def close(self) -> None:
        if self.held:
            self._end_frame()
        if self.file is not None:
            self._end_bundle()

    def taken(self) -> list[tuple]:
        places, self.places = self.places, []
        return places


class BundleReader:
    """Reads frames of one bundle by its seek table."""

    def __init__(self, folder: str, name: str):
        system, path = fs.FileSystem.from_uri(folder)
        self.file = system.open_input_file(f"{path}/{name}")
        size = self.file.size()
        count, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{name} has no seek table")
        table = self._at(size - 9 - 8 * count, 8 * count)
        self.starts, self.sizes, start = [], [], 0
        for packed, plain in struct.iter_unpack("<II", table):
            self.starts.append(start)
            self.sizes.append((packed, plain))
            start += packed
        self.number = self.plain = None

    def _at(self, position: int, size: int) -> bytes:
        self.file.seek(position)
        return self.file.read(size)

    def frame(self, number: int) -> bytes:
        if number != self.number:
            packed, plain = self.sizes[number]
            data = self._at(self.starts[number], packed)
            self.number, self.plain = number, zstandard.ZstdDecompressor().decompress(data)
        return self.plain


def _payload(html: Column) -> Column:
    return F.coalesce(html, F.lit("")).cast("binary")


def responses(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, sha1 and refers_to of each distinct (page_id, payload): the smallest id with its payload."""
    known = pages.select(F.col("page_id").cast("long"), _payload(F.col("html")).alias("payload")).select(
        "page_id", F.sha1("payload").alias("sha1"), (F.octet_length("payload") >= least_bytes).alias("shared")
    )
    known = known.distinct()
    firsts = known.where("shared").groupBy("sha1").agg(F.min("page_id").alias("refers_to"))
    return known.join(firsts, "sha1", "left").select("page_id", "sha1", "shared", "refers_to")


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write the bundles and their index into the folder; returns the index."""
    spark = pages.sparkSession
    bundles = f"{folder}/bundles"
    own = pages.select(F.col("page_id").cast("long"), "url", _payload(F.col("html")).alias("payload"))
    own = own.withColumn("sha1", F.sha1("payload"))
    found = responses(pages, least_bytes).withColumnsRenamed({"page_id": "_page", "sha1": "_sha1"})
    joined = own.join(found, own["page_id"].eqNullSafe(found["_page"]) & (own["sha1"] == found["_sha1"]))
    revisit = F.col("shared") & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    records = joined.select("page_id", "url", "payload", "sha1", "refers_to", revisit.alias("revisit"))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BundleWriter(bundles)
        for batch in batches:
            for page_id, url, payload, sha1, refers_to, again in zip(*batch.columns):
                page_id, data = page_id.as_py(), payload.as_py()
                digest = base64.b32encode(bytes.fromhex(sha1.as_py())).decode()
                writer.add(page_id, render(page_id, url.as_py(), data, digest, refers_to.as_py(), again.as_py()))
            yield _rows(writer.taken())
        writer.close()

    records.mapInArrow(convert, _INDEX).write.option("compression", "zstd").parquet(f"{folder}/index")
    return spark.read.schema(_INDEX).parquet(f"{folder}/index")


def _rows(places: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
    columns = list(zip(*places)) or [()] * len(kinds)
    names = [part.split()[0] for part in _INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def read(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records that the index rows name, read from the bundles of the folder.

    Any part of the index will do: only the frames it names are read and decoded. The digest
    of every response is checked against its payload.
    """
    bundles = f"{folder}/bundles"
    schema = _RECORDS + (", payload binary" if with_payload else "")

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, name = None, None
        for batch in batches:
            found = []
            for bundle, frame, offset, length in zip(*(batch.column(c).to_pylist() for c in _WHERE)):
                if bundle != name:
                    reader, name = BundleReader(bundles, bundle), bundle
                fields, block = parse(reader.frame(frame)[offset : offset + length])
                found.append(_record(fields, block) + ((block,) if with_payload else ()))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
            names = [part.split()[0] for part in schema.split(", ")]
            columns = [pa.array(c, k) for c, k in zip(zip(*found), kinds)]
            if found:
                yield pa.RecordBatch.from_arrays(columns, names=names)

    wanted = index.select(*_WHERE).repartition("bundle", "frame").sortWithinPartitions(*_WHERE)
    return wanted.mapInArrow(convert, schema)


_WHERE = ("bundle", "frame", "offset", "length")


def _record(fields: dict[str, str], block: bytes) -> tuple:
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and base64.b32encode(hashlib.sha1(block).digest()).decode() != digest:
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} has another digest")
    page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page")
    return (
        None if page is None else int(page),
        fields["WARC-Target-URI"],
        int(fields["X-Payload-Length"]),
        digest,
        kind,
        None if refers is None else int(refers),
    )


def archive(spark: SparkSession, pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write all pages, read all records back."""
    return read(write(pages, folder, least_bytes), folder)
