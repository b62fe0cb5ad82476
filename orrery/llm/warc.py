"""WARC archives compressed with Zstandard: writer and reader.

An archive starts with a skippable frame that holds the dictionary of its records, and then has one
frame per record. Payloads that repeat are written as revisit records that name the response.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._work import broadcast_if, join_counted, new_path, stored, tidy

#: Fixed values of the format: the skippable frame's magic number for dictionaries, version line.
DICTIONARY_MAGIC = 0x184D2A5D
VERSION = b"WARC/1.1"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SUFFIX = ".warc.zst"

#: Least payload that a revisit record is worth.
LEAST_REVISIT = 100
#: An archive is closed beyond so many bytes, so that a reader can hold one.
ARCHIVE_BYTES = 16 << 20
#: The dictionary comes from an archive's first records: so many, of so many bytes together.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 200, 2 << 20, 32 << 10
#: So many digests of repeated payloads are broadcast at most; more are joined by shuffle.
BROADCAST_DIGESTS = 500_000


class WarcError(ValueError):
    """An archive or record that breaks the format."""


def _headers(fields: list[tuple[str, str]]) -> bytes:
    return b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)


def _name(page_id) -> str:
    """A record's name, which holds any id: percent-encoded after a dot; nothing for a null one."""
    return f"<urn:x-page:{'' if page_id is None else '.' + quote(str(page_id), safe='')}>"


def _id(name: str | None) -> str | None:
    found = re.fullmatch(r"<urn:x-page:\.(.*)>", name or "")
    return unquote(found[1]) if found else None


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """The bytes of a response or revisit record. A revisit's block ends after the HTTP headers,
    whose Content-Length is still the full payload's."""
    http = b"HTTP/1.1 200 OK\r\n" + _headers([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]) + b"\r\n"
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:x-page:none")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _name(page_id)),
        ("WARC-Target-URI", uri),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(refers_to))]
    return VERSION + b"\r\n" + _headers([*fields, ("Content-Length", str(len(block)))]) + b"\r\n" + block + b"\r\n\r\n"


def dictionary_frame(samples: list[bytes]) -> tuple[zstd.ZstdCompressionDict | None, bytes]:
    """A dictionary trained on samples, or their own bytes where they are too few to train one; and
    the skippable frame that holds it, compressed where that is shorter."""
    try:
        trained = zstd.train_dictionary(DICTIONARY_BYTES, samples, level=3)
    except zstd.ZstdError:
        trained = zstd.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES] or b"\0" * 8, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    raw = trained.as_bytes()
    packed = zstd.ZstdCompressor(level=19).compress(raw)
    body = packed if len(packed) < len(raw) else raw
    return trained, struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body


class ArchiveWriter:
    """Collects the records of one archive; data() is the archive."""

    def __init__(self):
        self.frames: list[bytes] = []
        self.waiting: list[bytes] = []
        self.size = self.records = self._sampled = 0
        self.compressor = None
        self.head = b""

    def add(self, raw: bytes) -> None:
        self.records += 1
        if self.compressor is None:
            self.waiting.append(raw)
            self._sampled += len(raw)
            if len(self.waiting) < SAMPLE_RECORDS and self._sampled < SAMPLE_BYTES:
                return
            self._start()
        else:
            self._frame(raw)

    def _start(self) -> None:
        dictionary, self.head = dictionary_frame(self.waiting)
        self.compressor = zstd.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True, write_content_size=True)
        for raw in self.waiting:
            self._frame(raw)
        self.waiting = []

    def _frame(self, raw: bytes) -> None:
        frame = self.compressor.compress(raw)
        self.frames.append(frame)
        self.size += len(frame)

    def data(self) -> bytes:
        if self.compressor is None:
            self._start()
        return self.head + b"".join(self.frames)


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    block: bytes


def parse(raw: bytes) -> Record:
    """A record from its bytes, with its version, headers, length and block digest validated."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] != VERSION:
        raise WarcError("no version line, or headers without end")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name.strip():
            raise WarcError(f"bad header line {line[:80]!r}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"header {name} is missing")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise WarcError("Content-Length is not the block's length")
    block = rest[:-4]
    if (said := headers.get("warc-block-digest", "")).startswith("sha256:") and said[7:] != hashlib.sha256(block).hexdigest():
        raise WarcError("the block's digest differs")
    return Record(headers, block)


def read_archive(data: bytes, step: int = 1 << 16) -> Iterator[Record]:
    """The records of an archive, one frame each."""
    if len(data) < 8:
        raise WarcError("no leading frame")
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC or len(data) < 8 + size:
        raise WarcError("the leading frame is no dictionary frame")
    raw = data[8 : 8 + size]
    if raw[:4] == zstd.FRAME_HEADER:
        raw = zstd.ZstdDecompressor().decompress(raw)
    kind = zstd.DICT_TYPE_AUTO if raw[:4] == b"\x37\xa4\x30\xec" else zstd.DICT_TYPE_RAWCONTENT
    decompressor = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(raw, dict_type=kind))
    at, view = 8 + size, memoryview(data)
    while at < len(data):
        frame, parts = decompressor.decompressobj(), []
        while not frame.eof:
            if at >= len(data):
                raise WarcError("the last frame is cut off")
            piece = view[at : at + step]
            try:
                parts.append(frame.decompress(piece))
            except zstd.ZstdError as e:
                raise WarcError(f"bad frame: {e}") from e
            at += len(piece) - len(frame.unused_data)
        yield parse(b"".join(parts))


def _save(folder: str, name: str, data: bytes) -> None:
    """Write under a name of this attempt's own, then move: a repeated task leaves the same file."""
    if re.match(r"file:|/", folder):
        top = re.sub(r"^file:/*", "/", folder)
        os.makedirs(top, exist_ok=True)
        own = f"{top}/.{name}.{uuid.uuid4().hex}"
        with open(own, "wb") as f:
            f.write(data)
        os.replace(own, f"{top}/{name}")
    else:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        own = f"{top}/.{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(own) as f:
            f.write(data)
        store.move(own, f"{top}/{name}")


def with_types(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, payload, digest, revisit, first): which records are revisits, and of what."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    again = rows.where(F.length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = stored(again, "warc-digests")
    if again.count() <= BROADCAST_DIGESTS:
        joined = rows.join(F.broadcast(again.drop("n")), "digest", "left")
    else:  # payloads are moved, but for those of very many pages
        joined = join_counted(rows, again, ["digest"], "n")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", revisit.alias("revisit"), "first")


def write_archives(pages: DataFrame, folder: str, *, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row of pages (page_id, url, html) to archives in folder, which all
    executors share; returns (name, records, bytes) of each archive. An id may be any text. Null html is an empty payload,
    a null url a placeholder. Of rows that share the least page_id and the payload all are responses."""

    def run(batches):
        part, n, writer = TaskContext.get().partitionId(), 0, ArchiveWriter()
        made = []

        def close():
            nonlocal n, writer
            name, data = f"part-{part:06d}-{n:05d}{SUFFIX}", writer.data()
            _save(folder, name, data)
            made.append((name, writer.records, len(data)))
            n, writer = n + 1, ArchiveWriter()

        for b in batches:
            for page_id, url, payload, digest, revisit, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                writer.add(record(page_id, url, payload, digest, first, revisit))
                if writer.size >= archive_bytes:
                    close()
        if writer.records:
            close()
        if made:
            names, records, sizes = zip(*made, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], ["name", "records", "bytes"])

    return stored(with_types(pages).mapInArrow(tidy(run), "name string, records long, bytes long"), "warc-archives")


def read_archives(spark: SparkSession, folder: str, written: DataFrame | None = None) -> DataFrame:
    """(record_type, page_id, url, payload_bytes, payload_digest, refers_to, payload) of each record
    of the archives in folder; payload is null for a revisit. A response whose payload doesn't have
    the digest or length that its headers state is an error, as is every other break of the format.
    With the table that write_archives returned only the archives that it names are read: a task
    that was run again may have left others."""
    schema = "record_type string, page_id string, url string, payload_bytes long, payload_digest string, refers_to string, payload binary"
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder).select("path", "content")
    if written is not None:
        names = written.select("name")
        files = files.withColumn("name", F.substring_index("path", "/", -1)).join(broadcast_if(names, names.count(), BROADCAST_DIGESTS), "name", "left_semi")
    files = files.select("content")

    def rows(data: bytes):
        for r in read_archive(data):
            head, _, payload = r.block.partition(b"\r\n\r\n")
            size = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", head)
            digest = r.headers.get("warc-payload-digest", "").removeprefix("sha256:")
            kind = r.headers["warc-type"]
            if size is None:
                raise WarcError("the HTTP headers have no length")
            if kind == "response" and (len(payload) != int(size[1]) or hashlib.sha256(payload).hexdigest() != digest):
                raise WarcError("the payload is not what its headers state")
            own, other = (_id(r.headers.get(k)) for k in ("warc-record-id", "warc-refers-to"))
            yield (kind, own, r.headers.get("warc-target-uri"), int(size[1]), digest, other, payload if kind == "response" else None)

    def run(batches):
        names = [c.split()[0] for c in schema.split(", ")]
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        for b in batches:
            for data in b.column("content"):
                held, size = [], 0
                for row in rows(data.as_py()):
                    held.append(row)
                    size += row[3]
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    return files.mapInArrow(tidy(run), schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages to a new folder beside the other work and read the archives back. An empty table
    writes no archive and gives an empty table."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    written = write_archives(pages, folder)
    if written.isEmpty():
        return read_archives_schema(spark)
    return read_archives(spark, folder, written)


def read_archives_schema(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "record_type string, page_id string, url string, payload_bytes long, payload_digest string, refers_to string, payload binary")
