"""WARC archives in Zstandard with a dictionary: writer and reader.

An archive starts with a skippable frame that holds the dictionary (as it is or itself
compressed); then each record is a frame of its own.  The writer trains the dictionary on
the first records of each archive, up to ``SAMPLE_BYTES`` of them; too few or too
uniform records give an archive without one.

Archives are rows of ``path`` and ``content``, as ``spark.read.format("binaryFile")`` gives
them for files: Spark reads and writes them in any store, and each is small enough to
be decoded in memory.  Within an archive one record at a time is decompressed.

Of records with equal payloads, that of the smallest page_id is a ``response``; the others
are ``revisit`` records without the payload that name it.  Null html is an empty payload.
Rows that repeat a page_id with an equal payload have the same type; a null page_id
comes last.  Control characters and blanks in a url are percent-encoded in the header,
and a null url is left out.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatledger.llm.common import Scratch

#: Magic numbers and texts of the formats; fixed values.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES = 32 << 10
SAMPLE_BYTES = 1 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
#: Smallest payload that is written only once.
LEAST_BYTES = 0
READ_STEP = 1 << 16


class WarcError(ValueError):
    """An archive or record that does not follow the format."""


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _header_safe(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    digest = payload_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{payload_digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_safe(url)}")
    if refers_to is not None:
        lines += [
            f"WARC-Profile: {REVISIT_PROFILE}",
            f"WARC-Refers-To: {record_id(refers_to, digest)}",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class ArchiveWriter:
    """Collects records and gives archives of about ``limit`` compressed bytes."""

    def __init__(self, limit: int = ARCHIVE_BYTES):
        self.limit = limit
        self._begin()

    def _begin(self) -> None:
        self.waiting: list[bytes] = []
        self.waiting_bytes, self.size = 0, 0
        self.parts: list[bytes] = []
        self.compressor: zstd.ZstdCompressor | None = None

    def _train(self) -> None:
        dictionary = None
        try:
            dictionary = zstd.train_dictionary(DICTIONARY_BYTES, self.waiting, k=1024, d=8)
        except (zstd.ZstdError, ValueError):
            pass
        if dictionary is not None:
            packed = zstd.ZstdCompressor(level=19).compress(dictionary.as_bytes())
            self._add(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
        self.compressor = zstd.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
        waiting, self.waiting = self.waiting, []
        for record in waiting:
            self._add(self.compressor.compress(record))

    def _add(self, part: bytes) -> None:
        self.parts.append(part)
        self.size += len(part)

    def write(self, record: bytes) -> bytes | None:
        """Takes a record; an archive that it fills is returned."""
        if self.compressor is None:
            self.waiting.append(record)
            self.waiting_bytes += len(record)
            if self.waiting_bytes < SAMPLE_BYTES:
                return None
            self._train()
        else:
            self._add(self.compressor.compress(record))
        return self.close() if self.size >= self.limit else None

    def close(self) -> bytes | None:
        if self.waiting:
            self._train()
        content = b"".join(self.parts)
        self._begin()
        return content or None


def frames(content: bytes) -> Iterator[tuple[int, bytes]]:
    """``(offset, bytes)`` of every frame, decompressed; skippable frames are passed over."""
    view, at, decompressor = memoryview(content), 0, zstd.ZstdDecompressor()
    while at < len(view):
        if len(view) - at < 8:
            raise WarcError(f"cut off at byte {at}")
        magic, size = struct.unpack_from("<II", view, at)
        if magic in SKIPPABLE:
            body = bytes(view[at + 8 : at + 8 + size])
            if len(body) < size:
                raise WarcError(f"skippable frame at byte {at} is cut off")
            if magic == DICTIONARY_MAGIC and at == 0:
                if body[:4] == struct.pack("<I", FRAME_MAGIC):
                    body = zstd.ZstdDecompressor().decompress(body, max_output_size=1 << 27)
                decompressor = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(body))
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise WarcError(f"no Zstandard frame at byte {at}")
        frame, start, out = decompressor.decompressobj(), at, []
        try:
            while not frame.eof:
                if at >= len(view):
                    raise WarcError(f"frame at byte {start} is cut off")
                part = view[at : at + READ_STEP]
                out.append(frame.decompress(part))
                at += len(part) - len(frame.unused_data)
        except zstd.ZstdError as e:
            raise WarcError(f"frame at byte {start}: {e}") from e
        yield start, b"".join(out)


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]

    def http_length(self) -> int:
        for line in self.block.partition(b"\r\n\r\n")[0].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length":
                return int(value)
        raise WarcError("the HTTP header has no Content-Length")


def parse_record(data: bytes) -> Record:
    """One whole record: version, headers, and a block of just the stated length."""
    head, end, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not end or lines[0] not in VERSIONS:
        raise WarcError("no WARC version line and header")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise WarcError(f"bad header line {line[:80]!r}")
        headers[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"no {name}")
    if not headers["content-length"].isdigit():
        raise WarcError("bad content-length")
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise WarcError(f"the block has not {size} bytes")
    record = Record(headers, rest[:size])
    stated = headers.get("warc-block-digest", "")
    if stated.startswith("sha1:") and stated[5:] != payload_digest(record.block):
        raise WarcError("the block does not fit its digest")
    return record


def write_archives(pages: DataFrame, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """``path, content`` of archives with a record for each row of ``pages(page_id, url, html)``."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumn("key_", F.sha2("payload", 256))
    large = rows.where(F.octet_length("payload") >= LEAST_BYTES)
    groups = large.groupBy("key_").agg(F.min("page_id").alias("first_"), F.count("*").alias("n_"))
    scratch = Scratch(pages.sparkSession, "warc")
    groups = scratch.write(groups.where("n_ > 1").drop("n_"), "repeated")
    typed = rows.join(groups, "key_", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_")), F.col("first_"))
    # Of a revisited payload only length and digest are written.
    typed = typed.select("page_id", "url", "payload", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, part, number = ArchiveWriter(limit), TaskContext.get().partitionId(), 0

        def archive(content: bytes) -> pa.RecordBatch:
            name = f"pages-{part:06d}-{number:05d}.warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], names=["path", "content"])

        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(4))):
                content = writer.write(make_record(*(v.as_py() for v in row)))
                if content:
                    yield archive(content)
                    number += 1
        content = writer.close()
        if content:
            yield archive(content)

    return typed.mapInArrow(run, "path string, content binary")


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, path string, offset long, error string"


def read_archives(archives: DataFrame, strict: bool = True, payloads: bool = True) -> DataFrame:
    """A row for each record of ``archives(path, content)``.

    ``strict`` fails on what does not follow the format; otherwise that gives a row with
    ``error``, and the records before it count.  Without ``payloads`` that column is null.
    """
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.string()]
    names = [c.split()[0] for c in RECORD.split(", ")]

    def number(value: str | None) -> int | None:
        return int(value) if value is not None else None

    def records(path: str, content: bytes) -> Iterator[tuple]:
        at = 0
        try:
            for at, data in frames(content):
                record = parse_record(data)
                h, kind = record.headers, record.headers["warc-type"]
                size, digest = record.http_length(), h.get("warc-payload-digest", "").removeprefix("sha1:")
                if kind == "response" and (size != len(record.payload) or digest != payload_digest(record.payload)):
                    raise WarcError("the payload does not fit its length or digest")
                yield (
                    number(h.get("x-page-id")), h.get("warc-target-uri"), size, digest, kind,
                    number(h.get("x-refers-to-page-id")), record.payload if payloads and kind == "response" else None,
                    path, at, None,
                )
        except WarcError as e:
            if strict:
                raise WarcError(f"{path}, frame at byte {at}: {e}") from e
            yield (None,) * 7 + (path, at, str(e))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows, size = [], 0
                for row in records(path.as_py(), content.as_py()):
                    rows.append(row)
                    size += 200 + len(row[6] or b"")
                    if size > 8 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return archives.select("path", "content").mapInArrow(run, RECORD)


ORACLE = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) || '00' AS hex FROM pages
)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
    ((('0x' || substr(hex, 1 + (5 * i) // 4, 3))::INTEGER >> (7 - (5 * i) % 4)) & 31)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = min(page_id) OVER same THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> min(page_id) OVER same THEN min(page_id) OVER same END AS refers_to
FROM p WINDOW same AS (PARTITION BY payload)
"""
