"""WARC archives compressed with a Zstandard dictionary.

One archive per task. Its first records (at most ``SAMPLE_BYTES`` of them) train the dictionary,
which is embedded in a leading skippable frame; then every record becomes a frame of its own that
the dictionary decodes, so any record can be read alone. Where there are too few records to train
from, their own bytes are the dictionary.

Records are HTTP responses with the page's HTML as payload. Of records with equal payloads of at
least ``least`` bytes, that with the largest id is the response; the others revisit it and repeat
only its headers. Equal means equal SHA-1 and length. The reader opens the archives that the
write committed, checks each payload against its digest, and returns a row per record.

Null HTML is an empty payload. A null url is written as a URN of the record; line breaks and other
controls in a url are percent-encoded. A null id is written as such, comes back as null, and
never names a response unless the group has no other id. A repeated row gives a repeated record.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import re
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import read
from tapeloom.plans.stage import written
from tapeloom.session import fresh_folder
from tapeloom.sources.files import open_path

#: Fixed values of the formats: the dictionary frame's magic number and the revisit profile.
DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 4 << 20, 64 << 10, 3
READ_BYTES = 1 << 20
WRITTEN_DDL = "path string, records bigint, bytes bigint"
ROWS_DDL = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(page_id: int | None, digest: str) -> str:
    """The same for the same page and payload, so that a revisit can name it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {digest}')}>"


def record(page_id, url, html: bytes, sha1: bytes, size: int, response_id, revisit: bool) -> bytes:
    digest, own = base32(sha1), record_id(page_id, base32(sha1))
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url is not None else own[1:-1]
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", own),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("X-Page-ID", "" if page_id is None else page_id),
        ("X-Payload-Length", size),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(response_id, digest)), ("X-Refers-To-Page", response_id)]
    block = HTTP if revisit else HTTP + html
    fields.append(("Content-Length", len(block)))
    head = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    return b"WARC/1.1\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records)
    except zstandard.ZstdError:
        own = b"".join(r[:4096] for r in records)[-DICTIONARY_BYTES:]
        return zstandard.ZstdCompressionDict(own.ljust(8, b"\n"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class _Archive:
    """An archive under a temporary name until it is complete."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        self.files, self.inner = open_path(self.path)
        self.files.create_dir(os.path.dirname(self.inner), recursive=True)
        self.out = self.files.open_output_stream(f"{self.inner}.tmp", compression=None)
        self.waiting, self.held, self.press, self.records, self.size = [], 0, None, 0, 0

    def _put(self, data: bytes):
        self.out.write(data)
        self.size += len(data)

    def add(self, data: bytes):
        self.records += 1
        if self.press:
            self._put(self.press.compress(data))
            return
        self.waiting.append(data)
        self.held += len(data)
        if self.held >= SAMPLE_BYTES:
            self._begin()

    def _begin(self):
        words = dictionary(self.waiting)
        body = words.as_bytes()
        self._put(DICTIONARY_MAGIC.to_bytes(4, "little") + len(body).to_bytes(4, "little") + body)
        self.press = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=True, write_checksum=True)
        for data in self.waiting:
            self._put(self.press.compress(data))
        self.waiting = []

    def finish(self) -> tuple[str, int, int]:
        if not self.press:
            self._begin()
        self.out.close()
        self.files.move(f"{self.inner}.tmp", self.inner)
        return self.path, self.records, self.size


def _writer(folder: str):
    def write(batches):
        archive = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                archive = archive or _Archive(folder)
                page_id, url, html, sha1, size, response_id, revisit = row
                archive.add(record(page_id, url, (html or "").encode(), bytes.fromhex(sha1), size, response_id, revisit))
        if archive:
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "records", "bytes"), archive.finish()))])

    return write


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write ``pages(page_id, url, html)`` below ``folder``; the committed list of archives."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        "url",
        "html",
        F.sha1(html.cast("binary")).alias("sha1"),
        F.octet_length(html).cast("bigint").alias("size"),
    )
    kinds = written(rows.groupBy("sha1", "size").agg(F.max("page_id").alias("response_id")), "payloads")
    typed = rows.join(kinds, ["sha1", "size"])
    revisit = (F.col("size") >= least) & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    # a revisit has no payload of its own
    cut = typed.withColumn("revisit", revisit).withColumn("html", F.when(~F.col("revisit"), F.col("html")))
    order = cut.select("page_id", "url", "html", "sha1", "size", "response_id", "revisit")
    return written(order.mapInArrow(_writer(folder), WRITTEN_DDL), "archives")


def records(path: str):
    """``(headers, block)`` of each record of an archive."""
    files, inner = open_path(path)
    with files.open_input_stream(inner, compression=None) as stream:
        head = stream.read(8)
        if int.from_bytes(head[:4], "little") != DICTIONARY_MAGIC:
            raise ValueError(f"{path}: no dictionary frame")
        words = zstandard.ZstdCompressionDict(stream.read(int.from_bytes(head[4:], "little")))
        press, rest, out = zstandard.ZstdDecompressor(dict_data=words), b"", None
        while True:
            data = rest or stream.read(READ_BYTES)
            if not data:
                break
            if out is None:
                frame, out = press.decompressobj(), io.BytesIO()
            out.write(frame.decompress(data))
            rest = b""
            if frame.eof:
                rest = frame.unused_data
                yield parse(out.getvalue())
                out = None
        if out is not None:
            raise ValueError(f"{path}: cut off")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    size = int(headers["Content-Length"])
    if version != "WARC/1.1" or body[size:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return headers, body[:size]


def _row(headers: dict[str, str], block: bytes) -> dict:
    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = block.partition(b"\r\n\r\n")[2]
    if kind == "response" and base32(hashlib.sha1(payload).digest()) != digest:
        raise ValueError(f"{headers['WARC-Record-ID']}: the payload is damaged")
    number = headers["X-Page-ID"]
    target = headers["WARC-Target-URI"]
    return {
        "page_id": int(number) if number else None,
        "url": None if target.startswith("urn:uuid:") else target,
        "payload_bytes": int(headers["X-Payload-Length"]),
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": int(headers["X-Refers-To-Page"]) if kind == "revisit" else None,
    }


def _read(batches):
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    )
    for batch in batches:
        for path in batch.column(0).to_pylist():
            rows = []
            for headers, block in records(path):
                rows.append(_row(headers, block))
                if len(rows) == 4096:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read_archives(archives: DataFrame) -> DataFrame:
    """A row per record of the listed archives; each archive is read by one task."""
    return archives.select("path").repartition(max(1, archives.count())).mapInArrow(_read, ROWS_DDL)


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = read(spark, folder, "pages", "page_id", "url", "html")
    archives = write_archives(pages, fresh_folder(spark, "warc"))
    return read_archives(archives).drop("url")


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS response FROM pages
), d AS (
  SELECT *, list_transform(range(0, 40, 5), lambda i: CAST('0x' || sha1(html)[i + 1 : i + 5] AS BIGINT)) AS parts FROM p
)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(parts, lambda n:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(n >> 15) + 1] || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((n >> 10) & 31) + 1] ||
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((n >> 5) & 31) + 1] || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(n & 31) + 1]), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to
FROM d
"""
