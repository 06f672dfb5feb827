"""WARC archives: a writer with revisit records, and a reader that splits files at any byte.

Each record is a gzip member of its own. Reading tasks take byte ranges: a task looks for the gzip magic in its range,
decodes what follows to see whether a WARC header begins there, and owns the records that start inside its range, reading
past the end of it for the last one. Bytes that look like a member by chance fail to decode and are passed over.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from uuid import UUID

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from valograph.llm.shared import batch_of, shared_folder, written
from valograph.llm.storage import attempt_name, create, open_store

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
SPLIT = 4_000_000  # bytes of an archive that a reading task takes
STEP = 1 << 18
LEAST = 0  # payloads of fewer bytes are always written whole
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FILES = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
_RECORDS = pa.schema([("record_type", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def record_id(page_id: int | None, digest: str) -> str:
    """A name that depends on the page alone, so that a repeated attempt writes the same record."""
    return f"<urn:uuid:{UUID(bytes=hashlib.md5(f'{page_id} {digest}'.encode()).digest())}>"


def record(kind: str, url: str | None, page_id: int | None, refers_to: int | None, digest: str, payload: bytes) -> bytes:
    """One gzip member. Pages are told apart by ``X-Page-Id``; a revisit has no block and tells the payload's length."""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c.isprintable() else " " for c in url)))
    if page_id is not None:
        fields.append(("X-Page-Id", page_id))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page", refers_to)]
    fields += [("X-Payload-Length", len(payload)), ("Content-Length", 0 if kind == "revisit" else len(payload))]
    head = VERSION + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + (b"" if kind == "revisit" else payload) + b"\r\n\r\n") + packer.flush()


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, out, records, size = f"{folder}/part-{attempt_name()}.warc.gz", None, 0, 0
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to", "whole"))
            for page_id, url, html, digest, refers_to, whole in zip(*columns, strict=True):
                out = out or create(uri)
                payload = (html or "").encode("utf-8", "surrogatepass")
                member = record("response" if whole else "revisit", url, page_id, refers_to, base64.b32encode(bytes.fromhex(digest)).decode(), payload)
                size += out.write(member)
                records += 1
        if out:
            out.close()
            yield batch_of(_FILES, file=[uri], records=[records], bytes=[size])

    return run


def write_warc(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST, folder: str | None = None) -> DataFrame:
    """Write a record per row and return the manifest ``file, records, bytes``, a row per archive.

    Of rows with equal payloads of at least ``least`` bytes the one with the smallest id is a response; the others revisit
    it. A null payload is empty. A row without an id is a response if no row with an id has its payload, and so are rows
    that repeat the smallest id. Archives of lost task attempts are not in the manifest.
    """
    folder = folder or shared_folder(pages.sparkSession, "warc")
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode(F.coalesce("html", F.lit("")), "utf-8")))
    first = written(rows.groupBy(F.col("digest").alias("_digest")).agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_n")).where("_n > 1"), "payloads")
    joined = rows.join(first, F.col("digest") == F.col("_digest"), "left")
    small = F.octet_length(F.coalesce("html", F.lit(""))) < least
    whole = small | F.col("refers_to").isNull() | F.coalesce(F.col("page_id") == F.col("refers_to"), F.lit(False))
    ready = joined.withColumn("whole", whole).withColumn("refers_to", F.when(~whole, F.col("refers_to")))
    return written(ready.select("page_id", "url", "html", "digest", "refers_to", "whole").mapInArrow(_write(folder), from_arrow_schema(_FILES)), "archives")


class Window:
    """A file read in steps, which can be looked at from any offset on."""

    def __init__(self, file):
        self.file, self.size, self.start, self.data = file, file.size(), 0, b""

    def at(self, offset: int, length: int = STEP) -> bytes:
        """Bytes from ``offset``: ``length`` of them unless the file ends."""
        length = min(length, self.size - offset)
        if offset < self.start or offset + length > self.start + len(self.data):
            self.start, self.data = offset, self.file.read_at(max(length, min(STEP * 4, self.size - offset)), offset)
        return self.data[offset - self.start : offset - self.start + length]


def member(window: Window, offset: int) -> tuple[bytes, int] | None:
    """Content and length of the gzip member at ``offset``, or None if none with a WARC header begins there."""
    unpacker, out, at = zlib.decompressobj(31), [], offset
    try:
        head = unpacker.decompress(window.at(offset, 512), len(VERSION))
        if not VERSION.startswith(head) and not head.startswith(VERSION):
            return None
        out.append(head)
        at = offset + len(window.at(offset, 512)) - len(unpacker.unconsumed_tail)
        while not unpacker.eof:
            data = window.at(at)
            if not data:
                return None  # cut short
            out.append(unpacker.decompress(data))
            at += len(data)
        content = b"".join(out)
        return (content, at - len(unpacker.unused_data) - offset) if content.startswith(VERSION) else None
    except zlib.error:
        return None


def members(file, low: int, high: int) -> Iterator[bytes]:
    """Contents of the members that start in [low, high)."""
    window, at = Window(file), low
    while at < high:
        data = window.at(at, min(STEP, high - at + len(MAGIC) - 1))
        found = data.find(MAGIC)
        if found < 0:
            at += max(1, len(data) - len(MAGIC) + 1)
            continue
        at += found
        if at >= high:
            return
        got = member(window, at)
        if got is None:
            at += 1
        else:
            yield got[0]
            at += got[1]


def parsed(content: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = content.partition(b"\r\n\r\n")
    lines = (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    fields = {k.strip().lower(): v.strip() for k, _, v in lines}
    return fields, rest[: int(fields.get("content-length", 0))]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = lambda x: None if x is None else int(x)
    for batch in batches:
        for uri, low, high in zip(*(batch.column(c).to_pylist() for c in ("file", "low", "high")), strict=True):
            store, path = open_store(uri)
            rows, held = [], 0
            with store.open_input_file(path) as file:
                for content in members(file, low, high):
                    f, payload = parsed(content)
                    length = number(f.get("x-payload-length", len(payload)))
                    rows.append((f.get("warc-type"), f.get("warc-target-uri"), number(f.get("x-page-id")), number(f.get("x-refers-to-page")), f.get("warc-payload-digest", "").removeprefix("sha1:"), length, payload))
                    held += len(payload)
                    if held > 8_000_000:
                        yield batch_of(_RECORDS, **dict(zip(_RECORDS.names, zip(*rows, strict=True), strict=True)))
                        rows, held = [], 0
            if rows:
                yield batch_of(_RECORDS, **dict(zip(_RECORDS.names, zip(*rows, strict=True), strict=True)))


def read_warc(archives: DataFrame, split: int = SPLIT) -> DataFrame:
    """Records of the archives named by ``file`` and ``bytes``: type, target, page, the page a revisit refers to, digest
    and length of the full payload, and the payload itself (empty for revisits)."""
    low = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("bytes") - 1, F.lit(0).cast("bigint")), F.lit(split).cast("bigint")))
    splits = archives.withColumn("low", low).select("file", "low", F.least(F.col("low") + split, F.col("bytes")).alias("high"))
    return splits.repartition("file", "low").mapInArrow(_read, from_arrow_schema(_RECORDS))
