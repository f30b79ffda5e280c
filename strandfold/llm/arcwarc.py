"""Legacy ARC archives, version 1 and 2, converted to WARC 1.1.

An ARC record is a header line whose fields depend on the archive's version, and as many bytes as its last field
declares. The converter synthesises what WARC asks for and ARC lacks: record identifiers (a UUID of archive, place, URL
and date, so a repeated task makes the same ones), ISO timestamps, record types and SHA-1 digests. Records whose payload
occurs again become revisits of one of them; only digests and identifiers are shuffled for that, never payloads.

An archive is one row (``archive``, ``content``) of a binary column, plain or gzipped record by record, because
executors can write any store only through Spark. Archives hold about ``ARCHIVE_BYTES`` each.

Defined cases: null html is an empty payload; a null URL is written as ``urn:unknown``, spaces in URLs are kept (fields
are taken from the right); dates that are not 14 digits are cut or filled, others become the epoch; a record that its
archive ends within is kept and marked ``WARC-Truncated``; bytes that are no ARC record are kept as a ``metadata``
record; an empty table gives no archives. Equal payloads of one page id are told apart by archive and place.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise

ARCHIVE_BYTES = 4 << 20
#: Revisits (some 150 bytes each) that are broadcast at most.
BROADCAST_REVISITS = 200_000
EPOCH = "19700101000000"
#: Header fields after the URL in the two versions of the format.
FIELDS = {1: ("ip", "date", "type", "length"), 2: ("ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length")}
DEFINITION = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_END = re.compile(rb"\r?\n\r?\n")
ARCHIVES = T.StructType([T.StructField("archive", T.StringType()), T.StructField("content", T.BinaryType())])


@dataclass
class Record:
    """One ARC record; ``offset`` is its place in the archive's file."""

    offset: int
    url: str
    fields: dict[str, str]
    block: bytes
    truncated: bool = False
    broken: bool = False

    @property
    def version_block(self) -> bool:
        """The first record of a file; a later one whose URL looks alike is a document."""
        return self.offset == 0 and not self.broken and self.url.startswith("filedesc://")

    def http(self) -> tuple[bytes, bytes] | None:
        """HTTP head and payload, if the block is an HTTP message."""
        if not self.block.startswith(b"HTTP/"):
            return None
        end = HTTP_END.search(self.block)
        return (self.block[: end.end()], self.block[end.end() :]) if end else (self.block, b"")

    def payload(self) -> bytes:
        found = self.http()
        return found[1] if found else self.block


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def gzip_member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def members(content: bytes) -> Iterator[tuple[int, bytes]]:
    """The gzip members of a file with their places, or the whole plain file; what cannot be unpacked comes as it is."""
    if content[:2] != b"\x1f\x8b":
        yield 0, content
        return
    at, view = 0, memoryview(content)
    while at < len(content):
        unpacker, parts, i = zlib.decompressobj(31), [], at
        try:
            while i < len(content) and not unpacker.eof:
                parts.append(unpacker.decompress(view[i : i + (1 << 16)]))
                i = min(len(content), i + (1 << 16))
        except zlib.error:
            yield at, bytes(view[at:])
            return
        # Of a member that breaks off, what could be unpacked is a record cut short; nothing at all is kept as it is.
        yield at, b"".join(parts) or bytes(view[at:])
        at = i - len(unpacker.unused_data)


# ARC


def arc_record(version: int, url: str, ip: str, date: str, kind: str, block: bytes, filename: str = "-") -> bytes:
    """One record; a version 2 header also has a result code, checksum, location, offset and file name."""
    head = f"{url} {ip} {date} {kind} " + (f"{len(block)}" if version == 1 else f"200 - - 0 {filename} {len(block)}")
    return head.encode() + b"\n" + block + b"\n"


def arc_header(version: int, name: str, date: str = EPOCH) -> bytes:
    block = f"{version} 0 strandfold\n{DEFINITION[version]}\n".encode()
    return arc_record(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", block, name)


def read_arc(content: bytes) -> Iterator[Record]:
    """The records of an archive; the version block decides how many fields the headers have."""
    version = 1
    for offset, data in members(content):
        at = 0
        while at < len(data):
            if data[at : at + 1] in (b"\n", b"\r"):
                at += 1
                continue
            end = data.find(b"\n", at)
            line = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r")
            if offset + at == 0 and line.startswith("filedesc://"):
                version = 2 if data[end + 1 : end + 2] == b"2" else 1
            names = FIELDS[version]
            values = line.rsplit(" ", len(names))
            if end < 0 or len(values) <= len(names) or not values[-1].isdigit():
                yield Record(offset + at, "", {}, data[at:], broken=True)
                break
            length = int(values[-1])
            block = data[end + 1 : end + 1 + length]
            yield Record(offset + at, values[0], dict(zip(names, values[1:], strict=True)), block, truncated=len(block) < length)
            at = end + 1 + length


# WARC


def warc_date(digits: str) -> str:
    digits = (digits + EPOCH[len(digits) :])[:14] if digits.isdigit() and len(digits) >= 4 else EPOCH
    try:
        return datetime.datetime.strptime(digits, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def record_id(archive: str, record: Record) -> str:
    name = f"{archive}\n{record.offset}\n{record.url}\n{record.fields.get('date', '')}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def warc_record(archive: str, record: Record, original: tuple[str, str, str] | None = None) -> bytes:
    """The WARC record for an ARC record; with ``original`` (identifier, URL, date) a revisit without the payload."""
    head, found = [("WARC-Record-ID", record_id(archive, record)), ("WARC-Date", warc_date(record.fields.get("date", "")))], record.http()
    block, kind = record.block, record.fields.get("type", "application/octet-stream")
    if record.broken:
        type_, kind = "metadata", "application/octet-stream"
    elif record.version_block:
        type_, kind = "warcinfo", "application/warc-fields"
        head.append(("WARC-Filename", archive))
        block = b"software: strandfold\r\nformat: WARC File Format 1.1\r\nconverted-from: " + record.url.encode() + b"\r\n"
    else:
        type_, kind = ("response", "application/http; msgtype=response") if found else ("resource", kind)
        head += [("WARC-Target-URI", record.url), ("WARC-Payload-Digest", f"sha1:{digest(record.payload())}")]
        if record.fields.get("ip", "0.0.0.0") != "0.0.0.0":
            head.append(("WARC-IP-Address", record.fields["ip"]))
        if original:
            type_, block = "revisit", found[0] if found else b""
            head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", original[0]), ("WARC-Refers-To-Target-URI", original[1]), ("WARC-Refers-To-Date", original[2])]
    if record.truncated:
        head.append(("WARC-Truncated", "length"))
    head = [("WARC-Type", type_), *head, ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", kind), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def read_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record."""
    for _, data in members(content):
        at = 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            head = dict(line.split(": ", 1) for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:])
            length = int(head["Content-Length"])
            yield head, data[end + 4 : end + 4 + length]
            at = end + 8 + length


# Spark


def pack(records: Iterator, prefix: str, header) -> Iterator[tuple[str, bytes]]:
    """Archives of about ARCHIVE_BYTES from records; ``header(name, n)`` gives an archive's first record, and a
    record may be a function of the same that gives its bytes."""
    parts, size, n = [], 0, 0
    for data in records:
        if not parts:
            name = f"{prefix}-{n:06d}"
            parts, size = [gzip_member(header(name, n))], 0
        parts.append(gzip_member(data(name, n) if callable(data) else data))
        size += len(parts[-1])
        if size >= ARCHIVE_BYTES:
            yield name, b"".join(parts)
            parts, n = [], n + 1
    if parts:
        yield name, b"".join(parts)


def pages_to_arc(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html", date: str = EPOCH) -> DataFrame:
    """ARC archives, version 1 and 2 in turn, with one HTTP response per page; the page's id is an HTTP header."""
    source = pages.select(F.col(page).cast("string").alias("page"), F.coalesce(url, F.lit("urn:unknown")).alias("url"), F.coalesce(html, F.lit("")).alias("html"))

    def run(batches):
        def records():
            for batch in batches:
                for page, url, html in zip(*(batch.column(i) for i in range(3)), strict=True):
                    body, where = html.as_py().encode(), re.sub(r"[\r\n]", "%0A", url.as_py())
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {page.as_py() or ''}\r\nContent-Length: {len(body)}\r\n\r\n"
                    yield lambda name, n, where=where, block=head.encode() + body: arc_record(1 + n % 2, where, "0.0.0.0", date, "text/html", block, name)

        for name, content in pack(records(), f"part-{TaskContext.get().partitionId():06d}", lambda name, n: arc_header(1 + n % 2, name, date)):
            yield pa.RecordBatch.from_arrays([pa.array([name + ".arc.gz"]), pa.array([content], pa.binary())], names=ARCHIVES.names)

    return source.mapInArrow(run, ARCHIVES)


INDEX = T.StructType([
    T.StructField("archive", T.StringType()), T.StructField("place", T.LongType()), T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("date", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("payload_sha256", T.BinaryType()), T.StructField("payload_bytes", T.LongType()),
])


def _page_id(head: bytes) -> int | None:
    found = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", head)
    return int(found[1]) if found else None


def index_arc(archives: DataFrame) -> DataFrame:
    """One row per document record of the archives, without its payload."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("archive").to_pylist(), batch.column("content"), strict=True):
                rows = []
                for r in read_arc(content.as_py()):
                    if not r.broken and not r.version_block:
                        payload, found = r.payload(), r.http()
                        rows.append((name, r.offset, _page_id(found[0]) if found else None, r.url, warc_date(r.fields["date"]), record_id(name, r), hashlib.sha256(payload).digest(), len(payload)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 8, _arrow(INDEX), strict=True)], schema=_arrow(INDEX))

    return archives.select("archive", "content").mapInArrow(run, INDEX)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def revisits(index: DataFrame, least: int = 0) -> DataFrame:
    """``archive`` and its ``revisits`` (place and original) for records whose payload of at least ``least`` bytes is another's.

    The record with the largest page id is the original; the others of a digest, however many, are joined to that one row.
    """
    order = F.struct("page_id", "archive", "place", "record_id", "url", "date")
    groups = index.filter(F.col("payload_bytes") >= least).groupBy("payload_sha256", "payload_bytes").agg(F.max(order).alias("original"), F.count(F.lit(1)).alias("n"))
    joined = index.join(groups.filter("n > 1"), ["payload_sha256", "payload_bytes"]).filter(F.col("record_id") != F.col("original.record_id"))
    one = F.struct("place", F.col("original.record_id").alias("id"), F.col("original.url").alias("url"), F.col("original.date").alias("date"))
    return joined.groupBy("archive").agg(F.collect_list(one).alias("revisits"))


def convert_arc(archives: DataFrame, least: int = 0) -> DataFrame:
    """WARC archives for ARC archives (a stored table, for it is read twice)."""
    index = materialise(index_arc(archives), "arc_index")
    known = materialise(revisits(index, least), "revisits")
    # Few revisits go to the archives, so that payloads need not move; with many, both sides are shuffled by archive.
    few = (known.agg(F.sum(F.size("revisits"))).head()[0] or 0) <= BROADCAST_REVISITS
    planned = archives.select("archive", "content").join(F.broadcast(known) if few else known, "archive", "left")

    def run(batches):
        for batch in batches:
            for name, content, known in zip(batch.column("archive").to_pylist(), batch.column("content"), batch.column("revisits").to_pylist(), strict=True):
                originals = {r["place"]: (r["id"], r["url"], r["date"]) for r in known or ()}
                warc = b"".join(gzip_member(warc_record(name, r, originals.get(r.offset))) for r in read_arc(content.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([re.sub(r"\.arc(\.gz)?$", "", name) + ".warc.gz"]), pa.array([warc], pa.binary())], names=ARCHIVES.names)

    return planned.mapInArrow(run, ARCHIVES)


RECORDS = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("page_id", T.LongType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("refers_to_id", T.StringType()),
])


def read_warc_records(archives: DataFrame) -> DataFrame:
    """The response and revisit records of WARC archives; a revisit has no payload of its own (``payload_bytes`` null)."""

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for head, block in read_warc(content.as_py()):
                    if head["WARC-Type"] in ("response", "revisit"):
                        end = HTTP_END.search(block)
                        stated, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), None
                        if head["WARC-Type"] == "response":
                            payload = block[end.end() :]
                            size = len(payload)
                            if digest(payload) != stated:
                                raise ValueError(f"{head['WARC-Record-ID']}: the payload is not the one of its digest")
                        rows.append((head["WARC-Record-ID"], head["WARC-Type"], _page_id(block[: end.end()]), stated, size, head.get("WARC-Refers-To")))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 6, _arrow(RECORDS), strict=True)], schema=_arrow(RECORDS))

    return archives.select("content").mapInArrow(run, RECORDS)
