"""Converter from the legacy ARC web archive format to WARC 1.1, with revisit records for repeated payloads.

ARC: a file starts with a version block (``filedesc://`` record whose body names the version and the header fields).
Version 1 header lines have five fields (URL, IP, date, type, length), version 2 ten (URL, IP, date, type, result code,
checksum, location, offset, file name, length). The declared length alone tells where a record ends; blank lines may
follow it. Each record becomes a WARC record of equal content: ``filedesc`` becomes warcinfo, http(s) with an HTTP
status line a response, anything else a resource. Identifiers are name-based UUIDs of URL, date, and place in the
source, the 14-digit date becomes ISO 8601, and block and payload digests are SHA-1 in base 32.

A WARC file is a row of gzip members, one per record. A task writes under a name of its own and renames at the end.

Which records repeat a payload is settled before writing, by one partial aggregate on the digest: of equal payloads of
at least ``least`` bytes, the one with the largest key keeps its payload and the others refer to it. That table of repeats
is written first and goes to all tasks if it is small (``REPEATS`` rows), so that pages are not shuffled; beyond that it
is joined. Pages reach the converter as ARC bytes in memory, some megabytes at a time, never as ARC files.

Defined results: a null html is an empty payload; null keys come back as null and never lead a group unless all its keys
are null (then all keep their payloads); repeated rows of the leading key all keep theirs; a null url is an empty one,
and white space in a url is percent-encoded; a very long payload is one record, whole; an empty table gives no files and
no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small, written_for_later
from .tokenfile import opened

#: The header fields of the two versions, as the version block names them.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_SPACE = re.compile(r"\s")
#: Bytes read from or gathered for a file at a time.
_STEP = 1 << 20
#: The most repeats (two keys, a digest and a url each) that are broadcast.
REPEATS = 100_000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    body: bytes
    version: int
    extra: dict[str, str] = field(default_factory=dict)


def clean_url(url: str) -> str:
    """A header field can hold no white space, and is not empty."""
    return _SPACE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) or "-"


def arc_header(url: str, length: int, version: int, date: str = "20000101000000", mime: str = "text/html", ip: str = "0.0.0.0", status: int = 200) -> bytes:
    middle = f"{status} - - 0 -" if version == 2 else ""
    return " ".join(x for x in (clean_url(url), ip, date, mime, middle, str(length)) if x).encode("utf-8", "surrogatepass") + b"\n"


def arc_start(name: str, version: int, date: str = "20000101000000") -> bytes:
    body = f"{version} 0 converter\n{FIELDS[version]}\n".encode()
    return arc_header(f"filedesc://{name}", len(body), version, date, "text/plain") + body + b"\n"


def arc_records(stream: io.BufferedIOBase) -> Iterator[ArcRecord]:
    """Records of an ARC stream. Raises ValueError on a header line that fits no version or a body that ends early."""
    version = 0
    while line := stream.readline():
        if not line.strip():
            continue
        parts = line.decode("utf-8", "surrogatepass").rstrip("\r\n").split(" ")
        if not version and not parts[0].startswith("filedesc://"):
            raise ValueError("an ARC file starts with its version block")
        count = {len(v.split()): k for k, v in FIELDS.items()}
        if len(parts) not in count or not parts[-1].isdigit():
            raise ValueError(f"not an ARC header line: {line[:200]!r}")
        body = stream.read(int(parts[-1]))
        if len(body) != int(parts[-1]):
            raise ValueError("the file ends within a record")
        if parts[0].startswith("filedesc://"):
            version = int(body.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"unknown version {version}")
        if count[len(parts)] != version:
            raise ValueError("a header line of another version")
        names = FIELDS[version].split()
        yield ArcRecord(parts[0], parts[1], parts[2], parts[3], body, version, dict(zip(names[4:-1], parts[4:-1], strict=True)))


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """Status line and headers with the blank line, and the payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    for mark in (b"\r\n\r\n", b"\n\n"):
        at = block.find(mark)
        if at >= 0:
            return block[: at + len(mark)], block[at + len(mark) :]
    return block, b""


def digest32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def iso_date(date: str) -> str:
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6] if d[4:6] != '00' else '01'}-{d[6:8] if d[6:8] != '00' else '01'}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, place: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {place}')}>"


def to_warc(record: ArcRecord, place: str, refers: tuple[str, str, str] | None = None) -> bytes:
    """A WARC record of the same content; with refers (id, url, date) a revisit that leaves the payload out."""
    head, payload = http_parts(record.body)
    http = bool(head) and record.url.startswith(("http://", "https://", "-"))
    kind = "warcinfo" if record.url.startswith("filedesc://") else "revisit" if refers and head else "response" if head else "resource"
    block = head if kind == "revisit" else record.body
    lines = [("WARC-Type", kind), ("WARC-Record-ID", record_id(record.url, record.date, place)), ("WARC-Date", iso_date(record.date))]
    if kind == "warcinfo":
        lines += [("WARC-Filename", record.url.removeprefix("filedesc://")), ("Content-Type", "text/plain")]
    else:
        lines += [("WARC-Target-URI", record.url), ("WARC-IP-Address", record.ip), ("WARC-Payload-Digest", digest32(payload)), ("Content-Type", "application/http; msgtype=response" if head or http else record.mime)]
    if kind == "revisit":
        lines += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", refers[0]), ("WARC-Refers-To-Target-URI", refers[1]), ("WARC-Refers-To-Date", iso_date(refers[2]))]
    lines += [("WARC-Block-Digest", digest32(block)), ("Content-Length", str(len(block)))]
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in lines).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(stream: io.RawIOBase) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    z, out, data = zlib.decompressobj(31), [], b""
    while True:
        data = data or stream.read(_STEP)
        if not data:
            break
        out.append(z.decompress(data))
        data = z.unused_data
        if z.eof:
            yield b"".join(out)
            z, out = zlib.decompressobj(31), []
    if out and any(out):
        raise ValueError("the file ends within a record")


def warc_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the block that the declared length gives."""
    at = data.index(b"\r\n\r\n")
    lines = data[:at].decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = data[at + 4 : at + 4 + int(headers["content-length"])]
    if digest32(block) != headers["warc-block-digest"]:
        raise ValueError("a block differs from its digest")
    return headers, block


def leaders(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 1000) -> DataFrame:
    """(key, digest, leader, leader_url) of each row whose payload another row with a larger key keeps."""
    payload = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{key}`").alias("key"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("size"), F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")).alias("url")).where(F.col("size") >= least)
    groups = rows.groupBy("digest", "size").agg(F.max("key").alias("leader"), F.max_by("url", "key").alias("leader_url"), F.count("*").alias("n")).where((F.col("n") > 1) & F.col("leader").isNotNull()).select("digest", "leader", "leader_url")
    return rows.join(groups, "digest").where(~F.col("key").eqNullSafe(F.col("leader"))).select("key", "digest", "leader", "leader_url").distinct()


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 1000, version: int = 1, date: str = "20000101000000") -> DataFrame:
    """Pages as legacy ARC records, converted to WARC files in folder; (shard, records) of each file."""
    body = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit(""))
    source = pages.select(F.col(f"`{key}`").cast("string").alias("key"), F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")).alias("url"), body.alias("html"), F.col(f"`{key}`").alias("_key"), F.sha1(body.cast("binary")).alias("digest"))
    repeats = leaders(pages, key, url, html, least).withColumnRenamed("key", "_key")
    repeats = small(written_for_later(repeats, "repeats"), REPEATS)
    source = source.join(repeats, source["_key"].eqNullSafe(repeats["_key"]) & (source["digest"] == repeats["digest"]), "left").select("key", "url", "html", F.col("leader").cast("string").alias("leader"), "leader_url")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, n, out = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs, root = opened(folder)
                fs.create_dir(root, recursive=True)
                at = f"{root}/.{shard}-{uuid.uuid4().hex}"
                out = fs.open_output_stream(at)
            for some in _legacy(batch, f"{shard}-{n}", version, date):
                stream, refers = some
                for place, record in enumerate(arc_records(stream)):
                    if record.url.startswith("filedesc://"):
                        if not n:
                            out.write(member(to_warc(record, f"info {shard}")))
                        continue
                    key_of, leader, leader_url = refers[place - 1]
                    out.write(member(to_warc(record, f"page {key_of}", (record_id(leader_url, date, f"page {leader}"), leader_url, date) if leader is not None else None)))
                    n += 1
        if out:
            out.close()
            fs.move(at, f"{root}/{shard}.warc.gz")
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([n])], ["shard", "records"])

    lean(pages.sparkSession)
    return source.mapInArrow(run, "shard long, records long")


def _legacy(batch: pa.RecordBatch, name: str, version: int, date: str) -> Iterator[tuple[io.BytesIO, list[tuple]]]:
    """ARC streams of some rows each, and each record's key and leader."""
    parts, refers, size = [arc_start(name, version, date)], [], 0
    for key, url, html, leader, leader_url in zip(*(c.to_pylist() if i != 2 else c for i, c in enumerate(batch.columns)), strict=True):
        payload = html.as_buffer().to_pybytes()
        page = "" if key is None else f"X-Page-Id: {key}\r\n"
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{page}Content-Length: {len(payload)}\r\n\r\n".encode()
        parts += [arc_header(url, len(head) + len(payload), version, date), head, payload, b"\n"]
        refers.append((key, leader, clean_url(leader_url or "")))
        size += len(payload)
        if size > 4 * _STEP:
            yield io.BytesIO(b"".join(parts)), refers
            parts, refers, size = [arc_start(name, version, date)], [], 0
    if refers:
        yield io.BytesIO(b"".join(parts)), refers


def read(pages_files: DataFrame, folder: str) -> DataFrame:
    """Records of the WARC files (shard): key, url, record_id, record_type, refers_to_id, payload_bytes, payload_digest (hex)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "url", "record_id", "record_type", "refers_to_id", "payload_bytes", "payload_digest"]
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                fs, root = opened(folder)
                rows: list[tuple] = []
                with fs.open_input_stream(f"{root}/{shard}.warc.gz", compression=None) as stream:
                    for data in members(stream):
                        headers, block = warc_record(data)
                        if headers["warc-type"] == "warcinfo":
                            continue
                        head, payload = http_parts(block)
                        said = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:] if x)}
                        if headers["warc-type"] == "response" and digest32(payload) != headers["warc-payload-digest"]:
                            raise ValueError("a payload differs from its digest")
                        rows.append((said.get("x-page-id"), headers["warc-target-uri"], headers["warc-record-id"], headers["warc-type"], headers.get("warc-refers-to"), int(said["content-length"]), base64.b32decode(headers["warc-payload-digest"][5:]).hex()))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if i == 5 else pa.string()) for i, x in enumerate(zip(*rows, strict=True))], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if i == 5 else pa.string()) for i, x in enumerate(zip(*rows, strict=True))], names)

    return pages_files.mapInArrow(run, "key string, url string, record_id string, record_type string, refers_to_id string, payload_bytes long, payload_digest string")
