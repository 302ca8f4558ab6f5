"""Legacy web archives: ARC version 1 and 2 records, their conversion to WARC, and reading WARC back.

An ARC file opens with a ``filedesc://`` record that states the version; each record is one header line,
whose fields depend on that version, and as many bytes as the line's last field declares.
  version 1: URL IP-address archive-date content-type length
  version 2: URL IP-address archive-date content-type result-code checksum location offset filename length
Conversion derives what WARC asks for: a record id (a UUID made from the source record), a W3C timestamp
from the 14-digit date, a type, and SHA-1 digests of block and payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, materialise, scratch_path, steady

FIELDS = {1: ("url", "ip", "date", "type", "length"), 2: ("url", "ip", "date", "type", "code", "checksum", "location", "offset", "file", "length")}
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Bytes of payload in one archive file; an archive is closed by the record that passes it.
ARCHIVE_BYTES = 8 << 20


class ArcRecord(NamedTuple):
    url: str
    ip: str
    date: str
    type: str
    block: bytes
    offset: int
    version: int
    code: str = "-"
    checksum: str = "-"


def arc_file_header(version: int, date: str, name: str = "pages.arc") -> bytes:
    body = f"{version} 0 tidemark\n{' '.join({'url': 'URL', 'ip': 'IP-address', 'date': 'Archive-date', 'type': 'Content-type', 'length': 'Archive-length', 'code': 'Result-code', 'checksum': 'Checksum', 'location': 'Location', 'offset': 'Offset', 'file': 'Filename'}[f] for f in FIELDS[version])}\n".encode()
    middle = "text/plain" if version == 1 else "text/plain 200 - - 0 " + name
    return f"filedesc://{name} 0.0.0.0 {date} {middle} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, ip: str, date: str, kind: str, block: bytes, offset: int = 0, name: str = "pages.arc") -> bytes:
    url = "".join(f"%{ord(c):02X}" if c in " \t\r\n" else c for c in url) or "-"
    middle = kind if version == 1 else f"{kind} 200 {hashlib.sha1(block).hexdigest()} - {offset} {name}"
    return f"{url} {ip} {date} {middle} {len(block)}\n".encode() + block + b"\n"


class Broken(NamedTuple):
    """What stands at an offset of an archive and is no record, and why."""

    offset: int
    reason: str
    data: bytes


def arc_parts(data: bytes) -> Iterator[ArcRecord | Broken]:
    """The records after the file's own; the version comes from the first line of the first record's body.

    A header line with another number of fields or without a length, or a declared length beyond the end, is
    given as ``Broken``; reading goes on at the next line that has the fields of a header, a date of 14
    digits and a length that the file can hold."""
    at, version = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        stop = data.find(b"\n", at)
        stop = len(data) if stop < 0 else stop
        line = data[at:stop].rstrip(b"\r").decode("utf-8", "surrogateescape").split(" ")
        begin = stop + 1
        if version is None:
            if not line[0].startswith("filedesc://") or not line[-1].isdigit():
                yield Broken(at, "an ARC file begins with a filedesc:// record", data[at:])
                return
            length = int(line[-1])
            stated = data[begin : begin + length].split(b" ", 1)[0]
            version = int(stated) if stated.isdigit() else 0
            if version not in FIELDS:
                yield Broken(at, f"unknown ARC version {stated.decode('utf-8', 'replace')}", data[at:])
                return
            at = begin + length
            continue
        reason = None
        if len(line) != len(FIELDS[version]):
            reason = f"{len(line)} fields in a header of ARC version {version}"
        elif not line[-1].isdigit():
            reason = "no declared length"
        elif begin + int(line[-1]) > len(data):
            reason = f"declared length {line[-1]} passes the end"
        if reason:
            to = _next_header(data, begin, version)
            yield Broken(at, reason, data[at:to])
            at = to
            continue
        x = dict(zip(FIELDS[version], line, strict=True))
        length = int(x["length"])
        yield ArcRecord(x["url"], x["ip"], x["date"], x["type"], data[begin : begin + length], at, version, x.get("code", "-"), x.get("checksum", "-"))
        at = begin + length


def _next_header(data: bytes, at: int, version: int) -> int:
    """Where the next line begins that may be a record's header."""
    while at < len(data):
        stop = data.find(b"\n", at)
        stop = len(data) if stop < 0 else stop
        line = data[at:stop].rstrip(b"\r").split(b" ")
        if len(line) == len(FIELDS[version]) and b":" in line[0] and re.fullmatch(rb"\d{14}", line[2]) and line[-1].isdigit() and stop + 1 + int(line[-1]) <= len(data):
            return at
        at = stop + 1
    return len(data)


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of ``arc_parts``; raises ValueError where something is broken."""
    for x in arc_parts(data):
        if isinstance(x, Broken):
            raise ValueError(f"{x.reason}: at byte {x.offset}")
        yield x


def warc_date(date: str) -> str:
    """14-digit (or shorter, padded with the least date) ARC date -> W3C timestamp."""
    full = date + "00000101000000"[len(date) :] if len(date) < 14 else date[:14]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join(map(str, parts)))}>"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """An HTTP message's head (blank line included) and its payload; no head if there is none."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    cut = block.find(b"\r\n\r\n")
    return (block[: cut + 4], block[cut + 4 :]) if cut >= 0 else (block, b"")


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode("utf-8", "surrogateescape") + block + b"\r\n\r\n"


def convert(arc: ArcRecord, own_id: str, refers_to: str | None = None) -> bytes:
    """The WARC record that says what an ARC record says; a revisit if it refers to another."""
    http, payload = split_http(arc.block)
    block = http if refers_to else arc.block
    kind = "revisit" if refers_to else "response" if http else "resource"
    headers = [("WARC-Type", kind), ("WARC-Record-ID", own_id), ("WARC-Date", warc_date(arc.date)), ("WARC-Target-URI", arc.url), ("WARC-IP-Address", arc.ip)]
    headers += [("Content-Type", "application/http;msgtype=response" if http else arc.type), ("WARC-Payload-Digest", sha1_label(payload)), ("WARC-Block-Digest", sha1_label(block))]
    if refers_to:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", refers_to)]
    return warc_record(headers, block)


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record; gzip members or plain."""
    f = gzip.open(io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers: dict[str, str] = {}
        while (line := f.readline()).strip():
            k, _, v = line.decode("utf-8", "surrogateescape").partition(":")
            headers[k.strip().lower()] = v.strip()
        block = f.read(size := int(headers["content-length"]))
        if len(block) != size:
            raise ValueError("a record is cut short")
        yield headers, block


def _page_id(page_id: int | None, payload: str, copy: int | None) -> str:
    """A page's record: its id and payload name it, and of equal ones all but the first also where they stood."""
    return record_id("page", page_id, payload, *([] if copy is None else [copy]))


def convert_archives(spark, folder: str, out: str) -> DataFrame:
    """Read the ARC files (``*.arc``, ``*.arc.gz``) of a folder and write a WARC archive beside each under ``out``.

    One row for each record and each broken part: archive, offset, url, record_id, warc_type, length,
    payload_digest, problem (null for a record).  Broken parts are written to ``out`` as they are, in a file
    for each archive, so nothing is lost, and the rest of their archive is converted.  A file is read whole
    by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(out)
        where.create_dir(base, recursive=True)
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw, name, rows = content.as_py(), path.rsplit("/", 1)[-1], []
                stem = f"{name.removesuffix('.gz').removesuffix('.arc')}-{hashlib.sha1(path.encode()).hexdigest()[:8]}"
                try:
                    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                    parts = arc_parts(raw)
                except (OSError, EOFError, zlib.error) as e:
                    parts = iter([Broken(0, f"not to be unpacked: {e}", raw)])
                converted, broken = [], []
                for x in parts:
                    if isinstance(x, Broken):
                        broken.append(x.data)
                        rows.append((path, x.offset, None, None, None, len(x.data), None, x.reason))
                        continue
                    own, payload = record_id(path, x.offset), split_http(x.block)[1]
                    converted.append(gzip_member(convert(x, own)))
                    rows.append((path, x.offset, x.url, own, "response" if payload is not x.block else "resource", len(x.block), hashlib.sha1(payload).hexdigest(), None))
                for data, kind in ((converted, "warc.gz"), (broken, "broken")):
                    if data:  # the name follows from the source: a task that runs twice writes the same file
                        with where.open_output_stream(f"{base}/{stem}.{kind}", compression=None) as f:
                            f.write(b"".join(data))
                cols = list(zip(*rows, strict=True)) or [[]] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _CONVERTED.types, strict=True)], schema=_CONVERTED)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{arc,arc.gz}").load(folder).select("path", "content")
    found = map_arrow(files, run, "archive string, offset long, url string, record_id string, warc_type string, length long, payload_digest string, problem string")
    return materialise(found, "arc-converted")


_CONVERTED = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("url", pa.string()), ("record_id", pa.string()), ("warc_type", pa.string()), ("length", pa.int64()), ("payload_digest", pa.string()), ("problem", pa.string())])


def write_pages(pages: DataFrame, folder: str, min_bytes: int = 1000) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as gzipped WARC archives under ``folder``; (archive, n_records).

    Each page goes through an ARC record (versions 1 and 2 in turn) and the converter.  Of pages with equal
    payloads of ``min_bytes`` or more, all but the one with the largest page_id are revisits of it.  Which
    these are is found from digests alone, and joined to the pages by their places, so no key is frequent.
    An archive is written under a name of its task's attempt and counts only if it is in the result, so a
    task that runs twice leaves a file that nothing reads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        names, counts = [], []

        def close(parts: list[bytes]) -> None:
            name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(names):04d}.warc.gz"
            with where.open_output_stream(f"{base}/{name}", compression=None) as f:
                f.write(b"".join(parts))
            names.append(name)
            counts.append(len(parts) - 1)

        info = gzip_member(warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("info", folder)), ("WARC-Date", "2024-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"software: tidemark\r\nformat: WARC File Format 1.1\r\n"))
        parts, size, n = [info], 0, 0
        for b in batches:
            for page, url, html, digest, main, first, place in zip(*(b.column(i) for i in range(7)), strict=True):
                page, url, body, main, first, place = page.as_py(), url.as_py() or "", html.as_py() or b"", main.as_py(), first.as_py(), place.as_py()
                own = _page_id(page, digest.as_py(), None if first is None or first == place else place)
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page is None else page}\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                n += 1
                version = 1 + n % 2
                arc = arc_file_header(version, "20240101000000") + arc_record(version, url, "0.0.0.0", "20240101000000", "text/html", head + body)
                for record in read_arc(arc):
                    parts.append(gzip_member(convert(record, own, None if main is None or main == page else _page_id(main, digest.as_py(), None))))
                size += len(body)
                if size >= ARCHIVE_BYTES:
                    close(parts)
                    parts, size = [info], 0
        if len(parts) > 1:
            close(parts)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["archive", "n_records"])

    html = F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html")
    body = steady(pages.select("page_id", "url", "html"), "pages").select("page_id", "url", html, F.sha1(html).alias("digest"), F.monotonically_increasing_id().alias("place"))
    ids = materialise(body.select("page_id", "digest", F.length("html").alias("size"), "place"), "warc-ids")
    mains = ids.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("main"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = ids.groupBy("page_id", "digest").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    told = ids.join(mains, "digest", "left").join(again, ids.page_id.eqNullSafe(again.page_id) & (ids.digest == again.digest), "left")
    told = materialise(told.where("main is not null or first is not null").select("place", "main", "first"), "warc-told")
    body = body.join(told, "place", "left").select("page_id", "url", "html", "digest", "main", "first", "place")
    return map_arrow(body, run, "archive string, n_records long")


def read_records(spark, folder: str, archives: DataFrame) -> DataFrame:
    """What the archives hold: record_type, record_id, refers_to, page_id, payload_bytes, payload_digest.

    A response's digest is computed from its payload and held against the header; a revisit has the one of
    the payload that it does not repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for content in b.column(0):
                for h, block in read_warc(content.as_py()):
                    if h["warc-type"] == "warcinfo":
                        continue
                    http, payload = split_http(block)
                    fields = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:] if ": " in x)
                    stated = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                    size = int(fields["Content-Length"])
                    if h["warc-type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != stated):
                        raise ValueError(f"{h['warc-record-id']}: the payload is not what its record says")
                    rows.append((h["warc-type"], h["warc-record-id"], h.get("warc-refers-to"), int(fields["X-Page-Id"]) if fields.get("X-Page-Id") else None, size, stated))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["record_type", "record_id", "refers_id", "page_id", "payload_bytes", "payload_digest"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    files = files.withColumn("archive", F.element_at(F.split("path", "/"), -1)).join(archives.select("archive"), "archive", "left_semi")
    return map_arrow(files.select("content"), run, "record_type string, record_id string, refers_id string, page_id long, payload_bytes long, payload_digest string")


def archive_pages(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Write ``pages`` as WARC archives into the shared folder, read them back, and give one row per page:
    page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload, null urls an empty one ('-' in the archive).  Rows with a null page_id
    are archived with page_id null and are never what others refer to.  Repeated rows are archived each; a
    page repeated with equal content stays a response in every copy.
    """
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    archives = materialise(write_pages(pages, folder, min_bytes), "warc-list")
    if archives.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    records = materialise(read_records(spark, folder, archives), "warc-records")
    mains = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"))
    wanted = records.where("refers_id is not null").select("refers_id").distinct()
    mains = mains.join(wanted, "refers_id", "left_semi").dropDuplicates(["refers_id"])
    return records.join(mains, "refers_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
