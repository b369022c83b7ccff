"""WARC archives: a writer, and a reader that salvages what damaged files still hold."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracewell.llm.store import keep, shared_folder

_VERSION = re.compile(rb"WARC/[01]\.\d+\r?\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/[01]\.\d+\r?\n")
_MAGIC = re.compile(rb"\x1f\x8b\x08")
#: What ends a header: an empty line, or, in a torn one, the next record.
_STOP = re.compile(rb"\r\n\r\n|\n\n|(WARC/[01]\.\d+\r?\n)")
_LINE = re.compile(rb"\r?\n")
#: Header fields that a record has once at most.
_SINGLE = {"warc-type", "warc-record-id", "warc-payload-digest", "warc-refers-to", "warc-target-uri", "content-length", "content-type"}
#: Compressed bytes that are unpacked at once.
CHUNK = 65536
_BLANK = re.compile(rb"[\r\n]*")
END = b"\r\n\r\n"
_NO_ID = "-4fff-bfff-"


def base32_sha1(text: Column) -> Column:
    """Base32 (RFC 4648, upper case) of the SHA-1 of a string's UTF-8 bytes: each 40 bits are 10 hexadecimal and 8 base-32 digits."""
    digest = F.sha1(text)
    digits = F.concat(*[F.lpad(F.lower(F.conv(F.substr(digest, F.lit(1 + 10 * k), F.lit(10)), 16, 32)), 8, "0") for k in range(4)])
    return F.translate(digits, "0123456789abcdefghijklmnopqrstuv", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page_id: Column, else_from: Column) -> Column:
    h = F.lpad(F.lower(F.hex(page_id)), 16, "0")
    of = lambda h, mid: F.concat(F.lit("<urn:uuid:"), h.substr(1, 8), F.lit("-"), h.substr(9, 4), F.lit(f"{mid}00000000"), h.substr(13, 4), F.lit(">"))
    return F.coalesce(of(h, "-4000-8000-"), of(F.lpad(F.lower(F.hex(else_from)), 16, "0"), _NO_ID))


def page_of(record_id: str | None) -> int | None:
    """The page_id in a record id of this writer; None for others and for rows without one."""
    m = re.fullmatch(r"<urn:uuid:(\w{8})-(\w{4})-4000-8000-0{8}(\w{4})>", record_id or "")
    n = int(m[1] + m[2] + m[3], 16) if m else None
    return n - (1 << 64) if n is not None and n >> 63 else n


def records(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """(record) of each row of pages (page_id, url, html): one WARC/1.1 record as text, without the blank lines that end it.

    Of records with equal payloads of min_revisit_bytes or more, the one with the
    smallest page_id is a response and the others are revisits without payload. A
    null html is an empty payload; rows without a page_id, and all rows that share
    the smallest one, are responses; a null url leaves the header out, and white
    space and control characters in one are percent-encoded.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", base32_sha1(F.col("html"))).withColumn("size", F.octet_length("html"))
    first = rows.where((F.col("size") >= min_revisit_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = keep(first.where("n > 1").drop("n"), "revisited")
    rows = rows.join(first, "digest", "left")
    again = (F.col("page_id") > F.col("first")) & (F.col("size") >= min_revisit_bytes)
    again = F.coalesce(again, F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit("\r\n\r\n"))
    body = F.concat(http, F.when(again, "").otherwise(F.col("html")))
    url = F.col("url")
    for c in [*range(0x21), 0x7F]:
        url = F.when(url.contains(chr(c)), F.replace(url, F.lit(chr(c)), F.lit(f"%{c:02X}"))).otherwise(url) if c in (0x09, 0x0A, 0x0D, 0x20) else url
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"), F.xxhash64("url", "html"))),
        F.lit("WARC-Date: 2000-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("first"), F.col("first")))),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body)),
    )
    return rows.select(F.concat(head, F.lit("\r\n\r\n"), body).alias("record"))


def write(pages: DataFrame, path: str, min_revisit_bytes: int = 0, file_bytes: int = 32_000_000) -> None:
    """Writes archives of about file_bytes at most, by the mean size of a record; Spark's text writer puts the two blank lines after each record, so any store of Spark's will do."""
    size = pages.agg(F.sum(F.octet_length("html")), F.count("*")).first()
    per_file = max(1, file_bytes * max(1, size[1]) // ((size[0] or 0) + 600 * max(1, size[1])))
    records(pages, min_revisit_bytes).write.option("lineSep", END.decode()).option("maxRecordsPerFile", per_file).text(path)


class Bad(ValueError):
    """A record or a member that fails a check."""


def _record(data: bytes, pos: int) -> tuple[dict, int]:
    """The record whose version line begins at pos, and where what follows it begins.

    Lines end in CR LF or LF alone. A header is looked for up to the next version line
    only: so a torn one isn't fused with the record after it, and headers without an end
    take time in proportion.
    """
    line = _VERSION.match(data, pos)
    if not line:
        raise Bad("no version line")
    stop = _STOP.search(data, line.end())
    if not stop:
        raise Bad("header has no end")
    if stop[1]:
        raise Bad("header is torn by the next record")
    head = {}
    for raw in _LINE.split(data[line.end() : stop.start()]):
        name, colon, value = raw.partition(b":")
        if not colon:
            raise Bad("header line without a colon")
        field = name.strip().lower().decode("latin-1")
        if field in head and field in _SINGLE:
            raise Bad(f"header repeats {field}")
        head[field] = value.strip().decode("utf-8", "replace")
    if not head.get("content-length", "").isdigit():
        raise Bad("no content length")
    first = stop.end()
    after = first + int(head["content-length"])
    if after > len(data):
        raise Bad("cut off")
    ends = next((e for e in (END, b"\n\n") if data.startswith(e, after)), None)
    if not ends:
        raise Bad("no blank lines after the record")
    block, http = data[first:after], {}
    payload = block
    if head.get("content-type", "").startswith("application/http"):
        gap = re.search(rb"\r\n\r\n|\n\n", block)
        if not gap:
            raise Bad("HTTP header has no end")
        top, payload = block[: gap.start()], block[gap.end() :]
        http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in re.split("\r?\n", top.decode("latin-1"))[1:])}
    kind, digest = head.get("warc-type"), head.get("warc-payload-digest", "").removeprefix("sha1:")
    own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if kind == "revisit":
        size = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
    else:
        size = len(payload)
        if digest and digest != own:
            raise Bad("payload digest differs")
        digest = own
    return {"record_type": kind, "record_id": head.get("warc-record-id"), "refers_id": head.get("warc-refers-to"), "url": head.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest or None, "payload": payload if kind != "revisit" else None}, after + len(ends)


def _member(data: bytes, pos: int) -> tuple[bytes, int, str | None]:
    """What the gzip member at pos unpacks to, where it ends, and why it can't be unpacked to its end."""
    member, out, at = zlib.decompressobj(31), [], pos
    while not member.eof and at < len(data):
        chunk, before = data[at : at + CHUNK], member.copy()
        try:
            out.append(member.decompress(chunk))
        except zlib.error as e:
            for k in range(len(chunk)):
                try:
                    out.append(before.decompress(chunk[k : k + 1]))
                except zlib.error:
                    break
            return b"".join(out), at + k, f"member: {e}"
        at += len(chunk)
    return b"".join(out), at - len(member.unused_data), None if member.eof else "member is cut off"


def _reach(data: bytes, pos: int, size: int) -> int:
    """Where the bytes end from which the gzip member at pos unpacks to its first size bytes."""
    member, at, n = zlib.decompressobj(31), pos, 0
    while True:
        chunk, before = data[at : at + CHUNK], member.copy()
        try:
            got = len(member.decompress(chunk))
        except zlib.error:
            got = size
        if n + got >= size:
            for k in range(len(chunk)):
                n += len(before.decompress(chunk[k : k + 1]))
                if n >= size:
                    return at + k + 1
        n += got
        at += len(chunk)


def _inside(text: bytes) -> Iterator[tuple[int, int, dict | None, str | None]]:
    """(start, end, record, reason) of each record and gap of unpacked text."""
    at = 0
    while (at := _BLANK.match(text, at).end()) < len(text):
        try:
            found, after = _record(text, at)
        except Bad as e:
            start, found = at, None
            for m in _VERSION.finditer(text, at + 1):
                try:
                    found, after = _record(text, m.start())
                except Bad:
                    continue
                break
            at = m.start() if found else len(text)
            yield start, at, None, str(e)
            if not found:
                return
        yield at, after, found, None
        at = after


def _holds_unit(data: bytes, pos: int) -> bool:
    try:
        return bool(_unit(data, pos)[0])
    except Bad:
        return False


def _unit(data: bytes, pos: int) -> tuple[list[tuple[dict | None, str | None]], int, str | None]:
    """The records and gaps of the gzip member, or the plain record, at pos, where what gave them ends, and why the member's rest gives none."""
    if data[pos : pos + 2] != b"\x1f\x8b":
        found, after = _record(data, pos)
        return [(found, None)], after, None
    text, after, bad = _member(data, pos)
    parts = list(_inside(text))
    if bad:
        # A cut block that is stored as it is takes in the members after it; from there on the archive itself is searched.
        for k, (a, b, r, _) in enumerate(parts):
            if not r and any(_holds_unit(text, m.start()) for m in _MAGIC.finditer(text, a, b)):
                del parts[k:]
                break
    if not any(r for _, _, r, _ in parts) and (bad or parts):
        raise Bad(bad or parts[0][3])
    if bad:
        if not parts[-1][2]:
            parts.pop()  # belongs to the rest
        after = _reach(data, pos, parts[-1][1])
    return [(r, reason and f"{reason} (bytes {a} to {b} of the unpacked member)") for a, b, r, reason in parts], after, bad


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | None, str | None]]:
    """(offset, length, record, reason) of each record and of each quarantined gap of an archive.

    After a failed check the reader looks for the next gzip member or version line,
    wherever it stands, from which a whole, valid record can be read; all bytes
    before it are one gap. A damaged or cut gzip member is unpacked as far as it
    goes. Records and gaps inside a member have the place of the member, or of its
    part up to the last whole record; the rest of a damaged one is a gap.
    """
    pos, reason, at = 0, None, 0
    while True:
        if reason is None:
            pos = _BLANK.match(data, pos).end()
            if pos >= len(data):
                return
            try:
                found, after, rest = _unit(data, pos)
            except Bad as e:
                reason, at = str(e), pos + 1
        if reason is not None:
            found = None
            for m in _START.finditer(data, at):
                try:
                    found, after, rest = _unit(data, m.start())
                except Bad:
                    continue
                break
            at = m.start() if found is not None else len(data)
            yield pos, at - pos, None, reason
            if found is None:
                return
            pos = at
        for r, why in found:
            yield pos, after - pos, r, why
        pos = at = after
        reason = rest


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """All records and gaps of the archives at path, plain or with gzip members.

    Columns: file, offset, length, gap (why the bytes were quarantined, null for
    records), record_type, page_id, refers_to, url, payload_bytes, payload_digest,
    payload (null unless asked for). A file is one task's; archives are of a
    gigabyte at most by custom, and those of write() smaller. Empty files have no rows.
    """
    kinds = [("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("gap", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                name, rows = name.as_py(), []
                for offset, length, r, reason in salvage(content.as_py()):
                    r = r or {}
                    rows.append((name, offset, length, reason, r.get("record_type"), page_of(r.get("record_id")), page_of(r.get("refers_id")), r.get("url"), r.get("payload_bytes"), r.get("payload_digest"), r.get("payload") if with_payload else None))
                    if len(rows) == 2000:
                        yield made(rows)
                        rows = []
                if rows:
                    yield made(rows)

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], [n for n, _ in kinds])

    schema = "file string, offset long, length long, gap string, record_type string, page_id long, refers_to long, url string, payload_bytes long, payload_digest string, payload binary"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back; see records() and read()."""
    path = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write(pages, path, min_revisit_bytes)
    return read(pages.sparkSession, path)
