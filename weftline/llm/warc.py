"""WARC archives: deduplicating writer and salvage reader.

The reader checks each record (gzip CRC, version line, length, digests). Where
a check fails it searches on for the next gzip member that begins a record, or
the next version line, takes up reading there, and logs the bytes between as
quarantined. It does so within the contents of a member too, and in what comes
out of a damaged member before the damage.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.lineage import cut, new_folder
from weftline.llm.files import create, open_file

PAGE = "urn:weftline:page:"
ROTATE = 256 << 20
WINDOW = 1 << 20
#: Bytes read at first for the header block of a plain record.
HEADER_BYTES = 1 << 16


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None) -> bytes:
    """One response, or one revisit that keeps the HTTP head of the payload but not its bytes."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{PAGE}{'null' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        "Content-Type: application/http;msgtype=response",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{PAGE}{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info(name: str) -> bytes:
    """The record that a file begins with."""
    block = b"software: weftline\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Filename: {name}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    offset: int
    length: int
    headers: dict[str, str]
    block: bytes


@dataclass
class Gap:
    offset: int
    length: int
    reason: str


class Broken(Exception):
    """A check of a record failed."""


def _parse(data: bytes, at: int, end_known: bool = True) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at ``at``; Broken if a check fails."""
    if not re.match(rb"WARC/1\.[01]\r\n", data[at : at + 10]):
        raise Broken("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise Broken("headers do not end")
    headers = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Broken("header without a colon")
        headers[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    size = headers.get("content-length", "")
    if not size.isdigit():
        raise Broken("no content length")
    first, last = stop + 4, stop + 4 + int(size)
    if data[last : last + 4] != b"\r\n\r\n":
        raise Broken("record is cut short" if len(data) < last + 4 else "record does not end where its length says")
    block = data[first:last]
    told = headers.get("warc-block-digest", "")
    if told.startswith("sha1:") and told[5:] != sha1_base32(block):
        raise Broken("block digest differs")
    return headers, block, last + 4


def _read(f, at: int, n: int) -> bytes:
    f.seek(at)
    return f.read(n)


def _member(f, at: int) -> tuple[bytes, int, str]:
    """The contents of the gzip member at ``at``, its length and ''; of a damaged one what comes out before the damage, the bytes read for it and the reason."""
    d, out, pos = zlib.decompressobj(31), [], at
    while not d.eof:
        chunk = _read(f, pos, WINDOW)
        if not chunk:
            return b"".join(out), pos - at, "member is cut short"
        before = d.copy()
        try:
            out.append(d.decompress(chunk))
        except zlib.error as e:
            try:
                for k in range(len(chunk)):  # byte by byte, since a failed call gives nothing
                    out.append(before.decompress(chunk[k : k + 1]))
            except zlib.error:
                pos += k
            return b"".join(out), pos - at, f"member is damaged: {e}"
        pos += len(chunk)
    return b"".join(out), pos - len(d.unused_data) - at, ""


def _plain(f, at: int) -> tuple[dict[str, str], bytes, int]:
    n = HEADER_BYTES
    while (stop := (head := _read(f, at, n)).find(b"\r\n\r\n")) < 0 and len(head) == n:
        n *= 2
    size = re.search(rb"\r\n[Cc]ontent-[Ll]ength:\s*(\d+)\s*\r\n", head[: stop + 2]) if stop >= 0 else None
    if not size:
        raise Broken("no header block with a content length")
    need = stop + 4 + int(size[1]) + 4
    return _parse(head[:need] if need <= len(head) else _read(f, at, need), 0)


_VERSION = re.compile(rb"WARC/1\.[01]\r\n")


def _records_at(f, at: int) -> tuple[list[Record], int, list[Gap], bool]:
    """All records of the member or plain record at ``at``, its length, its gaps, and whether it is damaged, so that its end is not known.

    Of a member that fails its own checks only records whose block digest holds are taken.
    """
    magic = _read(f, at, 5)
    if magic[:2] == b"\x1f\x8b":
        data, length, damage = _member(f, at)
        found, gaps, pos = [], [], 0
        while pos < len(data):
            try:
                headers, block, end = _parse(data, pos)
                if damage and not headers.get("warc-block-digest", "").startswith("sha1:"):
                    raise Broken(f"no block digest, and {damage}")
            except Broken as e:
                gaps.append(Gap(at, length, f"within a member: {e}"))
                sign = _VERSION.search(data, pos + 1)
                pos = sign.start() if sign else len(data)
                continue
            found.append(Record(at, length, headers, block))
            pos = end
        if not found:
            raise Broken(damage or (gaps[0].reason if gaps else "empty member"))
        if damage:
            gaps.append(Gap(at, length, damage))
        return found, length, gaps, bool(damage)
    if magic == b"WARC/":
        headers, block, length = _plain(f, at)
        return [Record(at, length, headers, block)], length, [], False
    raise Broken("neither a member nor a version line")


_SIGN = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


def _signs(f, at: int, size: int) -> Iterator[int]:
    """Offsets from ``at`` on that look like the beginning of a member or record."""
    while at < size:
        window = _read(f, at, WINDOW)
        yield from (at + m.start() for m in _SIGN.finditer(window))
        if at + len(window) >= size:
            return
        at += max(1, len(window) - 10)


def _next(f, start: int, size: int, read: int = 0) -> int:
    """Where the next readable member or record begins after ``start``; version lines in the first ``read`` bytes are a member's own."""
    seen = start
    for sign in _signs(f, start + 1, size):
        if sign <= seen:  # windows overlap
            continue
        seen = sign
        if sign < start + read and _read(f, sign, 1) == b"W":
            continue
        try:
            _records_at(f, sign)
        except Broken:
            continue
        return sign
    return size


def salvage(f, size: int) -> Iterator[Record | Gap]:
    """The sound records of a file in order, and the byte gaps between them. Memory: one record or member."""
    at = 0
    while at < size:
        try:
            records, length, gaps, damaged = _records_at(f, at)
        except Broken as e:
            start, at = at, _next(f, at, size)
            yield Gap(start, at - start, str(e))
            continue
        if damaged:
            length = _next(f, at, size, length) - at
            for x in records + gaps:
                x.length = length
        yield from records
        yield from gaps
        at += length


def page_records(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, record_type, refers_to) of what to write.

    Of the pages with equal payloads of ``least_bytes`` or more, the one with
    the smallest id is the response, the others revisit it. Equal rows of the
    smallest id are all responses, and so are rows with a null id. A null html
    is an empty payload. Payloads are told apart by SHA-1 and length.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.encode(F.col(html_col).cast("string"), "utf-8"), F.lit(b"")).alias("payload"))
    key = F.when(F.length("payload") >= least_bytes, F.concat(F.sha1("payload"), F.length("payload").cast("string"))).alias("key")
    groups = rows.select("page_id", key).where("key is not null").groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = cut(groups.where("n > 1").select("key", "first"))
    out = rows.withColumn("key", key).join(groups, "key", "left")
    again = F.coalesce(F.col("page_id") > F.col("first"), F.lit(False))
    return out.select("page_id", "url", "payload", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str, compress: bool = True, rotate: int = ROTATE) -> DataFrame:
    """Writes gzip-per-record archives; (path, bytes, records) per file, of finished attempts only. records leaves out the one that a file begins with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = uri = None
        n = at = 0

        def done() -> pa.RecordBatch:
            f.close()
            return pa.record_batch([[uri], [at], [n]], names=["path", "bytes", "records"])

        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, payload, kind, first = (c[k].as_py() for c in batch.columns)
                if f is None:
                    uri, f = create(folder, ".warc.gz" if compress else ".warc")
                    data = info(uri.rpartition("/")[2])
                    data = gzip.compress(data, 6, mtime=0) if compress else data
                    f.write(data)
                    n, at = 0, len(data)
                data = record(kind, page_id, url, payload, sha1_base32(payload), first)
                data = gzip.compress(data, 6, mtime=0) if compress else data
                f.write(data)
                n, at = n + 1, at + len(data)
                if at >= rotate:
                    yield done()
                    f = None
        if f is not None:
            yield done()

    return cut(records.select("page_id", "url", "payload", "record_type", "refers_to").mapInArrow(run, "path string, bytes long, records long"))


_ROW = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("reason", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _page(uri: str | None) -> int | None:
    told = (uri or "").strip("<>").removeprefix(PAGE)
    return int(told) if re.fullmatch(r"-?\d+", told) else None


def _row(path: str, x: Record | Gap) -> dict:
    out = dict.fromkeys(_ROW.names) | {"path": path, "offset": x.offset, "length": x.length}
    if isinstance(x, Gap):
        return out | {"reason": x.reason}
    head, _, payload = x.block.partition(b"\r\n\r\n")
    kind, digest = x.headers.get("warc-type"), x.headers.get("warc-payload-digest", "").removeprefix("sha1:")
    told = re.search(rb"(?im)^content-length:\s*(\d+)", head)
    out |= {"record_type": kind, "page_id": _page(x.headers.get("warc-record-id")), "url": x.headers.get("warc-target-uri"), "refers_to": _page(x.headers.get("warc-refers-to"))}
    if kind == "revisit":
        return out | {"payload_digest": digest, "payload_bytes": int(told[1]) if told else None}
    if digest and digest != sha1_base32(payload):
        return dict.fromkeys(_ROW.names) | {"path": path, "offset": x.offset, "length": x.length, "reason": "payload digest differs"}
    return out | {"payload_digest": sha1_base32(payload), "payload_bytes": len(payload), "payload": payload}


def read_archives(files: DataFrame, payloads: bool = True, whole: bool = False) -> DataFrame:
    """Rows of all records of the files named in ``path``, one file a task; quarantined gaps have a reason and no record_type.

    payloads: also return the payload bytes of responses. whole: files also say
    how many ``records`` they hold; a file of which another number of pages is
    read, or that has a gap, is an error.
    """
    keep = [n for n in _ROW.names if payloads or n != "payload"]
    schema = pa.schema([_ROW.field(n) for n in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, told in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with open_file(path) as f:
                    rows, held, pages = [], 0, 0
                    for x in salvage(f, f.size()):
                        rows.append(_row(path, x))
                        pages += rows[-1]["record_type"] in ("response", "revisit")
                        if whole and rows[-1]["reason"]:
                            raise ValueError(f"{path} at {x.offset}: {rows[-1]['reason']}")
                        held += x.length
                        if len(rows) >= 1000 or held > 8 << 20:
                            yield pa.RecordBatch.from_pylist([{k: r[k] for k in keep} for r in rows], schema)
                            rows, held = [], 0
                    if whole and pages != told:
                        raise ValueError(f"{path}: {pages} pages read, {told} written")
                    if rows:
                        yield pa.RecordBatch.from_pylist([{k: r[k] for k in keep} for r in rows], schema)

    kinds = {"string": "string", "int64": "long", "binary": "binary"}
    ddl = ", ".join(f"`{f.name}` {kinds[str(f.type)]}" for f in schema)
    n = max(1, files.count())
    told = F.col("records") if whole else F.lit(None).cast("long")
    return files.select("path", told.alias("records")).repartition(n).mapInArrow(run, ddl)


def warc_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes the pages as WARC archives in the shared folder and reads them back.

    (page_id, payload_bytes, payload_digest, record_type, refers_to) per page,
    all from the archives; a record written that is not read is an error. Null ids, null and empty html, ties and repeated rows:
    see ``page_records``; each row is one record. Extra columns are not read. An
    empty table makes no file and gives an empty result.
    """
    files = write_archives(page_records(pages, least_bytes), new_folder(pages.sparkSession))
    return read_archives(files, payloads=False, whole=True).where("record_type in ('response', 'revisit')").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
