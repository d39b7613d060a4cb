"""WARC derivatives: of each response record a metadata record and a plain-text conversion record.

Both derived records name their source in WARC-Refers-To, with its target URI and date, and the metadata keeps
the source's HTTP headers, payload digest and length. Digests are SHA-1 in base 32, as is usual in archives.
Record ids are name-based UUIDs of what a record stands for, so a task that runs again makes the same records.
Records are separate gzip members; a file is renamed into place when it is complete.

Sources are records of WARC/1.0, 1.1 or older drafts, with any headers in any case, as read_warc finds them in files
of gzip members or plain records, or as responses() makes them of a table of pages. Digests are compared where they
are given as SHA-1. Chunked and compressed bodies are decoded, and text is read in the charset that the HTTP header,
a byte order mark or the page names, else as UTF-8. A record that cannot be read is a row with an error and no
derived record; the job goes on.

A response without a payload has an empty conversion; null URLs are empty, null dates are the epoch, null records
are errors. Repeated rows give records of the same ids. An empty table gives no records. Columns other than those
named are ignored, whatever their names. A very long payload is held whole by one task, once for each form of it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .markup import lines
from .shared import fresh_path, partitions
from .token_files import _files

VERSION, EPOCH = "WARC/1.1", "1970-01-01T00:00:00Z"
#: What a record begins with, and a member of gzip (fixed values).
MAGIC, MEMBER = re.compile(rb"WARC/\d+\.\d+\r?\n"), b"\x1f\x8b\x08"
CHARSET = re.compile(rb"<meta[^>]{0,200}?charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)
SAID = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I | re.A)
#: Types of records that have derived ones; bytes that a file is read by.
SOURCES, READ = ("response", "resource"), 1 << 20
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space (fixed value)
RECORDS = "page_id long, record_id string, record_type string, refers_to string, target_uri string, payload_digest string, block_digest string, n_bytes long, error string"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, ' '.join(map(str, parts)))}>"


def record(kind: str, block: bytes, headers: list[tuple[str, str]]) -> bytes:
    """A record; headers are in addition to type, block digest and length."""
    head = [VERSION, f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"WARC-Block-Digest: {digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def named(head: bytes) -> tuple[str, list[tuple[str, str]]]:
    """First line, and names and values of the lines that follow; a line that begins with white space goes on with the one before."""
    first, *rest = head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")
    found: list[tuple[str, str]] = []
    for line in rest:
        if line[:1] in (" ", "\t") and found:
            found[-1] = (found[-1][0], f"{found[-1][1]} {line.strip()}")
        elif line:
            name, _, value = line.partition(":")
            found.append((name.strip(), value.strip()))
    return first, found


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, by lower-case name, and block of a record; the block's digest is checked where there is one."""
    if not MAGIC.match(data):
        raise ValueError("not a WARC record")
    head, block_at = _head(data, 0)
    headers: dict[str, str] = {}
    for name, value in named(head)[1]:
        headers.setdefault(name.lower(), value)
    if not headers.get("content-length", "").isdigit():
        raise ValueError("a record without a length")
    block = data[block_at : block_at + int(headers["content-length"])]
    if len(block) < int(headers["content-length"]) or data[block_at + len(block) :].strip(b"\r\n"):
        raise ValueError("a record of another length than it says")
    given = headers.get("warc-block-digest", "")
    if given.lower().startswith("sha1:") and len(given) == 37 and given[5:].upper() != digest(block)[5:]:
        raise ValueError("a block of another digest than its record says")
    return headers, block


def _head(data: bytes, at: int) -> tuple[bytes, int]:
    """Header lines from a place on, and where what follows them begins."""
    ends = [(k, len(x)) for x in (b"\r\n\r\n", b"\n\n") if (k := data.find(x, at)) >= 0]
    if not ends:
        return data[at:], len(data)
    end, n = min(ends)
    return data[at:end], end + n


def payload(block: bytes, http: bool) -> tuple[str, list[tuple[str, str]], bytes, str]:
    """Status line, fields, decoded body and text of a response's block."""
    status, fields, body = "", [], block
    if http:
        head, at = _head(block, 0)
        status, fields = named(head)
        body = block[at:]
    by = {k.lower(): v for k, v in reversed(fields)}
    if "chunked" in by.get("transfer-encoding", "").lower():
        body = _unchunked(body)
    if by.get("content-encoding", "").lower().strip() in ("gzip", "x-gzip", "deflate"):
        for bits in (47, -15):  # gzip or zlib, then bare deflate, as servers send both by that name
            try:
                body = zlib.decompressobj(bits).decompress(body)
                break
            except zlib.error:
                pass
    return status, fields, body, _text(body, by.get("content-type", ""))


def _unchunked(body: bytes) -> bytes:
    """The data of chunks; what is no chunk ends them, and a body that never was chunked stays as it is."""
    out, at = [], 0
    while (end := body.find(b"\n", at)) >= 0:
        size = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9a-fA-F]{1,8}", size):
            break
        n = int(size, 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 1 : end + 1 + n])
        at = end + 1 + n
        at += 2 if body.startswith(b"\r\n", at) else body.startswith(b"\n", at)
    return b"".join(out) if out else body


def _text(body: bytes, content_type: str) -> str:
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if body.startswith(mark):
            return body[len(mark) :].decode(name, "replace")
    said = SAID.search(content_type)
    meta = None if said else CHARSET.search(body[:2048])
    try:
        return body.decode(said[1] if said else meta[1].decode("ascii") if meta else "utf-8", "replace")
    except LookupError:  # no charset of that name
        return body.decode("utf-8", "replace")


def response(page_id: int | None, url: str | None, date: str | None, payload: str | None) -> bytes:
    """A response record of a page."""
    url, date, body = _line(url), date or EPOCH, (payload or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    own = record_id("response", page_id, url, date, digest(body))
    return record("response", http + body, [("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", url), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", digest(body)), ("WARC-Page-ID", str("" if page_id is None else page_id))])


def _line(text: str | None) -> str:
    return "".join((text or "").splitlines())


def derive(source: bytes) -> list[bytes]:
    """The metadata and conversion records of a response or resource record; other records have none."""
    headers, block = parse(source)
    if headers.get("warc-type", "").lower() not in SOURCES:
        return []
    http = headers.get("content-type", "application/http").lower().startswith("application/http") and headers["warc-type"].lower() == "response"
    status, fields, body, page = payload(block, http)
    text = "\n".join(t for t, _ in lines(page)).encode("utf-8", "replace")
    paid = headers.get("warc-payload-digest") or digest(block[_head(block, 0)[1] :] if http else block)
    blocked = headers.get("warc-block-digest") or digest(block)
    uri, date = headers.get("warc-target-uri", "").strip("<>"), headers.get("warc-date", EPOCH)
    origin = headers.get("warc-record-id") or record_id("source", uri, date, blocked)
    names = {kind: record_id(kind, origin) for kind in ("metadata", "conversion")}
    about = {"http-status": status, "http-headers": [list(x) for x in fields], "source-payload-digest": paid, "source-block-digest": blocked, "source-length": len(body), "conversion": names["conversion"], "conversion-digest": digest(text)}
    common = [("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", origin), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date)]
    if "warc-page-id" in headers:
        common.append(("WARC-Page-ID", headers["warc-page-id"]))
    meta = json.dumps(about, sort_keys=True).encode()
    return [
        record("metadata", meta, [("WARC-Record-ID", names["metadata"]), *common, ("WARC-Concurrent-To", names["conversion"]), ("Content-Type", "application/json"), ("WARC-Payload-Digest", digest(meta))]),
        record("conversion", text, [("WARC-Record-ID", names["conversion"]), *common, ("Content-Type", "text/plain; charset=utf-8"), ("WARC-Payload-Digest", digest(text))]),
    ]


def split_records(data: bytes) -> Iterator[bytes]:
    """The records that lie one after another; what is none goes up to the next one's first line, as one piece."""
    at = 0
    while at < len(data):
        head, block = _head(data, at)
        length = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", head.replace(b"\r", b""))
        end = block + int(length[1]) if MAGIC.match(data, at) and length else len(data) + 1
        if end > len(data):  # no record, or not all of it
            m = MAGIC.search(data, at + 1)
            end = m.start() if m else len(data)
        while end < len(data) and data[end] in b"\r\n":
            end += 1
        yield data[at:end]
        at = end


def members(read: Callable[[int], bytes]) -> Iterator[tuple[int, bytes, str | None]]:
    """Offset and data of each member of a gzip file, a piece at a time; a damaged one has an error, and the next is looked for."""
    at, held = 0, read(READ)
    while held:
        d, out, taken, error = zlib.decompressobj(31), [], 0, None
        piece = held
        while not d.eof and piece:
            try:
                out.append(d.decompress(piece))
            except zlib.error as e:
                error = f"a damaged member: {e}"
                break
            taken += len(piece)
            if not d.eof:
                piece = read(READ)
                held += piece
        if d.eof:
            taken -= len(d.unused_data)
        elif error:
            while (k := held.find(MEMBER, 1)) < 0 and (piece := read(READ)):
                at, held = at + len(held) - 2, held[-2:] + piece
            taken = k if k >= 0 else len(held)
        else:
            error = "a member without an end"
            taken = len(held)
        yield at, b"".join(out), error
        at, held = at + taken, held[taken:] or read(READ)


def read_records(data: bytes) -> Iterator[bytes]:
    """The records of a file of gzip members."""
    source = memoryview(data)
    place = 0

    def read(n: int) -> bytes:
        nonlocal place
        place += n
        return bytes(source[place - n : place])

    for _, member, error in members(read):
        if error:
            raise ValueError(error)
        yield from split_records(member)


def read_warc(files: DataFrame, path: str = "path") -> DataFrame:
    """path, offset (of the record, or of the gzip member it is in), record and error of all records of the files named by a column.

    A file is read by one task, member by member; damaged members and records are rows with an error.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                fs, at = _files(name)
                with fs.open_input_stream(at, compression=None) as f:
                    first = f.read(READ)
                    held = [first]
                    read = lambda n, f=f, held=held: held.pop() if held else f.read(n)
                    pieces = members(read) if first.startswith(MEMBER[:2]) else _plain(read)
                    for offset, data, error in pieces:
                        records = [data] if error else list(split_records(data))
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(records)), pa.array([offset] * len(records), pa.int64()), pa.array(records, pa.binary()), pa.array([error] * len(records), pa.string())], ["path", "offset", "record", "error"])

    names = files.select(F.col(path).alias("path")).filter("path is not null")
    return names.repartition(partitions(files.sparkSession), "path").mapInArrow(run, "path string, offset long, record binary, error string")


def _plain(read: Callable[[int], bytes]) -> Iterator[tuple[int, bytes, str | None]]:
    """Offset and data of each record of a plain file."""
    at, held, more = 0, b"", True
    while held or more:
        found = next(split_records(held), b"")
        if more and len(found) >= len(held):  # it may go on
            piece = read(max(READ, len(held)))
            more, held = bool(piece), held + piece
            continue
        yield at, found, None
        at, held = at + len(found), held[len(found) :]


def build_derivatives(responses: DataFrame, folder: str | None = None, level: int = 1) -> DataFrame:
    """Writes the derived records of the column `record` to a file for each task; returns a row for each record, read from its bytes, and for each source with an error.

    The rows are lazy; the files are complete when the rows have been computed.
    """
    folder = folder or fresh_path(responses.sparkSession, "warc")
    columns = [x.split()[0] for x in RECORDS.split(", ")]
    said = F.col("error") if "error" in responses.columns else F.lit(None).cast("string")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _files(f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz")
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        held = f"{at}.{uuid.uuid4().hex}"
        with fs.open_output_stream(held) as out:
            for b in batches:
                for k in range(0, b.num_rows, 200):
                    rows = []
                    for source, error in zip(b.column(0).slice(k, 200), b.column(1).slice(k, 200).to_pylist(), strict=True):
                        try:
                            if error or not source.is_valid:
                                raise ValueError(error or "no record")
                            found = derive(source.as_py())
                        except ValueError as e:
                            rows.append((None,) * 8 + (str(e),))
                            continue
                        for made in found:
                            out.write(gzip.compress(made, level, mtime=0))
                            h, block = parse(made)
                            page = h.get("warc-page-id", "")
                            rows.append((int(page) if re.fullmatch(r"-?\d{1,18}", page) else None, h["warc-record-id"], h["warc-type"], h["warc-refers-to"], h["warc-target-uri"], h["warc-payload-digest"], h["warc-block-digest"], len(block), None))
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), *[pa.string()] * 6, pa.int64(), pa.string()))], columns)
        fs.move(held, at)

    return responses.select("record", said.alias("error")).mapInArrow(run, RECORDS)


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """A response record of each page, in the column `record`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200).to_pydict()
                yield pa.RecordBatch.from_arrays([pa.array([response(i, u, None, x) for i, u, x in zip(part["page_id"], part["url"], part["html"], strict=True)], pa.binary())], ["record"])

    return pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html")).mapInArrow(run, "record binary")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived records of all pages."""
    return build_derivatives(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))
