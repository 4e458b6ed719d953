"""WARC derivatives: metadata and plain-text conversion records of responses.

Each response gets a metadata record (fetch facts and the links that were found) and a
conversion record (its text).  Both refer to the response by WARC-Refers-To, keep its
target URI, date and payload digest, and have digests of their own blocks; headers
that the response had and that describe the capture are carried on.

Defined results: records that are no responses are passed over; a record that can't be
read gives one row with an error; null HTML is an empty body; a null URL is an empty
target; repeated rows are derived each; equal input gives equal ids.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Headers of a response that describe its capture and go on to what is derived from it.
CARRIED = ("WARC-Date", "WARC-Target-URI", "WARC-IP-Address", "WARC-Warcinfo-ID", "WARC-Payload-Digest", "WARC-Identified-Payload-Type", "WARC-Truncated")

#: Elements whose text isn't shown.
_HIDDEN = ("script", "style", "noscript", "template")
#: Elements that stand on lines of their own.
_BLOCKS = frozenset("address article aside blockquote br dd div dl dt footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th title tr ul".split())
_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9]*)(?![\w-])")
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in _HIDDEN}
_HREF = re.compile(r"\bhref\s*=\s*([\"'])", re.I)
_OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
_BLANKS = re.compile(r"[ \t\r\f\v]+")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, *parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join((kind, *parts)))}>"


def write_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC/1.1 record; its length and block digest are added."""
    lines = [*headers, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    clean = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in lines)
    return b"WARC/1.1\r\n" + clean.encode() + b"\r\n" + block + b"\r\n\r\n"


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a file, gzipped as a whole or by record, or plain."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        while data[at : at + 1] in (b"\r", b"\n"):
            at += 1
        if at >= len(data):
            return
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no record at byte {at}")
        headers: dict[str, str] = {}
        last = ""
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            if line[:1] in " \t" and last:  # a folded line
                headers[last] += " " + line.strip()
                continue
            last, _, value = line.partition(":")
            headers[last] = value.strip()
        size = int(header(headers, "Content-Length") or -1)
        if size < 0 or end + 4 + size > len(data):
            raise ValueError(f"the record at byte {at} has no sound length")
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def header(headers: dict[str, str], name: str) -> str | None:
    return next((v for k, v in headers.items() if k.lower() == name.lower()), None)


def split_http(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """(status line, headers, body)."""
    head, _, body = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split("\r\n")
    return status, {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, body


def scan(page: str) -> tuple[list[str], list[str]]:
    """(pieces of text with a line feed for each tag of a block, links) of a page, in one walk.

    A tag is ``<`` with a letter or one of ``/!?`` up to the next ``>``; other ``<`` are text.  Comments and hidden elements without an end are tags like others.  What was looked for
    in vain isn't looked for again, so that work grows with the page's length.
    """
    pieces: list[str] = []
    links: list[str] = []
    gone: set[str] = set()  # ends that don't come any more

    def find(what: str, begin: int) -> int:
        if what in gone:
            return -1
        if what in _CLOSE:
            found = _CLOSE[what].search(page, begin)
            at = found.end() if found else -1
        else:
            at = page.find(what, begin)
            at += len(what) if at >= 0 else 0
        if at < 0:
            gone.add(what)
        return at

    at = 0
    while True:
        found = _OPEN.search(page, at)
        if not found:
            break
        tag = found.start()
        pieces.append(page[at:tag])
        if page.startswith("<!--", tag) and (end := find("-->", tag + 4)) > 0:
            pieces.append(" ")
            at = end
            continue
        end = find(">", tag + 1)
        if end < 0:
            at = tag
            break
        name = _NAME.match(page, tag + 1, end)
        kind = name[1].lower() if name else ""
        opens = page[tag + 1] != "/"
        if opens and kind in _CLOSE and (past := find(kind, end)) > 0:
            pieces.append(" ")
            at = past
            continue
        if opens and kind == "a" and (href := _HREF.search(page, tag + 2, end)):
            stop = find(href[1], href.end())
            if stop > 0:
                links.append(page[href.end() : stop - 1])
                end = max(end, find(">", stop) if stop > end else end)
        elif kind in _BLOCKS:
            pieces.append("\n")
        elif page[tag + 1 : tag + 9].lower() == "!doctype":
            pieces.append(" ")
        at = end
    pieces.append(page[at:])
    return pieces, links


def lines_of(pieces: list[str]) -> str:
    """Text with its entities read, blanks squeezed and empty lines left out."""
    text = _BLANKS.sub(" ", html.unescape("".join(pieces)))
    return "\n".join(x for line in text.split("\n") if (x := line.strip()))


def plain_text(page: str) -> str:
    """What a page shows: no scripts, styles, comments; blocks on lines of their own."""
    return lines_of(scan(page)[0])


def response_record(url: str, page: str, date: str, key: str) -> bytes:
    """A response record of a fetched page, for sources that keep URL and HTML apart."""
    body = page.encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body
    return write_record([("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", url, key)), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", digest(body)), ("Content-Type", "application/http;msgtype=response")], http)


def derive(headers: dict[str, str], block: bytes) -> list[tuple[str, str, bytes]]:
    """(type, id, record) of what is derived from a response; others give nothing."""
    if (header(headers, "WARC-Type") or "").lower() != "response":
        return []
    source = header(headers, "WARC-Record-ID") or ""
    status, http, body = split_http(block)
    kind = header(http, "Content-Type") or ""
    charset = re.search(r"charset=[\"']?([\w.:-]+)", kind, re.I)
    try:
        page = body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    carried = [(n, v) for n in CARRIED if (v := header(headers, n))]
    if not header(headers, "WARC-Payload-Digest"):
        carried.append(("WARC-Payload-Digest", digest(body)))
    pieces, found = scan(page)
    text = lines_of(pieces) if "html" in kind or not kind else page
    links = list(dict.fromkeys(map(html.unescape, found)))
    facts = [("http-status", status), ("http-content-type", kind), ("source-block-digest", header(headers, "WARC-Block-Digest") or digest(block)), ("text-digest", digest(text.encode())), *(("outlink", x) for x in links)]
    fields = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in facts).encode()
    out = []
    for name, content, data in (("metadata", "application/warc-fields", fields), ("conversion", "text/plain; charset=utf-8", text.encode())):
        own = record_id(name, source)
        out.append((name, own, write_record([("WARC-Type", name), ("WARC-Record-ID", own), ("WARC-Refers-To", source), *carried, ("Content-Type", content)], data)))
    return out


_KINDS = [("record_type", T.StringType()), ("record_id", T.StringType()), ("refers_to", T.StringType()), ("target_uri", T.StringType()), ("payload_digest", T.StringType()), ("block_digest", T.StringType()), ("record", T.BinaryType()), ("error", T.StringType())]


def derivatives(records: DataFrame, data_col: str = "record", id_col: str = "page_id") -> DataFrame:
    """A row for each record derived from the responses in a binary column (one or many records a value)."""
    slim = records.select(F.col(id_col), F.col(data_col))
    schema = T.StructType([T.StructField(id_col, records.schema[id_col].dataType), *(T.StructField(*k) for k in _KINDS)])
    types = [pa.string()] * 6 + [pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, data in enumerate(batch.column(1)):
                try:
                    for headers, block in read_records(data.as_py() or b""):
                        for kind, own, record in derive(headers, block):
                            made, _ = next(read_records(record))
                            rows.append((kind, own, made["WARC-Refers-To"], made.get("WARC-Target-URI"), made["WARC-Payload-Digest"], made["WARC-Block-Digest"], record, None))
                            at.append(i)
                except (ValueError, OSError, EOFError) as bad:
                    rows.append((None,) * 7 + (str(bad),))
                    at.append(i)
            columns = list(zip(*rows)) or [[] for _ in types]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types))], schema.names)

    return slim.mapInArrow(run, schema)


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, record): a response record a page."""
    slim = pages.select(F.col(id_col), F.coalesce(F.col(url_col), F.lit("")), F.coalesce(F.col(html_col), F.lit("")))
    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), T.StructField("record", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [response_record(u, h, date, str(k)) for k, u, h in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], schema.names)

    return slim.mapInArrow(run, schema)
