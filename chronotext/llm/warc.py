"""WARC derivative builder: linked metadata and plain-text conversion records of responses.

A response record (WARC headers and an HTTP block) gives two records: `metadata`, a JSON block with
the source's WARC headers, HTTP headers, digests, title and links, and `conversion`, the text of
the page. Both refer to the response by WARC-Refers-To, keep its target, date and payload
digest, and carry a digest of their own block. Ids are name-based UUIDs of (response id, type), so a
rerun gives the same records. `serialize` writes a record, `parse` reads records back.

The text is what lies outside tags, comments, scripts, styles and templates, with character references
resolved; block elements end lines, runs of blanks are one space, empty lines go. A block
without an HTTP head is taken as the payload. A null URL gives no target header, null content an
empty payload. Records of other types than response are passed over. Repeated rows repeat.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
# Elements whose content is not text, and elements that end a line.
HIDDEN = ["script", "style", "template", "noscript"]
BLOCKS = [
    "address", "article", "aside", "blockquote", "br", "caption", "dd", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "li", "main", "nav", "ol",
    "option", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
]
_HIDDEN = re.compile(rf"<!--|<({'|'.join(HIDDEN)})\b", re.I)
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in [*HIDDEN, "title"]}
_BLOCK = re.compile(rf"</?(?:{'|'.join(BLOCKS)})\b", re.I)
_TAG = re.compile(r"</?[a-zA-Z]|<[!?]")
_TITLE = re.compile(r"<title\b", re.I)
_LINK = re.compile(r"<(a|area|link|img|script|iframe|source|form)\b", re.I)
_ADDRESS = re.compile(r"\s(?:href|src|action)\s*=\s*", re.I)
_WORD = re.compile(r"[^\s>]+")
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
_BLANKS = re.compile(r"[ \t\r\f\v\xa0]+")
RESPONSE = "record_id string, target_uri string, date string, headers string, block binary"
DERIVED = ("warc_type string, record_id string, refers_to string, target_uri string, date string, content_type string, "
           "source_payload_digest string, block_digest string, content_length bigint, headers string, block binary")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def named_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


def clean_header(value: str) -> str:
    """Header values hold no line ends."""
    return re.sub(r"[\r\n]+", " ", value)


def header_lines(pairs: list[tuple[str, str | None]]) -> str:
    return VERSION + "\r\n" + "".join(f"{k}: {clean_header(v)}\r\n" for k, v in pairs if v is not None)


def serialize(headers: str, block: bytes) -> bytes:
    return headers.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], str, bytes]]:
    """(fields by lower-case name, header text, block) of each record of an uncompressed file."""
    at = 0
    while True:
        at = data.find(b"WARC/", at)
        end = data.find(b"\r\n\r\n", at)
        if at < 0 or end < 0:
            return
        text = data[at: end + 2].decode("utf-8", "replace")
        fields = {k.strip().lower(): v.strip() for k, sep, v in (line.partition(":") for line in text.split("\r\n")[1:]) if sep}
        size = int(fields.get("content-length", 0))
        yield fields, text, data[end + 4: end + 4 + size]
        at = end + 4 + size


def members(data: bytes) -> Iterator[bytes]:
    """The content of a WARC file member by member; a file that is not compressed is one."""
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        yield member.decompress(data)
        data = member.unused_data
    if data:
        yield data


def http_parts(block: bytes) -> tuple[str, list[list[str]], bytes]:
    """(status line, headers, payload) of an HTTP response."""
    head, sep, payload = block.partition(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or not sep:
        return "", [], block
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    return first, [[k.strip(), v.strip()] for k, _, v in (line.partition(":") for line in lines)], payload


def without_hidden(page: str) -> str:
    """Comments and hidden elements as one space each; one left open reaches to the end. Each
    character is looked at a fixed number of times, also in tags that never close."""
    out, at, closable = [], 0, True
    for m in _HIDDEN.finditer(page):
        if m.start() < at:
            continue
        if m[1] is None:
            end = page.find("-->", m.end())
            stop = len(page) if end < 0 else end + 3
        else:
            closed = page.find(">", m.end()) if closable else -1
            if closed < 0:  # nor is there a `>` behind any later tag
                closable = False
                continue
            end = _CLOSE[m[1].lower()].search(page, closed + 1)
            stop = end.end() if end else len(page)
        out += [page[at: m.start()], " "]
        at = stop
    return "".join([*out, page[at:]])


def replace_tags(page: str, begin: re.Pattern, by: str) -> str:
    """Tags that begin like this, up to the next `>`, replaced; the search stops where none is left."""
    out, at = [], 0
    for m in begin.finditer(page):
        if m.start() < at:
            continue
        end = page.find(">", m.end())
        if end < 0:
            break
        out += [page[at: m.start()], by]
        at = end + 1
    return "".join([*out, page[at:]])


def plain_text(page: str) -> str:
    shown = replace_tags(replace_tags(without_hidden(page), _BLOCK, "\n"), _TAG, "")
    lines = (_BLANKS.sub(" ", x).strip() for x in html.unescape(shown).split("\n"))
    return "\n".join(x for x in lines if x)


def title_of(page: str) -> str | None:
    first = _TITLE.search(page)
    begin = page.find(">", first.end()) if first else -1
    end = _CLOSE["title"].search(page, begin + 1) if begin >= 0 else None
    return html.unescape(page[begin + 1: end.start()]).strip() if end else None


def links(page: str) -> list[dict[str, str]]:
    """The first address in each linking tag. The next address and the next `>` are looked for only once
    the last found lies behind."""
    out, at, address, bracket = [], 0, _ADDRESS.search(page), -1
    for m in _LINK.finditer(page):
        if address is None:
            break
        if m.start() < at:
            continue
        if bracket < m.end():
            bracket = page.find(">", m.end())
            bracket = len(page) if bracket < 0 else bracket
        if address.start() < m.end():
            address = _ADDRESS.search(page, m.end())
        while address is not None and address.start() < bracket:
            begin = address.end()
            quote = page[begin: begin + 1]
            end = page.find(quote, begin + 1) if quote in ('"', "'") and quote else -1
            word = None if end >= 0 else _WORD.match(page, begin)
            if end >= 0 or word:
                url, at = (page[begin + 1: end], end + 1) if end >= 0 else (word[0], word.end())
                out.append({"path": m[1].lower(), "url": html.unescape(url)})
                break
            address = _ADDRESS.search(page, address.start() + 1)
    return out


def decoded(payload: bytes, headers: list[list[str]]) -> str:
    """The page as text: content coding undone, charset by the headers, else as the page says in its first
    kilobyte, else UTF-8; what is not valid becomes replacement characters."""
    fields = {k.lower(): v for k, v in (pair for pair in headers if len(pair) == 2)}
    if fields.get("content-encoding", "").lower() in ("gzip", "x-gzip", "deflate"):
        try:
            payload = zlib.decompressobj(47 if "gzip" in fields["content-encoding"].lower() else 15).decompress(payload)
        except zlib.error:
            pass  # the bytes are taken as they are
    named = _CHARSET.search(fields.get("content-type", "")) or _CHARSET.search(payload[:1024].decode("latin-1"))
    try:
        return payload.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def derivatives(record_id: str, target: str | None, date: str | None, headers: str, block: bytes) -> list[tuple]:
    """The metadata and the conversion record of one response."""
    status, http, payload = http_parts(block)
    page, source = decoded(payload, http), digest(payload)
    meta = json.dumps({
        "warc-headers": [list(x.split(": ", 1)) for x in headers.split("\r\n")[1:] if ": " in x],
        "http-status": status, "http-headers": http, "block-digest": digest(block), "payload-digest": source,
        "payload-length": len(payload), "title": title_of(page), "links": links(page),
    }, ensure_ascii=False).encode()
    out = []
    for kind, mime, body in (("metadata", "application/json", meta), ("conversion", "text/plain", plain_text(page).encode())):
        own, mark = named_id(record_id, kind), digest(body)
        lines = header_lines([
            ("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", record_id), ("WARC-Target-URI", target),
            ("WARC-Date", date), ("WARC-Source-Payload-Digest", source), ("WARC-Block-Digest", mark),
            ("Content-Type", mime), ("Content-Length", str(len(body))),
        ])
        out.append((kind, own, record_id, target, date, mime, source, mark, len(body), lines, body))
    return out


def responses(pages: DataFrame, date: str, page: str = "page_id", url: str = "url", content: str = "html") -> DataFrame:
    """Response records of a table of fetched pages, beside its id column."""
    kind = pages.schema[page].dataType.simpleString()
    rows = pages.select(F.col(page).alias("page"), F.col(url).alias("url"), F.col(content).alias("content"))
    names = [page, *(f.split()[0] for f in RESPONSE.split(", "))]

    def build(batches):
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                out = []
                for row in part.to_pylist():
                    payload = (row["content"] or "").encode()
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
                    own = named_id("response", str(row["page"]), row["url"] or "")
                    lines = header_lines([
                        ("WARC-Type", "response"), ("WARC-Record-ID", own), ("WARC-Target-URI", row["url"]), ("WARC-Date", date),
                        ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)),
                        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block))),
                    ])
                    out.append((own, row["url"], date, lines, block))
                columns = list(zip(*out)) if out else [[]] * 5
                kinds = [pa.string()] * 4 + [pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    return rows.mapInArrow(build, f"`{page}` {kind}, {RESPONSE}")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Response records of WARC files, plain or compressed record by record, one task for each file. A
    compressed file is unpacked one member at a time."""

    def split(batches):
        for batch in batches:
            for content in batch.column("content"):
                found = ((f.get("warc-record-id"), f.get("warc-target-uri"), f.get("warc-date"), text, block)
                         for member in members(content.as_py()) for f, text, block in parse(member) if f.get("warc-type") == "response")
                while some := list(islice(found, 256)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*some), [pa.string()] * 4 + [pa.binary()])],
                        names=["record_id", "target_uri", "date", "headers", "block"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(split, RESPONSE)


def derive(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep and the fields, header text and block of two records for each response record."""
    kept = ", ".join(f"`{k}` {records.schema[k].dataType.simpleString()}" for k in keep)
    names = [f.split()[0] for f in DERIVED.split(", ")]
    kinds = [{"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[f.split()[1]] for f in DERIVED.split(", ")]

    def build(batches):
        for batch in batches:
            for part in (batch.slice(i, 128) for i in range(0, batch.num_rows, 128)):
                out, rows = [], []
                for i, r in enumerate(part.select(["record_id", "target_uri", "date", "headers", "block"]).to_pylist()):
                    out += derivatives(r["record_id"] or named_id("response", "", r["target_uri"] or ""), r["target_uri"],
                                       r["date"], r["headers"] or "", r["block"] or b"")
                    rows += [i, i]
                if out:
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(k).take(take) for k in keep), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))],
                        names=[*keep, *names])

    source = records.select(*keep, "record_id", "target_uri", "date", "headers", "block")
    return source.mapInArrow(build, f"{kept}, {DERIVED}" if kept else DERIVED)
