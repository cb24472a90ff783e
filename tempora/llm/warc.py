"""WARC derivatives: responses become linked metadata and plain-text conversion records.

``responses`` wraps pages as WARC/1.1 response records; ``derive`` reads any
response records and builds, for each, a metadata record (title, language,
character set, links, the source's HTTP headers) and a conversion record (plain
text).  Both carry WARC-Refers-To with the response's record id, its target URI
and date, and SHA-256 digests of their blocks; record ids are name-based UUIDs,
so a rerun gives the same ids.  Records are bytes; those of one table, one
after the other (or each gzipped, ``gzip=True``), are a valid WARC file.

Defined results: a null or empty body gives empty metadata and an empty
conversion; a null URI leaves out WARC-Target-URI; repeated pages give equal
records, each time; malformed markup is read as far as it goes (an unclosed tag
is text, an unclosed script or comment runs to the end); a record that isn't a
response gives nothing; other columns are ignored; an empty table gives an empty
result.  Map-only: no shuffle, one page in memory at a time.
"""

from __future__ import annotations

import gzip as gz
import hashlib
import html as _html
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 9562: names that are URLs

#: Elements whose contents aren't text, and those that begin a new line.
_HIDDEN = "script|style|noscript|template|svg|head"
_BLOCK = "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul|title"
_DROP = re.compile(rf"<!--.*?(?:-->|\Z)|<({_HIDDEN})\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TAG = re.compile(r"<(?:/?([a-zA-Z][a-zA-Z0-9]*)|[!?])(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>")
_IS_BLOCK = re.compile(rf"(?:{_BLOCK})\Z", re.I).match
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title", re.S | re.I)
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_CHARSET = re.compile(r"<meta\b[^>]*?\bcharset\s*=\s*[\"']?([A-Za-z0-9_-]+)", re.I)
_LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACES = re.compile(r"[ \t\r\f\v\xa0]+")


def to_text(html: str) -> str:
    """Visible text, a line for each block element."""
    body = _TAG.sub(lambda m: "\n" if m[1] and _IS_BLOCK(m[1]) else "", _DROP.sub("", html).replace("\n", " "))
    lines = (_SPACES.sub(" ", x).strip() for x in _html.unescape(body).split("\n"))
    return "\n".join(x for x in lines if x)


def _one_line(text: str) -> str:
    return " ".join(_html.unescape(text).split())


def metadata_of(html: str, http_headers: list[tuple[str, str]]) -> str:
    """application/warc-fields."""
    out = []
    for name, found in (("title", _TITLE.search(html)), ("language", _LANG.search(html)), ("charset", _CHARSET.search(html))):
        if found:
            out.append((name, _one_line(_TAG.sub("", found[1]))))
    out += [(f"source-{k.lower()}", v) for k, v in http_headers]
    out += [("outlink", _one_line(m[1] or m[2] or m[3] or "")) for m in _LINK.finditer(html)]
    return "".join(f"{k}: {v}\r\n" for k, v in out)


def digest(block: bytes) -> str:
    return f"sha256:{hashlib.sha256(block).hexdigest()}"


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(0).join(parts))}>"


def build(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of a record, gzipped or not."""
    if record[:2] == b"\x1f\x8b":
        record = gz.decompress(record)
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(headers.get("content-length", len(rest)))
    return headers, rest[:n]


def _uri(url: str | None) -> list[tuple[str, str]]:
    return [("WARC-Target-URI", re.sub(r"\s", "%20", url))] if url else []


def response(page: str, url: str | None, html: str | None, date: str = DATE) -> bytes:
    body = (html or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    payload = digest(body)
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", page, url or "", payload)), *_uri(url), ("WARC-Date", date)]
    return build([*headers, ("WARC-Payload-Digest", payload), ("WARC-Block-Digest", digest(http + body)), ("Content-Type", "application/http; msgtype=response")], http + body)


def derivatives(record: bytes) -> list[tuple[str, bytes]]:
    """[(type, record)]: metadata, then conversion; nothing for other records than responses."""
    headers, block = parse(record)
    if headers.get("warc-type") != "response":
        return []
    head, _, body = block.partition(b"\r\n\r\n")
    http = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:]) if k]
    html = body.decode("utf-8", "replace")
    source = headers.get("warc-record-id", "")
    out = []
    for kind, mime, text in (("metadata", "application/warc-fields", metadata_of(html, http)), ("conversion", "text/plain; charset=utf-8", to_text(html))):
        b = text.encode()
        fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, source)), ("WARC-Refers-To", source)]
        fields += [(name, headers[key]) for name, key in (("WARC-Target-URI", "warc-target-uri"), ("WARC-Date", "warc-date")) if key in headers]
        fields += [("WARC-Source-Payload-Digest", headers["warc-payload-digest"])] if "warc-payload-digest" in headers else []
        out.append((kind, build([*fields, ("WARC-Block-Digest", digest(b)), ("Content-Type", mime)], b)))
    return out


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE, gzip: bool = False) -> DataFrame:
    """(id, record): a response record for each page."""

    def run(batches):
        for batch in batches:
            for b in slices(batch, "html"):
                got = [response(*x, date) for x in zip(map(str, b.column(0).to_pylist()), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([gz.compress(x, mtime=0) if gzip else x for x in got], pa.binary())], names=["id", "record"])

    kind = pages.schema[id_col].dataType.simpleString()
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return src.mapInArrow(run, f"id {kind}, record binary").withColumnRenamed("id", id_col)


def derive(records: DataFrame, id_col: str = "page_id", record_col: str = "record", gzip: bool = False) -> DataFrame:
    """(id, warc_type, record_id, refers_to, target_uri, content_length, block_digest, block, record), two rows a response."""
    names = ["id", "warc_type", "record_id", "refers_to", "target_uri", "content_length", "block_digest", "block", "record"]

    def run(batches):
        for batch in batches:
            for b in slices(batch, "record"):
                rows = []
                for i, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for kind, out in derivatives(r or b""):
                        h, block = parse(out)
                        rows.append((i, kind, h["warc-record-id"], h["warc-refers-to"], h.get("warc-target-uri"), len(block), h["warc-block-digest"], block.decode(), gz.compress(out, mtime=0) if gzip else out))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    kinds = [b.schema.field(0).type, *[pa.string()] * 4, pa.int64(), pa.string(), pa.string(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    kind = records.schema[id_col].dataType.simpleString()
    src = records.select(F.col(id_col).alias("id"), F.col(record_col).alias("record"))
    out = src.mapInArrow(run, f"id {kind}, warc_type string, record_id string, refers_to string, target_uri string, content_length long, block_digest string, block string, record binary")
    return out.withColumnRenamed("id", id_col)
