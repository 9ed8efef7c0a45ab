"""WARC derivatives: every response gives one metadata and one conversion (plain text) record.

A response is a row ``record_id, target_uri, date, http_header, payload`` (``responses_from_pages``
makes such rows).  Both derived records refer to it by ``WARC-Refers-To`` and keep its target URI
and date.  The metadata record (``application/warc-fields``) carries the source's HTTP status line
and headers as they were, the source's block and payload digests (SHA-1, base 32), title, language
and the resolved out-links; the conversion record carries the visible text.  Record ids are name
based (from the source's id and the record type), so a task that runs again writes the same records.

Text: comments, the contents of script, style, noscript and template, and the page's head are dropped,
block tags end a line, other tags vanish, character references are resolved, blanks are collapsed, empty
lines go.  A head without a closing tag ends, as in HTML, before the first tag or text that cannot stand in one.  All patterns run in time linear in the page, whole pages are read.  No shuffle.

Cases: a null payload is an empty page (both records are still made, with the digest of no bytes);
a null target URI leaves out the header and relative links; null HTTP headers leave out those
fields; a null record id gives records that refer to nothing.  Unclosed tags or comments run to the
end of the page.  Repeated rows give equal records.  Other columns are passed by; an empty table
gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from typing import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.llm.textarrays import chunks

BLOCK_TAGS = frozenset("""address article aside blockquote body br caption dd div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section table tbody td tfoot th thead title
tr ul""".split())
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
# A head ends at its closing tag (which is optional) or before the first tag or text that cannot stand in one.
_HEAD = re.compile(r"<head(?=[\s/>])[^<>]*+>(?:\s++|</?(?:base|basefont|bgsound|link|meta|head)(?=[\s/>])[^<>]*+>"
                   r"|<title(?=[\s/>])[^<>]*+>.*?(?:</title\s*>|\Z))*+", re.I | re.S)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
_TITLE = re.compile(r"<title\b[^<>]*>([^<]*)", re.I)
_LANG = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_LINK = re.compile(r"<a\b[^<>]*?\bhref\s*=\s*(?:\"([^\"<>]*)\"|'([^'<>]*)'|([^\s\"'<>]+))", re.I)
_TAG = re.compile(r"<(?:/?([a-zA-Z][a-zA-Z0-9]*)|[!?])[^<>]*>")
_EDGE = re.compile(r"[\r\n]+")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def visible_text(page: str) -> str:
    parts = _TAG.split(_HEAD.sub(" ", _HIDDEN.sub(" ", page), count=1))
    out = [parts[0]]
    for tag, text in zip(parts[1::2], parts[2::2]):
        out.append("\n" if tag and tag.lower() in BLOCK_TAGS else "")
        out.append(text.replace("\n", " ") if "\n" in text else text)
    out[0] = out[0].replace("\n", " ")
    lines = (" ".join(line.split()) for line in html.unescape("".join(out)).split("\n"))
    return "\n".join([line for line in lines if line])


def links(page: str, base: str | None) -> list[str]:
    """Out-links in order, each once, resolved against ``base``."""
    found: dict[str, None] = {}
    for m in _LINK.finditer(_COMMENT.sub(" ", page)):
        ref = html.unescape(next(g for g in m.groups() if g is not None)).strip()
        if ref and not ref.startswith("#"):
            try:
                full = urljoin(base, ref) if base else ref
            except ValueError:
                continue
            if base or "://" in full:
                found[_EDGE.sub("", full)] = None
    return list(found)


def _one_line(text: str) -> str:
    return " ".join(text.split())


def _record(kind: str, source_id: str | None, uri: str | None, date: str | None, content_type: str, block: bytes):
    rid = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{source_id}:{uri}')}>"
    head = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", date), ("WARC-Target-URI", uri),
            ("WARC-Refers-To", source_id), ("WARC-Block-Digest", digest(block)), ("Content-Type", content_type),
            ("Content-Length", str(len(block)))]
    return rid, "WARC/1.1\r\n" + "".join(f"{k}: {_EDGE.sub(' ', v)}\r\n" for k, v in head if v is not None) + "\r\n"


def derive_one(record_id, uri, date, http_header, payload: bytes):
    """The two derived records of one response: tuples in the order of ``SCHEMA``."""
    page = payload.decode("utf-8", "replace")
    source_payload = digest(payload)
    source_block = digest((http_header or "").encode() + payload)
    title = _TITLE.search(page)
    lang = _LANG.search(page)
    out = links(page, uri)
    status, *headers = [line for line in (http_header or "").split("\r\n") if line] or [""]
    fields = [("refers-to", record_id), ("source-block-digest", source_block), ("source-payload-digest", source_payload),
              ("http-status", status or None), *[("http-header", h) for h in headers],
              ("title", _one_line(html.unescape(title[1])) if title else None), ("language", lang[1].lower() if lang else None),
              *[("outlink", u) for u in out]]
    meta = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    text = visible_text(page)
    rows = []
    for kind, content_type, block in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", text)):
        raw = block.encode("utf-8", "replace")
        rid, head = _record(kind, record_id, uri, date, content_type, raw)
        rows.append((kind, rid, record_id, uri, date, content_type, len(raw), digest(raw), source_block, source_payload,
                     len(out), head, raw.decode()))
    return rows


SCHEMA = ("warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, "
          "content_length bigint, block_digest string, source_block_digest string, source_payload_digest string, "
          "n_links bigint, header string, block string")
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_INPUT = ["record_id", "target_uri", "date", "http_header", "payload"]


def derive(responses: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Two rows a response: columns ``keep`` and ``SCHEMA``.  ``header + block + CRLF CRLF`` is a WARC record."""
    kept = ", ".join(f"`{c}` {responses.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64() if n in ("content_length", "n_links") else pa.string() for n in _NAMES]
        for batch in batches:
            for part in chunks(batch, "payload", 1 << 22):
                cols = [part.column(c).to_pylist() for c in _INPUT]
                rows = [r for rid, uri, date, head, body in zip(*cols) for r in derive_one(rid, uri, date, head, body or b"")]
                twice = pa.array([i for i in range(part.num_rows) for _ in range(2)], pa.int64())
                yield pa.record_batch([part.column(c).take(twice) for c in keep]
                                      + [pa.array(list(col), t) for col, t in zip(zip(*rows), types)], names=[*keep, *_NAMES])

    return (responses.select(*keep, *[F.col(c).cast("binary" if c == "payload" else "string").alias(c) for c in _INPUT])
            .mapInArrow(run, f"{kept}, {SCHEMA}" if kept else SCHEMA))


def responses_from_pages(pages: DataFrame, crawl_date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Stored pages as response records with name-based ids: ``page_id`` and the columns ``derive`` reads."""
    body = F.col("html").cast("binary")
    name = F.sha1(F.concat_ws("|", F.lit("response"), F.col("page_id").cast("string"), F.coalesce(F.col("url"), F.lit(""))))
    dashed = F.regexp_replace(F.substring(name, 1, 32), "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-5$3-8$4-$5")
    return pages.select(
        "page_id", F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">")).alias("record_id"), F.col("url").alias("target_uri"),
        F.lit(crawl_date).alias("date"),
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                 F.coalesce(F.octet_length("html"), F.lit(0)).cast("string"), F.lit("\r\n\r\n")).alias("http_header"),
        body.alias("payload"))
