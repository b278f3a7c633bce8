"""WARC derivatives: from response records, linked metadata and plain-text conversion records.

Both refer to their response by record id, target URI and date; the metadata record keeps the source's HTTP headers, and
every record carries the digests of its block, and of the payload it was made from.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common

Headers = list[tuple[str, str]]
VERSION = "WARC/1.1"
#: Date of responses that are made from pages, which have none.
DATE = "2024-01-01T00:00:00Z"
_SKIPPED = re.compile(r"<!--|<(script|style|noscript|template)\b", re.I)
_END = {x: re.compile(rf"</{x}\s*+>", re.I) for x in ("script", "style", "noscript", "template")}
_BREAK = re.compile(r"<(?:br|hr|/?(?:p|div|h[1-6]|li|ul|ol|tr|table|section|article|header|footer|nav|main|aside|pre|blockquote|title|head|body|dl|dt|dd|form))\b[^<>]*>", re.I)
_TAG = re.compile(r"""<[/!?a-z](?:[^<>"']|"[^"<]*"|'[^'<]*')*+>|<[/!?a-z][^<>]*>""", re.I)
_TITLE, _TITLE_END = re.compile(r"<title\b", re.I), re.compile(r"</title", re.I)
_HTML, _LANG = re.compile(r"<html\b", re.I), re.compile(r"""\blang\s*+=\s*+["']?([A-Za-z0-9-]+)""", re.I)
_ANCHOR, _HREF = re.compile(r"<a\b", re.I), re.compile(r"\bhref\s*+=\s*+", re.I)
_BARE = re.compile(r"""[^\s"'>]+""")
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_BLANK = re.compile(r"[^\S\n]+")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """The same id for the same parts, so that a rerun links as before."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(chr(0).join(parts).encode()).digest()[:16], version=5)}>"


def header(headers: Headers, name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def serialise(headers: Headers, block: bytes) -> bytes:
    return (VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n").encode() + block + b"\r\n\r\n"


def _inflated(data: bytes) -> Iterator[bytes]:
    """The bytes of gzip members, piece by piece."""
    view, at, step = memoryview(data), 0, 1 << 16
    while bytes(view[at : at + 2]) == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        while not member.eof and at < len(data):
            piece = view[at : at + step]
            yield member.decompress(piece)
            at += len(piece) - len(member.unused_data)
        yield member.flush()


def parse(data: bytes) -> Iterator[tuple[Headers, bytes]]:
    """The records of a WARC file, plain or gzipped as a whole or by record. A torn last record raises ValueError.

    A gzipped file is held as it is; of what it inflates to, one record and a piece of the next.
    """
    more = _inflated(data) if data[:2] == b"\x1f\x8b" else iter([data])
    held, passed = bytearray(next(more, b"")), 0

    def fill(until) -> int:
        """until(place from which to look) once it is no longer negative; -1 at the end of the data."""
        seen = 0
        while (found := until(seen)) < 0:
            seen = max(0, len(held) - 3)
            piece = next(more, None)
            if piece is None:
                return -1
            held.extend(piece)
        return found

    while True:
        fill(lambda _: 0 if len(held) > 1 else -1)
        if held[:2] == b"\x1f\x8b":  # gzipped twice
            yield from parse(bytes(held) + b"".join(more))
            return
        if held[:2] == b"\r\n":
            del held[:2]
            passed += 2
            continue
        if not held:
            return
        end = fill(lambda seen: held.find(b"\r\n\r\n", seen))
        first, *lines = bytes(held[: max(end, 0)]).decode("utf-8", "replace").split("\r\n")
        if end < 0 or not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {passed}")
        headers: Headers = []
        for line in lines:
            if line[:1] in (" ", "\t") and headers:
                headers[-1] = (headers[-1][0], headers[-1][1] + " " + line.strip())
            else:
                k, _, v = line.partition(":")
                headers.append((k.strip(), v.strip()))
        to = end + 4 + int(header(headers, "Content-Length") or 0)
        if fill(lambda _: 0 if len(held) >= to else -1) < 0:
            raise ValueError(f"the record at byte {passed} is torn")
        yield headers, bytes(held[end + 4 : to])
        del held[:to]
        passed += to


def response_of(url: str | None, page: str | None, date: str = DATE) -> tuple[Headers, bytes]:
    """A response record for a page as it was fetched; a null page has an empty payload, a null url no target. White space and control characters of the
    url are percent-encoded, as a header's line can't hold them."""
    url = None if url is None else _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)
    payload = (page or "").encode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", url or "", date, digest(payload))), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", url))
    headers += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    return headers, block


def _without_skipped(page: str) -> str:
    """Comments, scripts and styles as a space each; one that isn't closed reaches to the end. Each place is looked at a bounded number of times: what is
    not found ahead of one place isn't looked for again from a later one."""
    out, at, look = [], 0, 0
    while m := _SKIPPED.search(page, look):
        if m[1] is None:
            end = page.find("-->", m.end())
            to = end + 3 if end >= 0 else len(page)
        else:
            opened = page.find(">", m.end())
            if opened < 0:  # no tag ends from here on; comments alone may follow
                look = page.find("<!--", m.end())
                if look < 0:
                    break
                continue
            closed = _END[m[1].lower()].search(page, opened + 1)
            to = closed.end() if closed else len(page)
        out += [page[at : m.start()], " "]
        at = look = to
    return "".join([*out, page[at:]])


def plain_text(page: str) -> str:
    """What a reader sees: without scripts, styles and comments; a line for each block, single spaces, entities resolved."""
    text = _TAG.sub("", _BREAK.sub("\n", _without_skipped(page)))
    text = _BLANK.sub(" ", html.unescape(text).replace("\r", "\n"))
    return "\n".join(x for line in text.split("\n") if (x := line.strip()))


def title_of(page: str) -> str | None:
    """What stands in the first title. If that isn't closed, no later one is."""
    if (m := _TITLE.search(page)) and (a := page.find(">", m.end())) >= 0 and (end := _TITLE_END.search(page, a + 1)):
        return page[a + 1 : end.start()]
    return None


def language_of(page: str) -> str | None:
    """The lang attribute of the first html tag that has one."""
    at = 0
    while m := _HTML.search(page, at):
        end = page.find(">", m.end())
        end = len(page) if end < 0 else end
        if found := _LANG.search(page, m.end(), end):
            return found[1]
        at = end  # a tag that begins before this end has fewer attributes
    return None


def links_of(page: str) -> list[str]:
    """The targets of all anchors, in order."""
    out, at, unclosed = [], 0, set()
    while m := _ANCHOR.search(page, at):
        end = page.find(">", m.end())
        end, at = (len(page), len(page)) if end < 0 else (end, end)
        for href in _HREF.finditer(page, m.end(), end):
            a = href.end()
            quote = page[a : a + 1]
            if quote in ('"', "'"):
                b = -1 if quote in unclosed else page.find(quote, a + 1)
                if b < 0:
                    unclosed.add(quote)
                    continue
                out.append(page[a + 1 : b])
                at = b + 1
            elif bare := _BARE.match(page, a):
                out.append(bare[0])
                at = bare.end()
            else:
                continue
            break
    return out


def _split_http(block: bytes) -> tuple[str, Headers, bytes]:
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split("\r\n")
    return status, [(" ".join(k.split()), " ".join(v.split())) for k, _, v in (x.partition(":") for x in lines)], payload


def _charset(http: Headers) -> str:
    found = re.search(r"charset=[\"']?([\w-]+)", header(http, "Content-Type") or "", re.I)
    try:
        return codecs.lookup(found[1]).name if found else "utf-8"
    except LookupError:
        return "utf-8"


def derive(headers: Headers, block: bytes) -> list[tuple[Headers, bytes]]:
    """The metadata and the conversion record of a response record; other records have none.

    Only text payloads are converted; of others there is a metadata record alone.
    """
    if header(headers, "WARC-Type") != "response":
        return []
    status, http, payload = _split_http(block)
    source, uri, date = (header(headers, k) for k in ("WARC-Record-ID", "WARC-Target-URI", "WARC-Date"))
    kind = header(http, "Content-Type") or "text/html"
    page = payload.decode(_charset(http), "replace") if kind.lower().startswith("text/") else None
    linked = [("WARC-Refers-To", source or "")] + ([("WARC-Refers-To-Target-URI", uri)] if uri is not None else []) + ([("WARC-Refers-To-Date", date)] if date else [])
    whole = header(headers, "WARC-Payload-Digest") or digest(payload)

    def record(name: str, content_type: str, data: bytes) -> tuple[Headers, bytes]:
        own = [("WARC-Type", name), ("WARC-Record-ID", record_id(name, source or "")), ("WARC-Date", date or DATE)]
        own += [("WARC-Target-URI", uri)] if uri is not None else []
        own += [*linked, ("WARC-Source-Payload-Digest", whole), ("Content-Type", content_type), ("WARC-Block-Digest", digest(data)), ("Content-Length", str(len(data)))]
        return own, data

    fields = [("http-status", status), *((f"http-header-{k}", v) for k, v in http), ("payload-length", str(len(payload)))]
    if page is not None:
        if (title := title_of(page)) is not None:
            fields.append(("title", " ".join(html.unescape(title).split())))
        if lang := language_of(page):
            fields.append(("language", lang))
        fields += [("outlink", " ".join(html.unescape(x).split())) for x in links_of(page)]
    out = [record("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields).encode())]
    if page is not None:
        text = plain_text(page) if "html" in kind.lower() else page
        out.append(record("conversion", "text/plain; charset=utf-8", text.encode()))
    return out


ROW = "record_type string, record_id string, refers_to string, target_uri string, source_digest string, block_digest string, content_length long, headers string, block string"


def _row(headers: Headers, block: bytes) -> tuple:
    get = lambda k: header(headers, k)
    return (get("WARC-Type"), get("WARC-Record-ID"), get("WARC-Refers-To"), get("WARC-Target-URI"), get("WARC-Source-Payload-Digest"), get("WARC-Block-Digest"), len(block), "".join(f"{k}: {v}\r\n" for k, v in headers), block.decode("utf-8", "replace"))


def derivatives(pages: DataFrame) -> DataFrame:
    """For each row of pages (page_id, url, html), its metadata and conversion records as rows with page_id.

    Null html: an empty payload, so an empty conversion. Null url: records without a target. Repeated rows give repeated
    records with equal ids. Other columns play no part. A long page is read whole, in time that grows with its length. Empty table: empty result.
    """

    def run(batches):
        for part in common.slices(batches, "html"):
            rows, ids = [], []
            for page_id, url, page in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                for made in derive(*response_of(url, page)):
                    rows.append(_row(*made))
                    ids.append(page_id)
            columns = list(zip(*rows)) if rows else [[] for _ in ROW.split(", ")]
            names = [x.split(" ")[0] for x in ROW.split(", ")]
            yield pa.RecordBatch.from_pydict({"page_id": pa.array(ids, pa.int64())} | {n: pa.array(c, pa.int64() if n == "content_length" else pa.string()) for n, c in zip(names, columns)})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, " + ROW)


def records(files: DataFrame) -> DataFrame:
    """The derivative records of WARC files, as read by Spark's binaryFile source (columns path, content)."""

    def run(batches):
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                made = [x for got in parse(content) for x in derive(*got)]
                yield pa.RecordBatch.from_pydict({"path": pa.array([path] * len(made), pa.string()), "record": pa.array([serialise(*x) for x in made], pa.binary())})

    return files.select("path", "content").mapInArrow(run, "path string, record binary")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(common.table(spark, sf_dir, "pages"))


QUERIES = {"op7_warc_derivatives": op7}
