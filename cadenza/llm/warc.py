"""WARC derivative builder: metadata and plain-text conversion records for responses.

Records are rows; their header lines are kept in order as an array of (name, value). A conversion record holds the text of a
response's HTML, a metadata record what its HTTP headers and page say; both point to the response by WARC-Refers-To, carry
its target, date and payload digest, and digest their own block. Files of records are written and read with Spark's own text
and binary sources, so any store that Spark reads will do.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import table

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
RECORD = "record_id string, type string, refers_to string, target_uri string, date string, headers array<struct<name:string,value:string>>, block binary, payload_digest string, block_digest string"
_HEADERS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
_SCHEMA = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("headers", _HEADERS), ("block", pa.binary()), ("payload_digest", pa.string()), ("block_digest", pa.string())])

# Elements that hold no text of the page, elements that end a line, and elements that may stand in a head.
HIDDEN = {"script", "style", "noscript", "template"}
LINES = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "header", "footer", "nav", "blockquote", "pre", "hr", "dt", "dd", "title"}
IN_HEAD = {"base", "basefont", "bgsound", "link", "meta"}
_WHOLE = HIDDEN | {"title", "noframes"}  # in a head, they go with all they hold
# A tag with its quoted values; possessive, so that a tag that never ends is read once.
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|["'=])*+)>""")
_ENDS = {e: re.compile(rf"</{e}(?=[\s/>])[^>]*>?", re.I) for e in _WHOLE}
_LANG = re.compile(r"""(?:^|[\s"'/])lang\s*=\s*["']?([\w-]+)""", re.I)


def parsed(page: str) -> tuple[str, str | None, str | None]:
    """Visible text of HTML, title and language of the page.

    Comments, scripts, styles and the head go, block elements end lines, other tags vanish, entities are decoded, runs of blanks
    are one space, and empty lines go. Tags are read as the HTML standard does: a quoted value may hold >; a < before anything but
    a letter, /, ! or ? is text; a tag, comment or hidden element that the page's end cuts off hides the rest. A head ends at its
    end tag or before the first thing that can't stand in one. Time and memory are in proportion to the page."""
    out, at, n, in_head, title, lang = [], 0, len(page), False, None, None
    while at < n:
        lt = page.find("<", at)
        if lt < 0 or in_head and page[at:lt].strip():
            in_head = False
        if not in_head:
            out.append(page[at : lt if lt >= 0 else n])
        if lt < 0:
            break
        if page.startswith("<!--", lt):
            end = lt + 5 if page.startswith(">", lt + 4) else page.find("-->", lt + 4) + 3
            at = end if end > lt + 4 else n
            out.append(" ")
            continue
        tag = _TAG.match(page, lt)
        if tag is None:
            after = page[lt + 1 : lt + 2]
            if after in ("!", "?") or after == "/" and lt + 2 < n:
                close = page.find(">", lt)
                if after == "/" and page[lt + 2].isascii() and page[lt + 2].isalpha():
                    close = -1  # an end tag that the page's end cuts off
                at = close + 1 if close >= 0 else n
            elif after.isascii() and after.isalpha():
                at = n
            else:
                if in_head:
                    in_head = False
                out.append("<")
                at = lt + 1
            continue
        ends, name, at = tag[1], tag[2].lower(), tag.end()
        if name == "html" and not ends and lang is None:
            found = _LANG.search(tag[3])
            lang = found[1] if found else None
        if name == "head":
            in_head = not ends
            out.append(" ")
            continue
        if in_head and not (name in IN_HEAD or name in _WHOLE or ends and name not in ("body", "html", "br")):
            in_head = False
        if not ends and (name in HIDDEN or name == "title" or in_head and name in _WHOLE):
            close = _ENDS[name].search(page, at)
            held = page[at : close.start() if close else n]
            if name == "title" and title is None:
                title = " ".join(html.unescape(held).split())
            if name == "title" and not in_head:
                out += ["\n", held, "\n"]
            else:
                out.append(" ")
            at = close.end() if close else n
        elif not in_head and name in LINES:
            out.append("\n")
    lines = (" ".join(x.split()) for x in html.unescape("".join(out)).split("\n"))
    return "\n".join(x for x in lines if x), title, lang


def plain_text(page: str) -> str:
    """The visible text of HTML, as `parsed` reads it."""
    return parsed(page)[0]


# Codecs of Python that no charset names.
_NO_CHARSET = {"undefined", "idna", "punycode", "unicode_escape", "raw_unicode_escape", "unicode-escape", "raw-unicode-escape"}


def decoded(body: bytes, content_type: str) -> str:
    """A body as text in the charset that its content type names, or UTF-8 where it names none that there is. What can't be decoded
    becomes U+FFFD."""
    found = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", content_type, re.I)
    name = found[1].lower() if found else "utf-8"
    try:
        text = body.decode("utf-8" if name in _NO_CHARSET else name, "replace")
    except (LookupError, ValueError):
        text = body.decode("utf-8", "replace")
    return text.encode("utf-8", "replace").decode()  # some codecs let half surrogates through


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*of: str) -> str:
    """A name-based id: the same record has the same id in every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(31).join(of))}>"


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """A response record for each row of pages (page_id, url, html): an HTTP 200 answer with the page as UTF-8. Null url or
    html is an empty one. Repeated rows have the same id. Other columns are ignored."""
    own = pages.select(F.col("page_id").cast("string").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                body = r["html"].encode()
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
                rows.append(_record("response", r["url"], date, block, "application/http;msgtype=response", record_id("response", r["page_id"] or "", r["url"], digest(body)), payload=digest(body)))
            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return own.mapInArrow(run, RECORD)


def _record(kind: str, uri: str, date: str, block: bytes, content: str, rid: str, refers: str | None = None, payload: str | None = None, more: tuple = ()) -> dict:
    own = digest(block)
    head = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", date), ("WARC-Target-URI", uri)]
    head += [("WARC-Refers-To", refers)] if refers else []
    head += [("WARC-Payload-Digest", payload)] if payload else []
    head += [("WARC-Block-Digest", own), *more, ("Content-Type", content), ("Content-Length", str(len(block)))]
    return {"record_id": rid, "type": kind, "refers_to": refers, "target_uri": uri, "date": date, "headers": [{"name": n, "value": v} for n, v in head], "block": block, "payload_digest": payload, "block_digest": own}


def _http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("utf-8", "replace").split("\r\n")
    return status, [(n.strip(), v.strip()) for n, _, v in (x.partition(":") for x in lines)], body


# Headers that a derived record has of its own.
OWN = {"warc-type", "warc-record-id", "warc-date", "warc-target-uri", "warc-refers-to", "warc-payload-digest", "warc-block-digest", "content-type", "content-length"}


def agrees(claim: str | None, body: bytes) -> str:
    """Whether a digest, of any algorithm known here, in base 32 or 16, is the body's; true where none is claimed."""
    if claim is None:
        return "true"
    name, _, value = claim.strip().partition(":")
    try:
        own = hashlib.new(name.lower().replace("-", ""), body).digest()
    except (ValueError, TypeError):
        return "unknown"
    return str(value.upper().rstrip("=") in (base64.b32encode(own).decode().rstrip("="), own.hex().upper())).lower()


def _line(value: str | None) -> str:
    """A header's value on one line."""
    return " ".join(re.split(r"[\r\n]+", value or ""))


def derived(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response among records; other types are passed over, a null type too.

    The metadata record lists the HTTP status and headers as they came, the payload's digest as found and whether it agrees
    with the one that the response claims, and title and language of the page. The conversion record holds the page's text as
    UTF-8. The response's WARC headers come along, but those that a record has of its own; a claimed payload digest other than
    the one found is WARC-Source-Payload-Digest. One pass, no shuffle, one page at a time.

    A response without a block or body (null or empty) has an empty conversion; null ids and targets are empty ones and a null
    date is DATE. Long pages are read whole. A repeated response has its derivatives repeated, under the same ids. Columns
    beyond a record's are ignored; an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                status, head, body = _http(r["block"] or b"")
                text, title, lang = parsed(decoded(body, next((v for n, v in head if n.lower() == "content-type"), "")))
                found, claims = digest(body), r["payload_digest"]
                differs = claims not in (None, found)
                fields = [("http-status", status), *((f"http-{n.lower()}", v) for n, v in head), ("payload-digest", found), ("payload-digest-agrees", agrees(claims, body))]
                fields += [("payload-digest-claimed", claims)] if differs else []
                fields += [("title", title)] if title is not None else []
                fields += [("language", lang)] if lang else []
                block = "".join(f"{_line(n)}: {_line(v)}\r\n" for n, v in fields).encode()
                rid, uri, date = r["record_id"] or "", r["target_uri"] or "", r["date"] or DATE
                source = tuple((h["name"], _line(h["value"])) for h in r["headers"] or () if h and (h["name"] or "").lower() not in OWN | {""})
                source += (("WARC-Source-Payload-Digest", claims),) if differs else ()
                rows.append(_record("metadata", uri, date, block, "application/warc-fields", record_id("metadata", rid), rid, found, source))
                named = any(n.lower() == "warc-identified-content-language" for n, _ in source)
                language = (("WARC-Identified-Content-Language", lang),) if lang and not named else ()
                rows.append(_record("conversion", uri, date, text.encode(), "text/plain;charset=utf-8", record_id("conversion", rid), rid, found, (*source, *language)))
            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    own = records.where("type = 'response'").select("block", "headers", "payload_digest", "record_id", "target_uri", "date")
    return own.mapInArrow(run, RECORD)


def serialised(headers: str = "headers", block: str = "block") -> Column:
    """A record's bytes: version line, header lines, empty line, block, and two line ends."""
    head = F.array_join(F.transform(headers, lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\r\n")
    return F.concat(F.encode(F.concat(F.lit(f"{VERSION}\r\n"), head, F.lit("\r\n\r\n")), "UTF-8"), F.col(block), F.lit(b"\r\n\r\n"))


#: A gzip member of less ends in a zero byte, which is the line end that Spark's text writer is given.
MEMBER = (1 << 24) - 1


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for x in b["value"]:
            raw = x.as_py()
            made = b""
            for i in range(0, len(raw), MEMBER):
                z = zlib.compressobj(wbits=31)
                made += z.compress(raw[i : i + MEMBER]) + z.flush()
            rows.append(made[:-1])
        yield pa.RecordBatch.from_pydict({"value": pa.array(rows, pa.binary())})


def write_records(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """One file of records a partition at path: with gzip a member for each record (one for each 16 MB of a larger one), so that
    a reader can start at any record's offset; or plain ("none"). Blocks may be any bytes."""
    whole = records.select(serialised().alias("value"))
    if compression == "gzip":
        out, end = whole.mapInArrow(_members, "value binary"), "\0"
    else:  # the record's last byte is the writer's line end
        out, end = whole.select(F.expr("substring(value, 1, octet_length(value) - 1)").alias("value")), "\n"
    out.select(F.col("value").cast("string")).write.option("lineSep", end).option("compression", "none").mode("overwrite").text(path)


def _row(raw: bytes, end: int, size: int, head: list[tuple[str, str]]) -> dict:
    get = {n.lower(): v for n, v in head}
    return {
        "record_id": get.get("warc-record-id"), "type": get.get("warc-type"), "refers_to": get.get("warc-refers-to"), "target_uri": get.get("warc-target-uri"), "date": get.get("warc-date"),
        "headers": [{"name": n, "value": v} for n, v in head], "block": raw[end + 4 : end + 4 + size], "payload_digest": get.get("warc-payload-digest"), "block_digest": get.get("warc-block-digest"),
    }


def parse(chunks: Iterable[bytes]) -> Iterator[dict]:
    """The records of a file that comes in chunks of any size. What is held is one record and one chunk. A record that the end
    of the file cuts off has the block that there is; one without a readable length has none."""
    held, chunks, more = bytearray(), iter(chunks), True

    def fill() -> bool:
        nonlocal more
        x = next(chunks, None)
        more = x is not None
        held.extend(x or b"")
        return more

    while True:
        at = held.find(b"WARC/")
        while at < 0 and more:
            del held[:-4]
            fill()
            at = held.find(b"WARC/")
        if at < 0:
            return
        del held[:at]
        seen = 0
        while (end := held.find(b"\r\n\r\n", seen)) < 0 and more:
            seen = max(0, len(held) - 3)
            fill()
        if end < 0:
            return
        head = [(n.strip(), v.strip()) for n, _, v in (x.partition(":") for x in held[:end].decode("utf-8", "replace").split("\r\n")[1:])]
        size = next((v for n, v in head if n.lower() == "content-length"), "")
        size = int(size) if size.isascii() and size.isdigit() else 0
        while len(held) < end + 4 + size and more:
            fill()
        yield _row(bytes(held[: end + 4 + size]), end, size, head)
        del held[: end + 4 + size]


def _inflated(raw: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """A file's bytes in chunks: gzip members one after the other, zeros between them passed over, or the file as it is."""
    if raw[:2] != b"\x1f\x8b":
        yield from (raw[i : i + step] for i in range(0, len(raw), step))
        return
    view, at = memoryview(raw), 0
    while at < len(raw):
        z = zlib.decompressobj(wbits=31)
        left = view[at : at + step]
        at += len(left)
        while not z.eof:
            if x := z.decompress(left, step):
                yield x
            left = z.unconsumed_tail
            if not left and not z.eof:
                if at >= len(raw):
                    return  # cut off
                left = view[at : at + step]
                at += len(left)
        at -= len(z.unused_data)
        while at < len(raw) and raw[at] == 0:
            at += 1


def _batched(rows: Iterator[dict], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r["block"])
        if size >= most or len(held) >= 1000:
            yield pa.RecordBatch.from_pylist(held, _SCHEMA)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, _SCHEMA)


def read_records(spark, path: str) -> DataFrame:
    """The records of the files at path, plain or gzipped (one member or one a record), whatever their names. A file is read by
    one task, which holds the file as stored (2 GB at most, the limit of Spark's binary source), one record and one batch.
    Files of .warc.gz of any size are read by `stream_records`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b["content"]:
                yield from _batched(parse(_inflated(x.as_py())))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def stream_records(spark, path: str) -> DataFrame:
    """The records of the gzipped files at path, whose names end in .gz. Spark inflates them as it reads, in pieces that end where
    "WARC/1." stands; pieces that a record's block goes on over are joined again by its length. A task holds a record and
    one Arrow batch of pieces, whatever the file's size."""
    pieces = spark.read.option("lineSep", "WARC/1.").text(path).select(F.col("value").cast("binary").alias("piece"), "_metadata.file_path")

    def chunks(rows: Iterator[tuple[str, bytes]], first: list) -> Iterator[bytes]:
        """What is left of the file that first is of; the next file's first piece is put there in turn."""
        name, piece = first.pop()
        yield piece
        for of, piece in rows:
            if of != name:
                first.append((of, piece))
                return
            yield b"WARC/1." + piece

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((f.as_py(), p.as_py()) for b in batches for f, p in zip(b["file_path"], b["piece"], strict=True))
        first = [x for x in (next(rows, None),) if x]
        while first:
            yield from _batched(parse(chunks(rows, first)))

    return pieces.mapInArrow(run, RECORD)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page's response, with their bytes as text."""
    out = derived(responses(table(spark, sf_dir, "pages")))
    return out.select("record_id", "type", "refers_to", "target_uri", "date", "payload_digest", "block_digest", F.octet_length("block").cast("long").alias("block_bytes"), F.decode(serialised(), "UTF-8").alias("record"))
