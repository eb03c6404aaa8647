"""WARC derivatives: link a metadata and a plain-text conversion record to each response record.

A response record is a table row: record_id, target_uri, date, http (status line and headers) and payload. Each
gives one metadata record (source headers, payload digest and sizes as `application/warc-fields`) and one
conversion record (the payload's text), both with WARC-Refers-To set to the response and the digests kept. A
record's header and block are ready to be written one after another.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE_FOR_IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of RFC 4122
HIDDEN = re.compile(r"<!--.*?(?P<end>-->|\Z)|<(script|style|template|noscript)\b[^>]*>.*?(?P<close></\2\s*>|\Z)", re.S | re.I)
BREAK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|caption|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*>", re.I)
TAG = re.compile(r"<(?:[!?/]|[a-zA-Z])[^>]*>?")
COLUMNS = "record_id string, type string, refers_to string, target_uri string, date string, content_type string, block_digest string, source_digest string, content_length long, header string, block binary"


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def visible(page: str) -> str:
    """The page without comments, scripts and the like. One that isn't closed hides the rest.

    Behind the last `>` nothing closes, and no element starts: patterns aren't tried there, where each try would read on to
    the end of the page.
    """
    at = page.rfind(">") + 1
    left_open = False

    def gone(found: re.Match) -> str:
        nonlocal left_open
        left_open = not (found["end"] or found["close"])
        return ""

    shown = HIDDEN.sub(gone, page[:at])
    return shown if left_open else shown + page[at:].partition("<!--")[0]


def breaks(page: str) -> str:
    """Tags of blocks as line feeds; all of them end before the last `>`."""
    at = page.rfind(">") + 1
    return BREAK.sub("\n", page[:at]) + page[at:]


def plain_text(page: str) -> str:
    """All visible text: one line per block, runs of white space as one space."""
    bare = TAG.sub("", breaks(visible(page).replace("\n", " ")))
    return "\n".join(line for x in html.unescape(bare).split("\n") if (line := " ".join(x.split())))


def uuid5(name: Column) -> Column:
    """A version 5 UUID (SHA-1 of the namespace and a name) as a URN."""
    h = F.sha1(F.concat(F.lit(SPACE_FOR_IDS.bytes), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    parts = F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table of pages, each taken for a 200 response of UTF-8 HTML at `date`.

    Null html is an empty payload; null url an empty target. The identifier is a version 5 UUID of page_id, url and the
    payload's SHA-1, so a rerun gives the same records; rows that are repeated whole are one record.
    """
    html, url = F.coalesce(F.col("html").cast("string"), F.lit("")), F.coalesce(F.col("url").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("target_uri"), F.encode(html, "UTF-8").alias("payload"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload"), F.lit("\r\n\r\n"))
    name = F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("None")), "target_uri", F.sha1("payload"))
    return rows.select("page_id", uuid5(name).alias("record_id"), "target_uri", F.lit(date).alias("date"), F.encode(http, "UTF-8").alias("http"), "payload")


def derive(records: DataFrame) -> DataFrame:
    """Two records for each response: page_id and COLUMNS.

    Null payload counts as empty, null headers as none. Repeated responses give repeated records. An empty table gives
    an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page_id, record_id, uri, date, http, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                http, payload = http or b"", payload or b""
                source = digest(payload)
                status, *fields = http.decode("latin-1").split("\r\n")
                meta = [f"source-record: {record_id}", f"source-payload-digest: {source}", f"source-block-digest: {digest(http + payload)}", f"source-payload-length: {len(payload)}"]
                meta += [f"http-status: {status}"] * bool(status) + [f"http-header: {x}" for x in fields if x]
                text = plain_text(payload.decode("utf-8", "replace")).encode()
                for kind, content, block in (("metadata", "application/warc-fields", "".join(x + "\r\n" for x in meta).encode("utf-8", "replace")), ("conversion", "text/plain; charset=utf-8", text)):
                    own = f"<urn:uuid:{uuid.uuid5(SPACE_FOR_IDS, f'{record_id} {kind}')}>"
                    row = (own, kind, record_id, uri, date, content, digest(block), source, len(block))
                    out.append((page_id, *row, head(*row), block))
            columns = list(zip(*out, strict=True)) or [[]] * 12
            kinds = [pa.int64(), *[pa.string()] * 8, pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["page_id", *(x.split()[0] for x in COLUMNS.split(", "))])

    return records.select("page_id", "record_id", "target_uri", "date", "http", "payload").mapInArrow(run, f"page_id long, {COLUMNS}")


def head(record_id: str, kind: str, refers_to: str, uri: str, date: str, content: str, block_digest: str, source_digest: str, length: int) -> str:
    """The WARC/1.1 header of a derived record, to go before its block. The payload digest is the source's, which it refers to."""
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_id,
        "WARC-Refers-To": refers_to,
        "WARC-Target-URI": re.sub(r"[\r\n]+", " ", uri),
        "WARC-Date": date,
        "WARC-Block-Digest": block_digest,
        "WARC-Payload-Digest": source_digest,
        "Content-Type": content,
        "Content-Length": length,
    }
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"


def serialised(derived: DataFrame) -> DataFrame:
    """page_id, type and the whole bytes of each record, ready to be written one after another."""
    return derived.select("page_id", "type", F.concat(F.encode("header", "UTF-8"), "block", F.lit(b"\r\n\r\n")).alias("record"))
