"""WARC derivatives: a metadata and a plain-text conversion record for each response.

Records are rows of RECORD: id, kind, uri, date, content type, the id they refer to, further headers and the block.
A derivative refers to its response, keeps its target address and date, and repeats its payload digest; the metadata
record also holds the response's own WARC and HTTP headers as application/warc-fields, with the title and outgoing
links. Ids of derivatives are name-based UUIDs of response id and kind, so reruns agree. Every block has a SHA-1
digest in base 32, as the format's examples have it. The work is row by row: no shuffle, any number of executors.

file_contents and read_files turn records into the bytes of .warc.gz files and back, one gzip member a record.

Defined results: a null page is an empty payload; a payload that is not text/html, text/plain or application/xhtml+xml
gets no conversion record; a response without HTTP headers counts as a bare payload; repeated rows give repeated
records; records of other kinds are passed over; an empty table gives none. Chunked and compressed payloads are undone for
the text, while digests and lengths are those of the payload as it was sent. A file that is cut gives the records before the
cut, the last one with what is left of its block. A payload of any length is worked on whole.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextloom.llm.htmlblocks import parse
from contextloom.llm.shared import table

RECORD = (
    "record_id string, kind string, target_uri string, warc_date string, content_type string, refers_to string, "
    "payload_digest string, block_digest string, headers array<struct<name: string, value: string>>, block binary"
)
_NAMES = ["record_id", "kind", "target_uri", "warc_date", "content_type", "refers_to", "payload_digest", "block_digest", "headers", "block"]
_PAIRS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
_ARROW = pa.schema([(n, _PAIRS if n == "headers" else pa.binary() if n == "block" else pa.string()) for n in _NAMES])
#: Name-based ids are made within this namespace.
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
TITLE = re.compile(r"<title[^>]*>(.*?)(?:</title|\Z)", re.I | re.S)
LINK = re.compile(r"<a\s(?:[^>]*?\s)?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Size of a chunk in a chunked payload.
CHUNK = re.compile(rb"([0-9a-fA-F]{1,15})[^\r\n]*\r\n")
META_BYTES = 1024
CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, name)}>"


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, header fields, payload) of an HTTP response."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("utf-8", "replace").split("\r\n")
    fields: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and fields:  # a folded line
            fields[-1] = (fields[-1][0], fields[-1][1] + " " + line.strip())
        elif ":" in line:
            name, _, value = line.partition(":")
            fields.append((name.strip(), value.strip()))
    return status, fields, payload


def decode(payload: bytes, content_type: str) -> str:
    """Text in the charset of the header, else of the first META_BYTES of the page, else in UTF-8; unknown ones count as UTF-8."""
    found = CHARSET.search(content_type) or CHARSET.search(payload[:META_BYTES].decode("latin-1"))
    try:
        return payload.decode(found[1] if found else "utf-8", "replace")
    except (LookupError, UnicodeError, ValueError):
        return payload.decode("utf-8", "replace")


def inflate(data: bytes, wbits: int = 31) -> bytes:
    """All members of compressed data, as far as they can be read."""
    out = []
    while data:
        one = zlib.decompressobj(wbits)
        try:
            out.append(one.decompress(data) + one.flush())
        except zlib.error:
            break
        data = one.unused_data
    return b"".join(out)


def entity(payload: bytes, http: list[tuple[str, str]]) -> bytes:
    """The payload without chunks and compression; what does not have the form that its headers name stays as it is."""
    said = {n.lower(): v.lower() for n, v in http}
    if "chunked" in said.get("transfer-encoding", ""):
        parts, at = [], 0
        while m := CHUNK.match(payload, at):
            size = int(m[1], 16)
            parts.append(payload[m.end() : m.end() + size])
            at = m.end() + size + 2
            if not size:
                break
        payload = b"".join(parts) or payload
    coding = said.get("content-encoding", "")
    if "gzip" in coding:
        return inflate(payload) or payload
    if "deflate" in coding:
        return inflate(payload, 15) or inflate(payload, -15) or payload
    return payload


def plain_text(source: str) -> str:
    """All visible text, a line for each block."""
    return "\n".join(b.text for b in parse(source).blocks)


def derive(response: dict) -> Iterator[dict]:
    status, http, payload = split_http(response["block"] or b"")
    kind = next((v for n, v in http if n.lower() == "content-type"), "text/html")
    payload_digest = response["payload_digest"] or digest(payload)
    is_html = "html" in kind.lower()
    is_text = is_html or kind.lower().startswith("text/plain")
    text = decode(entity(payload, http), kind) if is_text else ""

    def record(what: str, content_type: str, block: bytes, more: list[tuple[str, str]]) -> dict:
        headers = [{"name": n, "value": v} for n, v in more]
        return {
            "record_id": record_id(f"{response['record_id']}/{what}"),
            "kind": what,
            "target_uri": response["target_uri"],
            "warc_date": response["warc_date"],
            "content_type": content_type,
            "refers_to": response["record_id"],
            "payload_digest": payload_digest,
            "block_digest": digest(block),
            "headers": headers,
            "block": block,
        }

    fields = [("source-status", status)] if status else []
    fields += [(f"source-warc-{h['name'].lower()}", h["value"]) for h in response["headers"] or []]
    fields += [(f"source-http-{n.lower()}", v) for n, v in http]
    if is_html:
        title = TITLE.search(text)
        if title:
            fields.append(("title", " ".join(html.unescape(title[1]).split())))
        fields += [("outlink", html.unescape(m[1] or m[2] or m[3] or "").strip()) for m in LINK.finditer(text)]
    fields.append(("payload-length", str(len(payload))))
    block = "".join(f"{n}: {' '.join(v.split())}\r\n" for n, v in fields).encode()
    yield record("metadata", "application/warc-fields", block, [])
    if is_text:
        made = plain_text(text) if is_html else text
        yield record("conversion", "text/plain; charset=utf-8", made.encode(), [("Source-Content-Type", kind)])


def _derive_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = 256
        for at in range(0, batch.num_rows, step):
            rows = [x for response in batch.slice(at, step).to_pylist() for x in derive(response)]
            yield from pa.Table.from_pylist(rows, schema=_ARROW).to_batches()


def responses_of(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table of pages that was kept without its headers."""
    body = F.encode(F.coalesce(F.col(source), F.lit("")), "UTF-8")
    length = F.octet_length(body).cast("string")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length, F.lit("\r\n\r\n"))
    name = F.concat_ws("/", F.lit("response"), F.coalesce(F.col(page_id).cast("string"), F.lit("")), F.coalesce(F.col(url), F.lit("")))
    hexed = F.sha1(name.cast("binary"))
    dashed = F.concat_ws("-", *(F.substring(hexed, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    none = F.lit(None).cast("string")
    return pages.select(
        F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">")).alias("record_id"),
        F.lit("response").alias("kind"),
        F.col(url).alias("target_uri"),
        F.lit(date).alias("warc_date"),
        F.lit("application/http; msgtype=response").alias("content_type"),
        none.alias("refers_to"),
        none.alias("payload_digest"),
        none.alias("block_digest"),
        F.array(F.struct(F.lit("Identified-Payload-Type").alias("name"), F.lit("text/html").alias("value"))).alias("headers"),
        F.concat(F.encode(head, "UTF-8"), body).alias("block"),
    )


def derivatives(records: DataFrame) -> DataFrame:
    """RECORD rows: the metadata and conversion records of the response records."""
    return records.where("kind = 'response'").select(*_NAMES).mapInArrow(_derive_all, RECORD)


def to_bytes(record: dict) -> bytes:
    """One record in WARC/1.1."""
    fields = [("WARC-Type", record["kind"]), ("WARC-Record-ID", record["record_id"]), ("WARC-Date", record["warc_date"])]
    fields += [(n, record[k]) for n, k in (("WARC-Target-URI", "target_uri"), ("WARC-Refers-To", "refers_to"), ("WARC-Payload-Digest", "payload_digest"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type")) if record[k] is not None]
    fields += [(h["name"], h["value"]) for h in record["headers"] or []]
    block = bytes(record["block"] or b"")
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{n}: {v}\r\n" for n, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def from_bytes(data: bytes) -> Iterator[dict]:
    """Records of a WARC file's contents, whether compressed or not."""
    if data[:2] == b"\x1f\x8b":
        data = inflate(data)
    known = {"warc-type": "kind", "warc-record-id": "record_id", "warc-date": "warc_date", "warc-target-uri": "target_uri", "warc-refers-to": "refers_to", "warc-payload-digest": "payload_digest", "warc-block-digest": "block_digest", "content-type": "content_type"}
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0:  # cut within its header
            return
        record: dict = dict.fromkeys(_NAMES) | {"headers": []}
        size = 0
        for line in data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            name, value = name.strip(), value.strip()
            if name.lower() == "content-length":
                size = int(value) if value.isdigit() else 0
            elif name.lower() in known:
                record[known[name.lower()]] = value
            else:
                record["headers"].append({"name": name, "value": value})
        record["block"] = data[stop + 4 : stop + 4 + size]
        at = stop + 4 + size
        yield record


def _file_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        members = [gzip.compress(to_bytes(r), mtime=0) for r in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], names=["content"])


def file_contents(records: DataFrame) -> DataFrame:
    """(content): the bytes of one .warc.gz file for each Arrow batch of records, for a binary sink to store."""
    return records.select(*_NAMES).mapInArrow(_file_of, "content binary")


def read_files(files: DataFrame, content: str = "content") -> DataFrame:
    """RECORD rows of the WARC files in a binary column, as spark.read.format("binaryFile") gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                found = from_bytes(data.as_py() or b"")
                while some := list(itertools.islice(found, 256)):
                    yield from pa.Table.from_pylist(some, schema=_ARROW).to_batches()

    return files.select(F.col(content).alias("content")).mapInArrow(run, RECORD)


def op2_derivatives(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = derivatives(responses_of(pages))
    return out.select("record_id", "kind", "target_uri", "warc_date", "content_type", "refers_to", "payload_digest", "block_digest", "headers", F.decode("block", "UTF-8").alias("block"), F.octet_length("block").cast("long").alias("content_length"))
