"""Metadata and plain-text derivatives of WARC response records.

A record is a row (warc_type, record_id, refers_to, target_uri, date, headers, block). Each
response gives

* a ``metadata`` record: JSON with the source record's WARC headers, the HTTP status and
  headers, title, metas and links of an HTML page, length and digest of the payload;
* a ``conversion`` record with the text, for HTML and plain text.

Both name the response in WARC-Refers-To, with its target and date beside, and keep its
target and date. Record ids are made from the response's id, so a second run gives the same
records; responses that repeat give records that repeat, ids included. Digests are SHA-1 in base
32. Records are written one gzip member each, after a warcinfo record, in one file a task;
a task writes under a name of its own and renames the file when it is whole.

Nulls: a null target is left out of the headers, a null date is the time of the derivation
(a parameter), a null block is empty, a response
without an id gets one from its target and block. Malformed HTTP blocks are payload from
their first byte. Responses that repeat give the same records again. An empty table gives
no files.
"""

from __future__ import annotations

import gzip
import hashlib
import html
import json
import re
import uuid
import zlib
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.llm.scratch import keep, plain
from vigilog.llm.words import slices
from vigilog.session import ship_package

RECORD = (
    "warc_type string, record_id string, refers_to string, target_uri string, date string, "
    "headers map<string,string>, block binary"
)
_RECORD_ARROW = pa.schema(
    [(n, pa.string()) for n in ("warc_type", "record_id", "refers_to", "target_uri", "date")]
    + [("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())]
)
GZIP_LEVEL = 4
_PART = 4 << 20

_UNSEEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I
)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_BREAK = re.compile(
    r"</?(?:address|article|aside|blockquote|body|br|center|dd|div|dl|dt|fieldset|figcaption|figure|footer|"
    r"form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|select|table|tbody|td|tfoot|th|"
    r"thead|title|tr|ul)\b[^<>]*>",
    re.I,
)
_TAG = re.compile(r"<[a-zA-Z/!?][^<>]*>")
_BLANKS = re.compile(r"[^\S\n]+")
_TITLE = re.compile(r"<title\b[^<>]*>([^<]*)", re.I)
_ELEMENT = re.compile(r"<(meta|a|area|link|img|script|iframe|form|source|video|audio)\b([^<>]*)>", re.I)
_ATTRIBUTE = re.compile(r"""([a-zA-Z:_-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_LINKING = {"href", "src", "action"}


def page_text(page: str) -> str:
    """The page's visible text: a line for each block, blanks joined, empty lines left out."""
    text = _TAG.sub("", _BREAK.sub("\n", _UNSEEN.sub("", page).replace("\n", " ").replace("\r", " ")))
    lines = (line.strip() for line in _BLANKS.sub(" ", html.unescape(text)).split("\n"))
    return "\n".join(line for line in lines if line)


def page_metadata(page: str) -> dict:
    """Title, metas and links of an HTML page."""
    seen = _COMMENT.sub("", page) if "<!--" in page else page
    metas, links = [], []
    for name, inside in _ELEMENT.findall(seen):
        got = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(inside)}
        if name.lower() == "meta":
            metas.append(got)
        links += [{"path": f"{name.upper()}@/{k}", "url": v} for k, v in got.items() if k in _LINKING]
    title = _TITLE.search(seen)
    return {"Head": {"Title": html.unescape(title[1]).strip() if title else None, "Metas": metas}, "Links": links}


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PAIRS = [a + b for a in _BASE32 for b in _BASE32]
_TENS = range(150, -1, -10)


def digest(data: bytes) -> str:
    """SHA-1 in base 32, ten bits at a time."""
    n = int.from_bytes(hashlib.sha1(data).digest())
    return "sha1:" + "".join([_PAIRS[n >> k & 1023] for k in _TENS])


def http_message(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """Status line, headers (names in lower case) and decoded payload of an HTTP response."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or not gap:
        return "", {}, block
    status, *lines = head.decode("latin-1").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    if headers.get("transfer-encoding", "").lower() == "chunked":
        payload = _unchunked(payload)
    if headers.get("content-encoding", "").lower() == "gzip":
        try:
            payload = gzip.decompress(payload)
        except (OSError, EOFError, zlib.error):
            pass  # said to be compressed but is not: the bytes as they are
    return status, headers, payload


def _unchunked(data: bytes) -> bytes:
    out, at = [], 0
    while (line := data.find(b"\r\n", at)) >= 0:
        try:
            size = int(data[at:line].split(b";")[0], 16)
        except ValueError:
            return data
        if not size:
            break
        out.append(data[line + 2 : line + 2 + size])
        at = line + 2 + size + 2
    return b"".join(out)


def _decoded(payload: bytes, content_type: str) -> str:
    named = re.search(r"charset=[\"']?([\w.:-]+)", content_type, re.I)
    try:
        return payload.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def derived(response: dict, created: str | None = None) -> list[dict]:
    """The metadata and conversion records of a response record.

    ``created`` is their date where the response has none.
    """
    block = response["block"] or b""
    target, date = response["target_uri"], response["date"]
    source = response["record_id"] or _urn(f"{target} {hashlib.sha1(block).hexdigest()}")
    status, headers, payload = http_message(block)
    content_type = headers.get("content-type", "")
    kind = content_type.split(";")[0].strip().lower()
    version, _, rest = status.partition(" ")
    code, _, reason = rest.partition(" ")
    message = {
        "Response-Message": {"Version": version, "Status": code, "Reason": reason},
        "Headers": headers,
        "Entity-Length": len(payload),
        "Entity-Digest": digest(payload),
    }
    text = None
    if kind in ("text/html", "application/xhtml+xml"):
        page = _decoded(payload, content_type)
        message["HTML-Metadata"], text = page_metadata(page), page_text(page)
    elif kind == "text/plain":
        text = _decoded(payload, content_type)
    given = {k: v for k, v in (("WARC-Target-URI", target), ("WARC-Date", date)) if v is not None}
    told = {"WARC-Type": "response", "WARC-Record-ID": source, **given, **dict(response["headers"] or ())}
    told.setdefault("WARC-Payload-Digest", message["Entity-Digest"])
    told.setdefault("WARC-Block-Digest", digest(block))
    envelope = {
        "Envelope": {
            "Format": "WARC",
            "WARC-Header-Metadata": told,
            "Payload-Metadata": {"HTTP-Response-Metadata": message},
        }
    }
    referred = [("WARC-Refers-To-" + k[5:], _one_line(v)) for k, v in given.items()]
    out = [("metadata", "application/json", json.dumps(envelope, ensure_ascii=False).encode())]
    if text is not None:
        out.append(("conversion", "text/plain", text.encode("utf-8", "replace")))
    return [
        {
            "warc_type": warc_type,
            "record_id": _urn(f"{source} {warc_type}"),
            "refers_to": source,
            "target_uri": target,
            "date": created if date is None else date,
            "headers": [
                ("Content-Type", mime),
                *referred,
                ("WARC-Block-Digest", digest(data)),
                ("WARC-Source-Payload-Digest", told["WARC-Payload-Digest"]),
            ],
            "block": data,
        }
        for warc_type, mime, data in out
    ]


def _urn(name: str) -> str:
    """A name's UUID of version 5, as uuid.uuid5 makes it."""
    n = int.from_bytes(hashlib.sha1(uuid.NAMESPACE_URL.bytes + name.encode()).digest()[:16])
    n = n & ~(0xF000 << 64) & ~(0xC000 << 48) | 5 << 76 | 1 << 63
    told = f"{n:032x}"
    return f"<urn:uuid:{told[:8]}-{told[8:12]}-{told[12:16]}-{told[16:20]}-{told[20:]}>"


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def derive(responses: DataFrame, created: str | None = None) -> DataFrame:
    """Metadata and conversion records of the ``response`` rows; other types give none.

    ``created`` dates the records of responses without a date; the time of the call if not
    given.
    """
    created = created or now()

    def scan(batches):
        for batch in batches:
            for part in slices(batch, "block", _PART):
                rows = [r for x in part.to_pylist() for r in derived(x, created)]
                yield pa.RecordBatch.from_pylist(rows, _RECORD_ARROW)

    ship_package(responses.sparkSession)
    return responses.where("warc_type = 'response'").select(*_RECORD_ARROW.names).mapInArrow(scan, RECORD)


def page_responses(
    pages: DataFrame, *, id_col="page_id", url_col="url", html_col="html", date: str | None = None
) -> DataFrame:
    """Response records of stored pages, with the page's id as ``page_id``.

    The record id is made of the page's id, address and content.
    """
    page = plain(pages, page_id=id_col, url=url_col, html=html_col)
    content = F.coalesce("html", F.lit(""))
    told = F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")),
                             F.coalesce("url", F.lit("")), F.md5(content)))
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(content).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return page.select(
        "page_id",
        F.lit("response").alias("warc_type"),
        F.regexp_replace(told, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>").alias("record_id"),
        F.lit(None).cast("string").alias("refers_to"),
        F.col("url").alias("target_uri"),
        F.lit(date).cast("string").alias("date"),
        F.create_map(F.lit("Content-Type"), F.lit("application/http; msgtype=response")).alias("headers"),
        F.concat(head, content).cast("binary").alias("block"),
    )


def _one_line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def _member(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [f"{k}: {_one_line(v)}" for k, v in headers if v is not None]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"])
    squeeze = zlib.compressobj(GZIP_LEVEL, wbits=31)
    return squeeze.compress(head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def write_files(records: DataFrame, folder: str, created: str | None = None) -> DataFrame:
    """Write the records as ``part-*.warc.gz`` into ``folder``; (path, n_records) of each file.

    ``folder`` is a path of the shared storage; ``created`` dates the warcinfo records, the
    time of the call if not given.
    """
    created = created or now()

    def write(batches):
        from pyspark import TaskContext

        fs, root = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        path = f"{root}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        own, out, n = f"{root}/_{uuid.uuid4().hex}", None, 0
        for batch in batches:
            for part in slices(batch, "block", _PART):
                if out is None:
                    out = fs.open_output_stream(own)
                    info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", _urn(path)),
                            ("WARC-Date", created), ("WARC-Filename", path.rpartition("/")[2]), ("Content-Type", "application/warc-fields")]
                    out.write(_member(info, b"format: WARC File Format 1.1\r\n"))
                for r in part.to_pylist():
                    named = [("WARC-Type", r["warc_type"]), ("WARC-Record-ID", r["record_id"]),
                             ("WARC-Refers-To", r["refers_to"]), ("WARC-Target-URI", r["target_uri"]),
                             ("WARC-Date", r["date"])]
                    out.write(_member([*named, *(r["headers"] or ())], r["block"] or b""))
                    n += 1
        if out is not None:
            out.close()
            fs.move(own, path)
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n]})

    ship_package(records.sparkSession)
    plain_records = records.select(*_RECORD_ARROW.names)
    return keep(plain_records.mapInArrow(write, "path string, n_records long"), "warc-files")


def read_files(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """Records of the files listed in ``path``, and whether each block's digest holds.

    ``folder`` tells the storage the paths belong to. ``digest_ok`` is null where a record
    has no block digest.
    """
    n_files = max(1, files.count())

    def read(batches):
        fs, _ = pa.fs.FileSystem.from_uri(folder)
        schema = _RECORD_ARROW.append(pa.field("digest_ok", pa.bool_()))
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                for row in _records(fs, path):
                    rows.append(row)
                    size += len(row["block"])
                    if size >= _PART:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    ship_package(spark)
    return files.select("path").repartition(n_files, "path").mapInArrow(read, RECORD + ", digest_ok boolean")


_OWN_COLUMNS = {"WARC-Type": "warc_type", "WARC-Record-ID": "record_id", "WARC-Refers-To": "refers_to",
                "WARC-Target-URI": "target_uri", "WARC-Date": "date"}


def _records(fs, path: str):
    """Rows of a file, member by member."""
    with fs.open_input_stream(path, compression=None) as stream:
        rest, member, parts = b"", zlib.decompressobj(31), []
        while True:
            data = rest or stream.read(1 << 20)
            if not data:
                if parts:
                    raise EOFError(f"{path} ends inside a record")
                return
            parts.append(member.decompress(data))
            rest = member.unused_data
            if member.eof:
                yield _row(b"".join(parts))
                member, parts = zlib.decompressobj(31), []


def _row(record: bytes) -> dict:
    head, _, body = record.partition(b"\r\n\r\n")
    headers = [line.partition(": ")[::2] for line in head.decode().split("\r\n")[1:]]
    length = int(dict(headers)["Content-Length"])
    block = body[:length]
    row = {column: None for column in _OWN_COLUMNS.values()}
    row |= {_OWN_COLUMNS[k]: v for k, v in headers if k in _OWN_COLUMNS}
    kept = [(k, v) for k, v in headers if k not in _OWN_COLUMNS and k != "Content-Length"]
    told = dict(kept).get("WARC-Block-Digest")
    return row | {"headers": kept, "block": block, "digest_ok": None if told is None else digest(block) == told}
