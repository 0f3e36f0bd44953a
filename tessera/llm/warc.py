"""WARC derivatives (operator 7): from response records to linked metadata and
plain-text conversion records.

One map over the records, no shuffle. Each response gives a ``metadata`` record
(application/warc-fields: fetch status, the source's HTTP headers, its digests,
what was derived) and, if its payload is text, a ``conversion`` record (text/plain). Both carry the
response's target URI and date and name it in WARC-Refers-To (written records also
in WARC-Refers-To-Target-URI and -Date); the metadata
record names the conversion in WARC-Concurrent-To. Record ids are made from the
response's id and the kind, so a task that runs again writes the same ids.

Defined results: null records and records of other types give no rows; a
record that can't be parsed as WARC gives no rows; a response whose block is no
HTTP message, or whose payload isn't text (or can't be decompressed, or inflates
beyond MOST_INFLATED bytes), gives its
metadata record only, with ``derived: none`` and the reason; an empty payload gives
an empty conversion; a charset that is none reads as UTF-8, bytes that are no
text in it as U+FFFD; repeated rows give repeated rows; an empty table gives an
empty result. Only the record column is read, other columns cannot clash.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.html_text import blocks, read_page

#: Codecs of text; others of Python's (idna, unicode_escape, ...) are no charset of a page.
CODECS = re.compile(r"utf-(?:8|16|32)(?:-[bl]e|-sig)?|ascii|iso8859-\d+|cp\d+|koi8-[rtu]|gb2312|gbk|gb18030|hz|big5(?:hkscs)?|"
                    r"shift_ji\w+|euc_\w+|iso2022_\w+|mac-\w+|johab|kz1048|ptcp154|tis-620")
#: A compressed payload may inflate to this many bytes; beyond, it counts as one that can't be decoded.
MOST_INFLATED = 1 << 28
VERSION = b"WARC/1.1\r\n"
OUT = ("record_id string, warc_type string, refers_to string, concurrent_to string, target_uri string, warc_date string, "
       "content_type string, content_length long, block_digest string, payload_digest string, "
       "source_headers map<string,string>, block string")


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def fields(head: bytes) -> list[tuple[str, str]]:
    """Header lines as (name, value); folded lines are joined."""
    out: list[tuple[str, str]] = []
    for line in head.decode("utf-8", "replace").split("\n"):
        line = line.rstrip("\r")
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, value = line.split(":", 1)
            out.append((name.strip(), value.strip()))
    return out


def split_head(data: bytes) -> tuple[bytes, bytes] | None:
    """(head, body) at the first empty line."""
    m = re.search(rb"\r?\n\r?\n", data)
    return (data[:m.start()], data[m.end():]) if m else None


def parse_record(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """(header fields by lower-case name, block) of one WARC record."""
    if not data.startswith(b"WARC/"):
        return None
    parts = split_head(data)
    if not parts:
        return None
    head = {k.lower(): v for k, v in fields(parts[0].split(b"\n", 1)[-1])}
    try:
        n = int(head["content-length"])
    except (KeyError, ValueError):
        return None
    return (head, parts[1][:n]) if 0 <= n <= len(parts[1]) else None


def dechunk(body: bytes) -> bytes:
    out, pos = [], 0
    while (eol := body.find(b"\n", pos)) >= 0:
        size = body[pos:eol].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size or b"0"):
            raise ValueError("no chunk size")
        n = int(size or b"0", 16)
        if n == 0:
            break
        out.append(body[eol + 1:eol + 1 + n])
        pos = eol + 1 + n
        pos += 2 if body[pos:pos + 2] == b"\r\n" else body[pos:pos + 1] == b"\n"
    return b"".join(out)


def inflate(body: bytes, wbits: int, most: int) -> bytes:
    """All members of a compressed body, of at most ``most`` bytes in all."""
    out, left = [], most
    while body:
        z = zlib.decompressobj(wbits)
        part = z.decompress(body, left + 1)
        left -= len(part)
        if left < 0:
            raise ValueError("inflates beyond the bound")
        if not z.eof:
            raise EOFError
        out.append(part)
        body = z.unused_data.lstrip(b"\0")
    return b"".join(out)


def codec_of(name: str) -> str:
    """The codec of a charset name if it is one of text, else UTF-8."""
    try:
        found = codecs.lookup(name).name
    except (LookupError, UnicodeError, ValueError):
        return "utf-8"
    return found if CODECS.fullmatch(found) else "utf-8"


def payload_text(http: dict[str, str], body: bytes) -> tuple[str | None, str]:
    """(plain text of the payload, "") or (None, the reason for none)."""
    kind = http.get("content-type", "text/html").split(";")[0].strip().lower()
    if kind not in ("text/html", "application/xhtml+xml", "text/plain"):
        return None, f"content type {kind}"
    try:
        if "chunked" in http.get("transfer-encoding", "").lower():
            body = dechunk(body)
        coding = http.get("content-encoding", "identity").strip().lower()
        if coding in ("gzip", "x-gzip"):
            body = inflate(body, 31, MOST_INFLATED)
        elif coding == "deflate":
            body = inflate(body, 15, MOST_INFLATED)
        elif coding not in ("", "identity"):
            return None, f"content coding {coding}"
    except (ValueError, OSError, EOFError, zlib.error):
        return None, "payload can't be decoded"
    m = (re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", http.get("content-type", ""), re.IGNORECASE)
         or re.search(r"<meta[^>]{0,200}?charset\s*=\s*[\"']?([\w.:-]+)", body[:4096].decode("latin-1"), re.IGNORECASE))
    text = body.decode(codec_of(m[1]) if m else "utf-8", "replace")
    return (text if kind == "text/plain" else "\n".join(blocks(read_page(text, drop_parts=False)))), ""


def derive(head: dict[str, str], block: bytes) -> list[dict]:
    """The records made from one response record."""
    source = head.get("warc-record-id", "")
    made = lambda kind: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source} {kind}')}>"
    common = {"refers_to": source, "target_uri": head.get("warc-target-uri"), "warc_date": head.get("warc-date"),
              "source_headers": list(head.items())}
    parts = split_head(block)
    status = re.match(rb"HTTP/\d(?:\.\d)?\s+(\d{3})", block)
    http = fields(parts[0].split(b"\n", 1)[-1]) if parts and status else []
    text, why = payload_text({k.lower(): v for k, v in http}, parts[1]) if parts and status else (None, "no HTTP message")
    out = []
    if text is not None:
        out.append(common | {"record_id": made("conversion"), "warc_type": "conversion", "content_type": "text/plain; charset=utf-8",
                             "concurrent_to": None, "block": text})
    lines = [("fetch-status", status[1].decode() if status else "none"), *((f"http-{k.lower()}", v) for k, v in http),
             ("source-block-digest", head.get("warc-block-digest") or sha1(block)),
             ("source-payload-digest", head.get("warc-payload-digest") or (sha1(parts[1]) if http else "none")),
             ("derived", out[0]["record_id"] if out else "none")] + ([("derived-none-reason", why)] if why else [])
    out.insert(0, common | {"record_id": made("metadata"), "warc_type": "metadata", "content_type": "application/warc-fields",
                            "concurrent_to": out[0]["record_id"] if out else None,
                            "block": "".join(f"{k}: {v}\r\n" for k, v in lines)})
    for r in out:
        data = r["block"].encode("utf-8", "replace")
        r |= {"content_length": len(data), "block_digest": sha1(data), "payload_digest": head.get("warc-payload-digest")}
    return out


def derivatives(records: DataFrame, record_col: str = "record") -> DataFrame:
    """Metadata and conversion records (columns ``OUT``) of the response
    records in the binary column ``record_col`` (one whole WARC record each)."""
    schema = pa.schema([
        *((n, pa.string()) for n in ("record_id", "warc_type", "refers_to", "concurrent_to", "target_uri", "warc_date", "content_type")),
        ("content_length", pa.int64()), ("block_digest", pa.string()), ("payload_digest", pa.string()),
        ("source_headers", pa.map_(pa.string(), pa.string())), ("block", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data in b.column(0):
                got = parse_record(data.as_py()) if data.is_valid else None
                if got and got[0].get("warc-type", "").lower() == "response":
                    rows += derive(*got)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return records.select(record_col).mapInArrow(run, OUT)


def record_bytes(derived: DataFrame) -> DataFrame:
    """Each derived record as a whole WARC record (binary column ``record``)."""
    names = (("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"),
             ("WARC-Refers-To-Target-URI", "target_uri"), ("WARC-Refers-To-Date", "warc_date"), ("WARC-Concurrent-To", "concurrent_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"),
             ("Content-Type", "content_type"), ("WARC-Block-Digest", "block_digest"), ("Content-Length", "content_length"))
    line = lambda n, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{n}: "), F.col(c).cast("string"), F.lit("\r\n"))).otherwise("")
    return derived.select("record_id", F.concat(
        F.lit("WARC/1.1\r\n"), *(line(n, c) for n, c in names), F.lit("\r\n"), F.col("block"), F.lit("\r\n\r\n")).cast("binary").alias("record"))


def iterate_records(stream) -> Iterator[bytes]:
    """The records of an uncompressed WARC stream, one after the other. What
    stands between records, and a record without a valid length, is passed over
    up to the next line that begins a record."""
    line = stream.readline()
    while line:
        if not line.startswith(b"WARC/"):
            line = stream.readline()
            continue
        head = [line]
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            head.append(line)
        size = next((x.split(b":", 1)[1].strip() for x in head if x.lower().startswith(b"content-length:")), b"0")
        if re.fullmatch(rb"[0-9]{1,15}", size):
            yield b"".join(head) + b"\r\n" + stream.read(int(size))
        line = stream.readline()


def readable(records: Iterator[bytes]) -> Iterator[bytes]:
    try:
        yield from records
    except (EOFError, OSError, zlib.error):
        return


def read_warc(spark: SparkSession, path: str, suffix: str = "*.warc*") -> DataFrame:
    """(path, record binary) of every record of the .warc and .warc.gz files
    under ``path``. A file is one row of its reader and so one task's, and may hold
    2 GB at most; archives are cut below that. A compressed file that ends
    early gives its records up to there."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", suffix).option("recursiveFileLookup", "true").load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                raw = io.BytesIO(content.as_buffer())
                stream = gzip.open(raw) if content.as_buffer()[:2].to_pybytes() == b"\x1f\x8b" else raw
                for r in readable(iterate_records(stream)):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([r], pa.binary())], names=["path", "record"])

    return files.select("path", "content").mapInArrow(run, "path string, record binary")


def response_records(pages: DataFrame) -> DataFrame:
    """Stand-in input: one WARC response record per page, in the schema that
    ``derivatives`` expects (no part of the derivation is done here)."""
    html = F.coalesce("html", F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nServer: example\r\nContent-Length: "),
                    F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html)
    h = F.md5(F.concat_ws(" ", F.coalesce("url", F.lit("")), F.col("page_id").cast("string")))
    uid = F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    seconds = F.pmod(F.coalesce("page_id", F.lit(0)).cast("long"), F.lit(31_536_000)) + 1_700_000_000
    date: Column = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:"), uid, F.lit(">\r\nWARC-Target-URI: "),
                    F.coalesce("url", F.lit("")), F.lit("\r\nWARC-Date: "), date,
                    F.lit("\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha256:"), F.sha2(html, 256),
                    F.lit("\r\nContent-Length: "), F.octet_length(http).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(F.concat(head, http, F.lit("\r\n\r\n")).cast("binary").alias("record"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(response_records(spark.read.parquet(f"{sf_dir}/pages.parquet")))
