"""WARC derivative builder: responses to linked metadata and plain-text conversion records.

For each ``response`` record two records are derived. The ``conversion`` record holds
the page's plain text; the ``metadata`` record (application/warc-fields) holds every
HTTP header of the source, the digests that its WARC record named, digests computed
from its bytes, and what the conversion found. Both name the response in
``WARC-Refers-To`` and keep its target URI and date. Record ids are computed from the
source's id, so a repeated run gives the same records.

``read_warc`` and ``to_warc`` parse and write the file format (gzip members or plain);
``read_responses`` makes ``derive``'s input from records that were read: digests cover
the payload as stored, and its text is taken after undoing chunks, gzip or deflate and
the charset that the headers name (else UTF-8). ``derive`` is a projection: one scan,
nothing shuffled; the stripped text passes through Python once, to decode references.

Defined results: a null URL, header block or payload counts as empty; an empty payload
gives an empty conversion (its digest is that of the empty string); bytes that the
charset lacks become U+FFFD; an unknown charset is read as UTF-8; a payload that claims
a coding it does not have is taken as it is; repeated rows give repeated records with
equal ids; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import gzip
import html as _html
import io
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
VERSION = "WARC/1.1"
DEFAULT_DATE = "2024-01-01T00:00:00Z"

_RECORD = (
    "warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, "
    "block_digest string, payload_digest string, content_length long, block binary"
)
_RESPONSE = (
    "source_id string, record_id string, target_uri string, warc_date string, http_headers string, payload binary, text string, "
    "warc_payload_digest string, warc_block_digest string"
)


def digest(data: Column) -> Column:
    """Labelled digest of a string's UTF-8 bytes or of a binary."""
    return F.concat(F.lit("sha256:"), F.sha2(data, 256))


def uuid_urn(key: Column) -> Column:
    """A name-based urn:uuid from a string."""
    h = F.md5(key)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


#: Elements whose content no reader sees as text.
INVISIBLE = ("script", "style", "noscript", "template", "textarea", "select", "iframe", "object", "svg", "math", "canvas", "audio", "video")
_HIDDEN = rf"(?is)<!--.*?(?:-->|\z)|<({'|'.join(INVISIBLE)})(?:[\s/][^>]*)?>.*?(?:</\1\s*>|\z)"
_BLOCK = r"(?i)<(?:/?(?:p|div|li|ul|ol|h[1-6]|tr|table|article|section|nav|footer|header|title)|br)(?:[ \t\r\n/][^>]*)?>"


def _decoded(text: Column) -> Column:
    """Character references decoded."""

    def decode(texts: pd.Series) -> pd.Series:
        return texts.map(_html.unescape, na_action="ignore")

    return F.pandas_udf(decode, "string")(text)


def plain_text(html: Column) -> Column:
    """Visible text without markup; all named and numeric character references decoded."""
    text = F.regexp_replace(html, _HIDDEN, " ")
    text = F.regexp_replace(F.regexp_replace(text, _BLOCK, "\n"), r"<[^>]*>", "")
    text = F.translate(_decoded(text), "\u00a0", " ")
    text = F.regexp_replace(text, r"[ \t\r\f]+", " ")
    text = F.regexp_replace(text, r" ?\n[ \n]*", "\n")
    return F.regexp_replace(text, r"^[ \n]+|[ \n]+$", "")


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DEFAULT_DATE) -> DataFrame:
    """Response records of a table of pages, with its id as ``source_id``."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    url = F.coalesce(F.col(url_col), F.lit(""))
    size = F.octet_length(html)
    headers = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size.cast("string"), F.lit(CRLF)
    )
    return pages.select(
        F.col(id_col).alias("source_id"),
        uuid_urn(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(" "), url)).alias("record_id"),
        url.alias("target_uri"),
        F.lit(date).alias("warc_date"),
        headers.alias("http_headers"),
        html.alias("payload"),
    )


def derive(source: DataFrame) -> DataFrame:
    """Two derived records for each response.

    ``source``: source_id, record_id, target_uri, warc_date, http_headers, payload (text or
    bytes), and where known text (the payload decoded), warc_payload_digest, warc_block_digest.
    """
    named = [F.col(c) if c in source.columns else F.lit(None).cast("string") for c in ("warc_payload_digest", "warc_block_digest")]
    text = F.col("text") if "text" in source.columns else F.coalesce(F.col("payload").cast("string"), F.lit(""))
    payload = F.coalesce(F.col("payload").cast("binary"), F.lit(b""))
    known = source.select(
        "source_id",
        "record_id",
        F.coalesce("target_uri", F.lit("")).alias("target_uri"),
        "warc_date",
        F.coalesce("http_headers", F.lit("")).alias("http_headers"),
        F.octet_length(payload).alias("size"),
        digest(payload).alias("source_payload_digest"),
        digest(F.when(F.length("http_headers") > 0, F.concat(F.col("http_headers").cast("binary"), F.lit(CRLF).cast("binary"), payload)).otherwise(payload)).alias("source_block_digest"),
        named[0].alias("warc_payload_digest"),
        named[1].alias("warc_block_digest"),
        plain_text(text).alias("text"),
    ).withColumns(
        {
            "conversion_digest": digest(F.col("text")),
            "conversion_id": uuid_urn(F.concat(F.lit("conversion "), F.col("record_id"))),
        }
    )
    lines = F.filter(F.split("http_headers", CRLF), lambda line: (line != "") & ~line.startswith("HTTP/"))
    headers = F.array_join(F.transform(lines, lambda line: F.concat(F.lit("source-http-"), line, F.lit(CRLF))), "")
    kept = [
        F.coalesce(F.concat(F.lit(f"source-{label}: "), F.col(c), F.lit(CRLF)), F.lit(""))
        for label, c in (("warc-payload-digest", "warc_payload_digest"), ("warc-block-digest", "warc_block_digest"))
    ]
    fields = F.concat(
        F.lit("source-status: "), F.regexp_extract("http_headers", r"^HTTP/[0-9.]+ ([0-9]+)", 1), F.lit(CRLF),
        headers,
        F.lit("source-payload-length: "), F.col("size").cast("string"), F.lit(CRLF),
        *kept,
        F.lit("source-payload-digest: "), F.col("source_payload_digest"), F.lit(CRLF),
        F.lit("source-block-digest: "), F.col("source_block_digest"), F.lit(CRLF),
        F.lit("conversion-record-id: "), F.col("conversion_id"), F.lit(CRLF),
        F.lit("conversion-digest: "), F.col("conversion_digest"), F.lit(CRLF),
    )
    records = known.withColumn(
        "record",
        F.explode(
            F.array(
                F.struct(
                    F.lit("conversion").alias("warc_type"),
                    F.col("conversion_id").alias("id"),
                    F.lit("text/plain; charset=utf-8").alias("content_type"),
                    F.col("text").alias("block"),
                ),
                F.struct(
                    F.lit("metadata").alias("warc_type"),
                    uuid_urn(F.concat(F.lit("metadata "), F.col("record_id"))).alias("id"),
                    F.lit("application/warc-fields").alias("content_type"),
                    fields.alias("block"),
                ),
            )
        ),
    )
    return records.select(
        "source_id",
        F.col("record.warc_type").alias("warc_type"),
        F.col("record.id").alias("record_id"),
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "warc_date",
        F.col("record.content_type").alias("content_type"),
        digest(F.col("record.block")).alias("block_digest"),
        "source_payload_digest",
        "source_block_digest",
        F.octet_length("record.block").cast("long").alias("content_length"),
        F.col("record.block").alias("block"),
    )


def to_warc(records: DataFrame, compress: bool = True) -> DataFrame:
    """The bytes of each record, header and block, as one gzip member (column ``warc``).

    Members may be joined in any order to a valid file.
    """
    names = ("warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "block_digest", "block")
    labels = ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "Content-Type", "WARC-Block-Digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for *values, block in zip(*batch.columns):
                raw = block.as_py() or b""
                raw = raw.encode() if isinstance(raw, str) else raw
                head = [f"{k}: {v.as_py()}" for k, v in zip(labels, values) if v.as_py()]
                data = CRLF.join([VERSION, *head, f"Content-Length: {len(raw)}", "", ""]).encode() + raw + b"\r\n\r\n"
                out.append(gzip.compress(data, mtime=0) if compress else data)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["warc"])

    return records.select(*names).mapInArrow(run, "warc binary")


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of an uncompressed stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers: dict[str, str] = {}
        last = None
        while (line := stream.readline()).strip():
            if line[:1] in b" \t" and last:
                headers[last] += " " + line.strip().decode("utf-8", "replace")
                continue
            name, _, value = line.decode("utf-8", "replace").partition(":")
            last = name.strip().lower()
            headers[last] = value.strip()
        yield headers, stream.read(int(headers.get("content-length", 0)))


class _Members(io.RawIOBase):
    """A stream over joined gzip members, or over plain bytes."""

    def __init__(self, raw: bytes):
        self._raw, self._plain = raw, raw[:2] != b"\x1f\x8b"
        self._unzip = None
        self._at = 0
        self._ready = b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self._ready and self._at < len(self._raw):
            if self._plain:
                self._ready = self._raw[self._at : self._at + len(buffer)]
                self._at += len(self._ready)
                break
            self._unzip = self._unzip or zlib.decompressobj(31)
            chunk = self._raw[self._at : self._at + (1 << 16)]
            self._ready = self._unzip.decompress(chunk)
            self._at += len(chunk)
            if self._unzip.eof:
                self._at -= len(self._unzip.unused_data)
                self._unzip = None
        n = min(len(buffer), len(self._ready))
        buffer[:n] = self._ready[:n]
        self._ready = self._ready[n:]
        return n


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files; each file is one task, streamed record by record."""
    names = ("warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-date", "content-type", "warc-block-digest", "warc-payload-digest")
    columns = [f.split()[0] for f in _RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for headers, block in parse_records(io.BufferedReader(_Members(content.as_py()), 1 << 16)):
                    rows.append([headers.get(n) for n in names] + [len(block), block])
                    if len(rows) == 500:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    def _batch(rows: list[list]) -> pa.RecordBatch:
        kinds = [pa.string()] * 8 + [pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=columns)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _RECORD)


def undone(payload: bytes, headers: str) -> str:
    """A response's payload as text: chunks, content coding and charset undone as its headers say."""
    named = {}
    for line in headers.split(CRLF)[1:]:
        name, _, value = line.partition(":")
        named.setdefault(name.strip().lower(), value.strip())
    if "chunked" in named.get("transfer-encoding", "").lower():
        payload = _joined_chunks(payload)
    coding = named.get("content-encoding", "").lower()
    if coding in ("gzip", "x-gzip", "deflate"):
        for bits in (47, -15):  # zlib or gzip by its header, else a bare deflate stream
            try:
                payload = zlib.decompressobj(bits).decompress(payload)
                break
            except zlib.error:
                continue
    charset = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", named.get("content-type", ""), re.I)
    try:
        return payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def _joined_chunks(payload: bytes) -> bytes:
    """The chunks of a chunked body; the body itself if it is none."""
    parts, at = [], 0
    while True:
        end = payload.find(b"\r\n", at)
        size = re.match(rb"[0-9A-Fa-f]+", payload[at:end]) if end >= 0 else None
        if not size:
            return payload if not parts else b"".join(parts)
        n = int(size[0], 16)
        if not n:
            return b"".join(parts)
        parts.append(payload[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def read_responses(records: DataFrame) -> DataFrame:
    """``derive``'s input from the response records that ``read_warc`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [(b.as_py() or b"").partition(b"\r\n\r\n") for b in batch.column(3)]
            heads = [(head + b"\r\n").decode("utf-8", "replace") if gap else "" for head, gap, _ in split]
            bodies = [body if gap else head for head, gap, body in split]
            texts = [undone(body, head) for body, head in zip(bodies, heads)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[:3], pa.array(heads), pa.array(bodies, pa.binary()), pa.array(texts, pa.string()), *batch.columns[4:]],
                names=[f.split()[0] for f in _RESPONSE.split(", ")],
            )

    columns = ("record_id", "target_uri", "warc_date", "block", "payload_digest", "block_digest")
    return records.filter("lower(warc_type) = 'response'").select(*columns).mapInArrow(run, _RESPONSE)
