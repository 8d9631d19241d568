"""WARC archives with revisit records: resolve repeats by payload digest, write, and read back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm.shared import shared_folder, table

#: The digits of Spark's base 32 and of RFC 4648.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DATE = "2024-01-01T00:00:00Z"
MIN_BYTES = 0
PAGES_PER_FILE = 20_000
_END = b"\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: eight groups of 20 bits."""
    digest = F.upper(F.sha1(payload))
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), DIGITS, BASE32)


def resolve_revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``page_id, url, html`` with digest, record type and the original's id and url.

    Among equal payloads of at least ``min_bytes`` bytes the smallest page_id (nulls last, then url) is the response;
    rows repeating both id and url of the response are responses too. A null html is an empty payload. Only digests
    that occur twice are joined back; their originals are found by map-side minima, so a payload that a third of all
    rows share costs one row per task, and its rows are split by the adaptive join.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("html", F.lit("")).alias("html"), F.octet_length(payload).cast("long").alias("payload_bytes"),
        base32_sha1(payload).alias("payload_digest"),
    )
    who = F.struct(F.isnull("page_id").alias("none"), "page_id", "url")
    repeated = (
        rows.where(F.col("payload_bytes") >= min_bytes)
        .groupBy(F.col("payload_digest").alias("__digest"))
        .agg(F.min(who).alias("__first"), F.count("*").alias("__n"))
        .where("__n > 1")
    )
    joined = rows.join(repeated, F.col("payload_digest") == F.col("__digest"), "left")
    again = F.col("__digest").isNotNull() & ~(
        F.col("__first.page_id").eqNullSafe(F.col("page_id")) & (F.col("__first.url") == F.col("url"))
    )
    return joined.select(
        *rows.columns, F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("__first.page_id")).alias("refers_to"), F.when(again, F.col("__first.url")).alias("refers_url"),
    )


def _record_id(page_id: Column, url: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("\n", F.coalesce(page_id.cast("string"), F.lit("")), url, digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _header(value: Column) -> Column:
    return F.translate(value, "\r\n", "  ")


def record_text(rows: DataFrame, date: str = DATE) -> DataFrame:
    """Each row of :func:`resolve_revisits` as the text of a WARC record, with headers written anew."""
    again = F.col("record_type") == "revisit"
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes"), F.lit("\r\n\r\n")
    )
    block = F.when(again, http).otherwise(F.concat(http, "html"))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), field("WARC-Type", F.col("record_type")), field("WARC-Target-URI", _header(F.col("url"))),
        field("WARC-Date", F.lit(date)), field("WARC-Record-ID", _record_id(F.col("page_id"), F.col("url"), F.col("payload_digest"))),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.coalesce(field("X-Page-ID", F.col("page_id").cast("string")), F.lit("")),
        F.when(
            again,
            F.concat(
                field("WARC-Profile", F.lit(PROFILE)),
                field("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("refers_url"), F.col("payload_digest"))),
                field("WARC-Refers-To-Target-URI", _header(F.col("refers_url"))), field("WARC-Refers-To-Date", F.lit(date)),
                F.coalesce(field("X-Refers-To-Page-ID", F.col("refers_to").cast("string")), F.lit("")),
            ),
        ).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block), F.lit("\r\n\r\n"),
    )
    return rows.select(F.concat(head, block, F.lit("\r\n\r")).alias("value"))  # the writer adds the last line feed


def write_archives(rows: DataFrame, path: str) -> None:
    """Gzip-compressed WARC files below ``path``, through Spark's committed writer: a lost task leaves no half file."""
    record_text(rows).write.option("maxRecordsPerFile", PAGES_PER_FILE).text(path, compression="gzip", lineSep="\n")


def _records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of concatenated archives: headers by name, block. Holds one record and one chunk."""
    data, at, chunks = bytearray(), 0, iter(chunks)

    def more() -> bool:
        nonlocal at
        piece = next(chunks, None)
        if piece is not None:
            del data[:at]
            at = 0
            data.extend(piece)
        return piece is not None

    while True:
        seen = at
        while (end := data.find(_END, seen)) < 0:
            seen, shift = max(at, len(data) - 3), at
            if not more():
                if bytes(data[at:]).strip():
                    raise ValueError("an archive ends inside a record's headers")
                return
            seen -= shift
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        head = dict(line.split(": ", 1) for line in lines[1:])
        size = int(head["Content-Length"])
        start = end + 4
        while len(data) < start + size + 4:
            shift = at
            if not more():
                raise ValueError("an archive ends inside a record's block")
            start -= shift
        if data[start + size : start + size + 4] != _END:
            raise ValueError("a record's length is wrong")
        yield head, bytes(data[start : start + size])
        at = start + size + 4


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    for batch in batches:
        if batch.num_rows:
            yield ("\n".join(batch.column(0).to_pylist()) + "\n").encode()


READ_SCHEMA = (
    "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, record_id string"
)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import base64
    import hashlib

    names = [c.split()[0] for c in READ_SCHEMA.split(", ")]
    types = [pa.int64() if c.endswith("long") else pa.string() for c in READ_SCHEMA.split(", ")]
    rows: list[tuple] = []
    out = lambda: pa.record_batch([pa.array(v, t) for v, t in zip(zip(*rows), types)], names)
    for head, block in _records(_lines(batches)):
        http, payload = block.split(_END, 1)
        length = int(re.search(rb"Content-Length: (\d+)", http)[1])
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        if head["WARC-Type"] == "response":
            if len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"the payload of {head['WARC-Record-ID']} does not match its headers")
        page, refers = head.get("X-Page-ID"), head.get("X-Refers-To-Page-ID")
        rows.append((
            page and int(page), head["WARC-Target-URI"], head["WARC-Type"], digest, length, refers and int(refers), head["WARC-Record-ID"],
        ))
        if len(rows) >= 5000:
            yield out()
            rows.clear()
    if rows:
        yield out()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives below ``path``. A gzip file is one split, so its lines come whole and in order."""
    return spark.read.option("lineSep", "\n").schema("value string").text(path).mapInArrow(_parse, READ_SCHEMA)


def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all ``pages`` as archives and return what they say when read back."""
    path = shared_folder(spark, "warc")
    write_archives(resolve_revisits(table(spark, sf_dir, "pages")), path)
    return read_archives(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


SQL = """
WITH d AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), m AS (SELECT h, min(page_id) AS first_id FROM d GROUP BY h)
SELECT d.page_id, CAST(octet_length(encode(d.html)) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    (CAST('0x' || substr(d.h, 1 + 5 * CAST(i // 4 AS INT), 5) AS INT) >> (5 * (3 - CAST(i % 4 AS INT)))) & 31 AS INT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN d.page_id = m.first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN d.page_id = m.first_id THEN NULL ELSE m.first_id END AS refers_to
FROM d JOIN m USING (h)
"""
