"""WARC archives: writing, reading, and assembly of captures from their records."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, new_path, table, text_or_empty

CRLF = "\r\n"
#: Bytes of one archive file at most, before compression, if it has more than one capture; one task reads a file.
FILE_BYTES = 64 << 20
#: Captures are written by size, at most so many bytes each, so that their number in a file bounds its bytes.
SIZES = (8 << 10, 64 << 10, 512 << 10, 8 << 20)
#: Bytes that are unpacked at once.
CHUNK = 1 << 20
RECORDS = (
    "record_id string, type string, concurrent_to string, target_uri string, refers_to string, payload_digest string, http_status int, "
    "payload_bytes bigint, payload binary, page_id bigint"
)


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1, in four groups of 40 bits."""
    hexed = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record(headers: list[Column], block: Column) -> Column:
    return F.concat(F.lit("WARC/1.1" + CRLF), F.concat_ws("", *[F.concat(h, F.lit(CRLF)) for h in headers]), F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2), block)


def header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a request, a response or revisit, and a metadata record per row to gzipped WARC files under ``path``.

    Of rows with equal payloads of at least ``min_bytes``, the one with the largest id is the response
    and the others are revisits that refer to it; smaller payloads are always responses.  Each row is a
    capture of its own, also where rows repeat: its identifiers come from a UUID that is written with
    the row first, so that replays keep them.  Of several responses of the largest id, revisits refer to one.  Spark's own
    text sink writes the files, with the record separator as line separator, so that task retries,
    speculation and commits work as for any table on any file system.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.regexp_replace(text_or_empty(url_col), r"[\x00-\x20\x7f]", "%20").alias("url"), text_or_empty(html_col).alias("html"))
    rows = rows.withColumn("uid", F.expr("uuid()")).withColumn("digest", base32_sha1(F.col("html"))).withColumn("size", F.octet_length("html"))
    rows = materialise(rows.withColumn("weight", F.col("size") + 3 * F.octet_length("url") + 2_048), "uids")
    repeated = rows.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.max(F.struct("id", "uid")).alias("last"), F.count("*").alias("n")).where("n > 1").select("digest", F.col("last.id").alias("first"), F.col("last.uid").alias("first_uid"))
    rows = rows.join(materialise(repeated, "payloads"), "digest", "left").withColumn("revisit", F.coalesce((F.col("size") >= min_bytes) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.lit(False)))

    def urn(kind: str, of: Column) -> Column:
        key = F.md5(F.concat_ws("|", of, "digest", F.lit(kind)))
        dashed = F.concat_ws("-", *[F.substring(key, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
        return F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">"))

    me, uri, when = urn("response", F.col("uid")), header("WARC-Target-URI", F.col("url")), header("WARC-Date", F.lit(date))
    host = F.regexp_extract("url", r"^[^:]*://([^/?#]*)", 1)
    target = F.regexp_extract("url", r"^[^:]*://[^/?#]*([^#]*)", 1)
    asked = record(
        [header("WARC-Type", F.lit("request")), header("WARC-Record-ID", urn("request", F.col("uid"))), header("WARC-Concurrent-To", me), uri, when, F.lit("Content-Type: application/http; msgtype=request")],
        F.concat(F.lit("GET "), F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), target)), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF * 2)),
    )
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF * 2))
    common = [header("WARC-Record-ID", me), uri, when, header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), F.lit("Content-Type: application/http; msgtype=response")]
    answered = F.when(
        F.col("revisit"),
        record([F.lit("WARC-Type: revisit"), *common, header("WARC-Refers-To", urn("response", F.col("first_uid"))), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")], http),
    ).otherwise(record([F.lit("WARC-Type: response"), *common], F.concat(http, F.col("html"))))
    noted = record(
        [F.lit("WARC-Type: metadata"), header("WARC-Record-ID", urn("metadata", F.col("uid"))), header("WARC-Concurrent-To", me), uri, when, F.lit("Content-Type: application/warc-fields")],
        F.concat(
            F.lit("page-id: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(f"{CRLF}payload-length: "), F.col("size").cast("string"),
            F.when(F.col("revisit"), F.concat(F.lit(f"{CRLF}refers-to-page: "), F.coalesce(F.col("first").cast("string"), F.lit("")))).otherwise(""), F.lit(CRLF),
        ),
    )
    out = F.concat_ws(CRLF * 2, asked, answered, noted).alias("value")
    largest = rows.agg(F.max("weight")).first()[0] or 0
    for low, high in zip((0, *SIZES), (*SIZES, None), strict=True):
        if low < largest or not low:
            part = rows.where((F.col("weight") > low) & (F.col("weight") <= high if high else F.lit(True))).select(out)
            part.write.mode("append").option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", FILE_BYTES // high if high else 1).text(path)


def unpacked(data: bytes) -> Iterator[bytes]:
    """An archive's bytes in steps; gzipped as a whole, by record, or not at all."""
    view, at, packed = memoryview(data), 0, data[:2] == b"\x1f\x8b"
    while at < len(data):
        d = zlib.decompressobj(31) if packed else None
        while at < len(data) and not (d and d.eof):
            piece = view[at : at + CHUNK]
            at += len(piece)
            yield d.decompress(piece, CHUNK) if d else bytes(piece)
            while d and d.unconsumed_tail:
                yield d.decompress(d.unconsumed_tail, CHUNK)
        if d:
            yield d.flush()
            at -= len(d.unused_data)


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive; no more than a record and a step of it are held unpacked."""
    steps, held, at = unpacked(data), bytearray(), 0

    def fill() -> bool:
        nonlocal held
        more = next(steps, None)
        if more is not None:
            held += more
        return more is not None

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0 and fill():
            pass
        if end < 0:
            if held.strip():
                raise ValueError(f"no WARC record at byte {at}")
            return
        version, *lines = held[:end].decode().split(CRLF)
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        stop = end + 4 + int(headers["content-length"])
        while len(held) < stop + 4 and fill():
            pass
        if len(held) < stop:
            raise ValueError(f"the WARC record at byte {at} ends early")
        yield headers, bytes(held[end + 4 : stop])
        del held[: stop + 4]
        at += stop + 4


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of all archives under ``path``; none for empty archives.

    Payload length and digest of a response are those of the bytes read; a header that a record lacks is null; repeated records keep their rows.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORDS.split(", ")]
        for b in batches:
            for content in b["content"]:
                out = []
                for h, block in parse_archive(content):
                    kind, head, payload, fields = h["warc-type"], b"", None, {}
                    if kind in ("response", "revisit"):
                        head, _, payload = block.partition(b"\r\n\r\n")
                    elif kind == "metadata":
                        fields = dict(x.partition(": ")[::2] for x in block.decode().split(CRLF) if x)
                    full = kind == "response"
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if full else h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    size = len(payload) if full else int(fields["payload-length"]) if "payload-length" in fields else None
                    out.append((
                        h["warc-record-id"], kind, h.get("warc-concurrent-to"), h.get("warc-target-uri"), h.get("warc-refers-to") or fields.get("refers-to-page"), digest,
                        int(head.split(b" ", 2)[1]) if head else None, size, payload if full and with_payload else None, int(fields["page-id"]) if fields.get("page-id") else None,
                    ))
                    if len(out) >= 1000:
                        yield pd.DataFrame(out, columns=names).astype({"http_status": "Int32", "payload_bytes": "Int64", "page_id": "Int64"})
                        out = []
                yield pd.DataFrame(out, columns=names).astype({"http_status": "Int32", "payload_bytes": "Int64", "page_id": "Int64"})

    return spark.read.format("binaryFile").load(path).where("length > 0").select("content").mapInPandas(rows, RECORDS)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, request, response, metadata.

    Request and metadata records meet the response (or revisit) that they are concurrent to; a
    capture without one of them has null there.  Repeated records of one id (replays) count once.
    """
    def side(kind: str, columns: list[str]) -> DataFrame:
        of = records.where(F.col("type") == kind).where("concurrent_to is not null")
        return of.groupBy(F.col("concurrent_to").alias("record_id")).agg(F.max(F.struct(*columns)).alias(kind))

    answered = records.where(F.col("type").isin("response", "revisit")).dropDuplicates(["record_id"])
    answered = answered.select("record_id", F.struct("type", "target_uri", "http_status", "payload_bytes", "payload_digest", "refers_to", "payload").alias("response"))
    requests = side("request", [F.col("record_id").alias("id"), "target_uri"])
    metadata = side("metadata", [F.col("record_id").alias("id"), "page_id", "payload_bytes", F.col("refers_to").cast("long").alias("refers_to_page")])
    return answered.join(requests, "record_id", "left").join(metadata, "record_id", "left")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    got = captures(materialise(read_records(spark, path, with_payload=False), "records"))
    return got.select(
        F.col("metadata.page_id").alias("page_id"), F.coalesce("response.payload_bytes", "metadata.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"), F.when(F.col("response.type") == "revisit", F.col("metadata.refers_to_page")).alias("refers_to"),
    )


ORACLE = {
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
             n AS (SELECT *, list_transform(range(40), lambda i: instr('0123456789abcdef', substr(x, i + 1, 1)) - 1) AS d, max(page_id) OVER (PARTITION BY x) AS last FROM p)
        SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((((d[5 * i // 4 + 1] * 16 + d[5 * i // 4 + 2]) >> (3 - 5 * i % 4)) & 31))::BIGINT, 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
        FROM n"""
}
