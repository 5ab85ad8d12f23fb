"""Web archives: writing captures as WARC files, and assembling them again.

Each page is a transaction of three records, a request, a response (or a revisit of an earlier
response with the same payload) and metadata, tied together by ``WARC-Concurrent-To``. Spark's own
writer puts records out as they are, a record's closing blank lines being its line separator, so
the archives lie wherever Spark can write and follow its commit protocol. Readers take records by
their stated length, never by looking for separators, and join the three kinds of a transaction
through the identifiers into one nested row.

Defined cases: a null payload is empty; a null url is written as an empty target; null ids come
last when the response among equal payloads is chosen and return as null; rows with equal ids and
payloads give one response, the others revisit it; payloads below ``min_bytes`` are never revisits;
an empty table writes no record. Columns other than the three named ones are left out. A file with
a broken record raises an error.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path, stage
from .common import whole

#: The record format's version, line ends and profile for revisits.
VERSION = "WARC/1.1"
END = "\r\n"
RECORD_END = END * 2
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed value: the base32 alphabet.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HTTP_HEAD = f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}{END}"
#: Pages per archive file, and the time written when none is known.
FILE_PAGES = 20_000
#: Bytes an archive file may unpack to, unless it holds a single page; headers of a page's three records.
FILE_BYTES = 512 * 2**20
HEADER_BYTES = 2048
#: Bytes unpacked at once.
PIECE = 1 << 20
UNDATED = "1970-01-01T00:00:00Z"


def sha1_base32(data: Column) -> Column:
    """160 bits as 32 characters: 20 bits at a time."""
    digits = F.sha1(data)
    letters = []
    for i in range(8):
        bits = F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def transactions(pages: DataFrame, key: str, url: str, payload: str, min_bytes: int) -> DataFrame:
    """Per page its ids, digest, and whether and what it revisits."""
    body = whole(payload)
    rows = pages.select(
        F.col(key).cast("long").alias("page"), F.coalesce(F.col(url), F.lit("")).alias("url"), body.alias("body"),
        F.octet_length(body).cast("long").alias("n"), sha1_base32(body.cast("binary")).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = F.struct(F.col("page").isNull().alias("none"), F.col("page"), F.col("row"))
    first = rows.filter(F.col("n") >= min_bytes).groupBy("digest").agg(F.min(order).alias("first"))
    # A payload of many pages makes its digest a hot key: the join is one that can be split.
    joined = rows.join(first, "digest", "left")
    revisit = (F.col("n") >= min_bytes) & (F.col("row") != F.col("first")["row"])
    return joined.withColumn("revisit", F.coalesce(revisit, F.lit(False)))


def record_id(kind: str, row: Column) -> Column:
    """A name-based identifier of a row's record."""
    h = F.md5(F.concat(F.lit(f"{kind}:"), row.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(headers: dict[str, Column], block: Column) -> Column:
    """A record without its closing lines; a null header is left out."""
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit(END)) for name, value in headers.items()]
    length = F.octet_length(block).cast("string")
    return F.concat(
        F.lit(VERSION + END), *[F.coalesce(x, F.lit("")) for x in lines],
        F.concat(F.lit("Content-Length: "), length, F.lit(END * 2)), block,
    )


def write_archives(
    pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0,
    date: str = UNDATED, path: str | None = None, file_pages: int = FILE_PAGES, file_bytes: int = FILE_BYTES,
) -> str:
    """Write all pages as WARC files of at most so many pages and bytes (or one page); return their folder."""
    path = path or scratch_path(pages.sparkSession, "warc")
    t = transactions(pages, key, url, payload, min_bytes)
    ids = {k: record_id(k, F.col("row")) for k in ("request", "response", "metadata")}
    target = F.regexp_replace("url", r"[\r\n]", "")
    common = {"WARC-Target-URI": target, "WARC-Date": F.lit(date)}
    response = _record({
        "WARC-Type": F.when(F.col("revisit"), "revisit").otherwise("response"), "WARC-Record-ID": ids["response"],
        **common, "WARC-Payload-Digest": F.concat(F.lit("sha1:"), F.col("digest")),
        "WARC-Profile": F.when(F.col("revisit"), PROFILE),
        "WARC-Refers-To": F.when(F.col("revisit"), record_id("response", F.col("first")["row"])),
        "Content-Type": F.lit("application/http;msgtype=response"),
    }, F.concat(F.lit(HTTP_HEAD), F.when(F.col("revisit"), "").otherwise(F.col("body"))))
    host = F.regexp_extract(target, r"^[a-z]+://([^/]*)", 1)
    request = _record({
        "WARC-Type": F.lit("request"), "WARC-Record-ID": ids["request"], **common,
        "WARC-Concurrent-To": ids["response"], "Content-Type": F.lit("application/http;msgtype=request"),
    }, F.concat(F.lit("GET "), target, F.lit(f" HTTP/1.1{END}Host: "), host, F.lit(END * 2)))
    fields = F.concat(
        F.coalesce(F.concat(F.lit("page: "), F.col("page").cast("string"), F.lit(END)), F.lit("")),
        F.lit("payload-bytes: "), F.col("n").cast("string"), F.lit(END),
        F.when(F.col("revisit"), F.coalesce(F.concat(F.lit("refers-to-page: "), F.col("first")["page"].cast("string"), F.lit(END)), F.lit(""))).otherwise(""),
    )
    metadata = _record({
        "WARC-Type": F.lit("metadata"), "WARC-Record-ID": ids["metadata"], **common,
        "WARC-Concurrent-To": ids["response"], "Content-Type": F.lit("application/warc-fields"),
    }, fields)
    # The three records of a page stay together and count as one of the writer's lines.
    value = F.concat_ws(RECORD_END, request, response, metadata)
    # Target and host appear in five places at most.
    room = HEADER_BYTES + len(date) * 3 + 5 * F.octet_length("url").cast("long") + F.col("n")
    longest = pages.select(
        F.octet_length(whole(payload)).cast("long").alias("n"), F.coalesce(F.col(url), F.lit("")).alias("url")
    ).agg(F.max(room)).first()[0] or 0
    records = t.select(room.alias("room"), value.alias("value"))
    if longest * file_pages > file_bytes:
        # Large pages get files of fewer pages: one write per class of sizes.
        records = stage(records, "records")
    low, high = -1, max(1, file_bytes // file_pages)
    while True:
        part = records.filter((F.col("room") > low) & (F.col("room") <= high)) if longest * file_pages > file_bytes else records
        part.select("value").write.options(
            lineSep=RECORD_END, compression="gzip", maxRecordsPerFile=max(1, min(file_pages, file_bytes // high))
        ).mode("append" if low >= 0 else "errorifexists").text(path)
        if high >= longest:
            return path
        low, high = high, 8 * high


def parse_records(raw: bytes | pa.Buffer) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record; plain, or in any number of gzip members.

    Unpacked piece by piece: what is held is one record and a piece.
    """
    source = pa.BufferReader(raw)
    if bytes(raw[:2]) == b"\x1f\x8b":
        source = gzip.GzipFile(fileobj=source)
    at, held = 0, bytearray()

    def more() -> bool:
        piece = source.read(PIECE)
        held.extend(piece)
        return bool(piece)

    while held or more():
        searched = 0
        while (end := held.find(b"\r\n\r\n", searched)) < 0:
            searched = max(0, len(held) - 3)
            if held[:5] != b"WARC/"[:len(held)] or not more():
                raise ValueError(f"no record at byte {at}")
        if held[:5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        headers = {}
        for line in held[:end].decode("utf-8", "replace").split(END)[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        begin = end + 4
        stop = begin + int(headers["content-length"])
        while len(held) < stop + 4 and more():
            pass
        if held[stop:stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at + begin} is cut short")
        yield headers, bytes(held[begin:stop])
        del held[:stop + 4]
        at += stop + 4


RECORDS = (
    "type string, id string, concurrent_to string, refers_to string, url string, digest string, "
    "http string, fields map<string,string>, payload binary, payload_bytes long, payload_sha1 string"
)


def read_records(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """One row per record of all archives of a folder."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("type", pa.string()), ("id", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()),
            ("url", pa.string()), ("digest", pa.string()), ("http", pa.string()),
            ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
            ("payload_sha1", pa.string()),
        ])
        for batch in batches:
            for content in batch.column(0):
                out, size = [], 0
                for headers, block in parse_records(content.as_buffer()):
                    out.append(_row(headers, block, keep_payload))
                    size += len(block)
                    if size > 4 * 2**20 or len(out) >= 2000:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    return files.mapInArrow(rows, RECORDS)


def _row(headers: dict[str, str], block: bytes, keep_payload: bool) -> dict:
    kind = headers["warc-type"]
    row = {
        "type": kind, "id": headers["warc-record-id"], "concurrent_to": headers.get("warc-concurrent-to"),
        "refers_to": headers.get("warc-refers-to"), "url": headers.get("warc-target-uri"),
        "digest": headers.get("warc-payload-digest", "").removeprefix("sha1:") or None,
    }
    if kind == "metadata":
        lines = block.decode("utf-8", "replace").split(END)
        row["fields"] = [tuple(x.split(": ", 1)) for x in lines if ": " in x]
    else:
        head, _, body = block.partition(b"\r\n\r\n")
        row["http"] = head.decode("utf-8", "replace")
        if kind == "response":
            row["payload"] = body if keep_payload else None
            row["payload_bytes"] = len(body)
            row["payload_sha1"] = base64.b32encode(hashlib.sha1(body).digest()).decode()
    return row


def captures(records: DataFrame) -> DataFrame:
    """One nested row per transaction: response (or revisit), its request and its metadata.

    Each record names the response it is concurrent to; identifiers are unique, so no key is hot.
    """
    response = records.filter(F.col("type").isin("response", "revisit")).select(
        "id", "url", F.struct("type", "id", "refers_to", "digest", "http", "payload", "payload_bytes", "payload_sha1").alias("response")
    )
    request = records.filter(F.col("type") == "request").select(
        F.col("concurrent_to").alias("id"), F.struct("id", "http").alias("request")
    )
    metadata = records.filter(F.col("type") == "metadata").select(
        F.col("concurrent_to").alias("id"), F.struct("id", "fields").alias("metadata")
    )
    return response.join(request, "id", "left").join(metadata, "id", "left")
