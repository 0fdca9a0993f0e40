"""WARC archives: segmented, chunked records, revisits of equal payloads, and reading them back."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.llm.common import fresh_path, lean, written

#: Bytes of a record's block from which it is cut into segments; bytes of a transfer chunk.
SEGMENT, CHUNK = 1 << 15, 1 << 13
#: Records of an archive, at most: with records of a segment each, some 64 MB before they are compressed.
RECORDS = 2048
CRLF = b"\r\n"
DATE = "2000-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of chunked transfer framing; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.find(CRLF, at)
        if end < 0:
            raise ValueError("a chunk's size line has no end")
        n = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != CRLF:
            raise ValueError("a chunk is shorter than its size")
        out.append(body[at : at + n])
        at += n + 2


#: What stands after each record, as a gzip member of its own: the line ends that close it.
CLOSING = gzip.compress(CRLF + CRLF, 6, mtime=0)


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the two line ends after it, which the writer puts behind each."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + CRLF + block


def record_id(row: int) -> str:
    return f"<urn:page-row:{row}>"


def records(row: int, page_id: int | None, url: str | None, payload: bytes, refers: int | None = None, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page: a revisit of the response of the row refers, or a response in as many segments as it takes."""
    own = record_id(row)
    common = [("WARC-Date", DATE), ("WARC-Target-URI", None if url is None else quote(url, safe=":/?#[]@!$&'()*+,;=%~")), ("X-Page-Id", page_id)]
    value = ("WARC-Payload-Digest", f"sha1:{digest(payload)}")
    kind = ("Content-Type", "application/http;msgtype=response")
    line = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers is not None:
        block = line + b"Content-Length: %d\r\n\r\n" % len(payload)
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, ("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(refers)), value, kind], block)
        return
    block = line + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    for k, part in enumerate(parts, 1):
        fields = [("WARC-Type", "response" if k == 1 else "continuation"), ("WARC-Record-ID", own if k == 1 else f"<urn:page-row:{row}:{k}>"), *common]
        if k == 1:
            fields += [value, kind]
        if len(parts) > 1:
            fields.append(("WARC-Segment-Number", k))
            fields += [("WARC-Segment-Origin-ID", own)] if k > 1 else []
            fields += [("WARC-Segment-Total-Length", len(block))] if k == len(parts) else []
        yield record(fields, part)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record of an archive."""
    while True:
        line = stream.readline()
        while line in (CRLF, b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()) not in (CRLF, b"\n", b""):
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        n = int(fields["content-length"])
        block = stream.read(n)
        if len(block) < n:
            raise ValueError("the archive ends within a record")
        yield fields, block


def payload_of(block: bytes) -> tuple[bytes, dict[str, str]]:
    """(payload, header fields) of an HTTP response, without its transfer framing."""
    head, _, body = block.partition(CRLF + CRLF)
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode("latin-1").partition(":") for x in head.split(CRLF)[1:])}
    return (unchunked(body) if fields.get("transfer-encoding", "").lower() == "chunked" else body), fields


def reassembled(parts: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of segments (number, total length or None, bytes), checked for gaps and length."""
    parts = sorted(parts)
    if [p[0] for p in parts] != list(range(1, len(parts) + 1)):
        raise ValueError(f"segments are missing or repeated: {[p[0] for p in parts][:20]}")
    block = b"".join(p[2] for p in parts)
    if parts[-1][1] != len(block):
        raise ValueError(f"segments have {len(block)} bytes, not {parts[-1][1]}")
    return block


def write_archives(pages: DataFrame, path: str, least: int = 0, segment: int = SEGMENT) -> None:
    """Write a record per row of pages (page_id, url, html) into archives under path, of at most RECORDS records.

    Each record is a gzip member. Among rows of equal payload of at least so many bytes those with the smallest page_id are
    responses and the others revisit one of them, by its record's id; null html is an empty payload.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    # written, so that a row's number is what it was when the numbers were compared
    pages = written(pages.select(F.monotonically_increasing_id().alias("row"), "*", F.sha2(F.encode("html", "UTF-8"), 256).alias("sha")), "pages")
    shared = pages.where(F.octet_length("html") >= least).groupBy("sha").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row"))).alias("first"), F.count("*").alias("n")).where("n > 1")
    rows = pages.join(written(shared.select("sha", F.col("first.page_id").alias("first"), F.col("first.row").alias("target")), "payloads"), "sha", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.select("row", "page_id", "url", "html", F.when(revisit, F.col("target")).alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            for row, page_id, url, html, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for r in records(row, page_id, url, html.encode(), refers, segment):
                    out.append(gzip.compress(r, 6, mtime=0))
                    size += len(out[-1])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    made = rows.mapInArrow(lean(run), "value binary").select(F.col("value").cast("string"))
    # the writer puts the bytes of a value and of what stands between values as they are
    made.write.option("encoding", "ISO-8859-1").option("lineSep", CLOSING.decode("latin-1")).option("compression", "none").option("maxRecordsPerFile", RECORDS).text(path)


_FIELDS = {
    "origin": pa.string(), "number": pa.int32(), "total": pa.int64(), "id": pa.string(), "page_id": pa.int64(), "declared": pa.string(),
    "record_type": pa.string(), "target": pa.string(), "size": pa.int64(), "block": pa.binary(),
}
_SCHEMA = "origin string, number int, total long, id string, page_id long, declared string, record_type string, target string, size long, block binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _FIELDS.values(), strict=True)], names=list(_FIELDS))


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per response or revisit of the archives under path, gzipped or not.

    (page_id, payload_bytes, payload_digest, record_type, refers_to, and payload where asked.)
    Responses in segments are put together by origin and number, wherever
    their segments stand, and their total length is checked; whole ones are
    decoded as they are read. A payload that does not have its record's digest is an
    error. A revisit is joined with the response that it names, and has that one's payload, size and digest; one whose response
    isn't there, or has another digest or size than the revisit says, is an error.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                data = content.as_py()
                stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
                out, size = [], 0
                for row in (_row(f, x) for f, x in parse(io.BufferedReader(stream, 1 << 16))):
                    if row:
                        out.append(row if payloads or row[1] else (*row[:-1], None))
                        size += len(out[-1][-1] or b"") + 100
                    if size > 4 << 20:
                        yield _batch(out)
                        out, size = [], 0
                if out:
                    yield _batch(out)

    found = written(files.mapInArrow(lean(run), _SCHEMA), "records")
    parts = found.where("number is not null").groupBy("origin").agg(
        F.max("page_id").alias("page_id"), F.max("declared").alias("declared"), F.max("record_type").alias("record_type"), F.collect_list(F.struct("number", "total", "block")).alias("parts")
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for origin, page_id, declared, kind, parts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                payload = payload_of(reassembled([(p["number"], p["total"], p["block"]) for p in parts]))[0]
                yield _batch([(None, None, None, origin, page_id, _checked(payload, declared), kind, None, len(payload), payload if payloads else None)])

    joined = parts.select("origin", "page_id", "declared", "record_type", "parts").mapInArrow(lean(join), _SCHEMA)
    whole = written(found.where("number is null").union(joined), "whole")
    responses = whole.where("target is null")
    named = responses.select(F.col("id").alias("target"), F.col("page_id").alias("refers_to"), F.col("size").alias("found_size"), F.col("declared").alias("found"), *([F.col("block").alias("found_block")] if payloads else []))
    revisits = whole.where("target is not null").join(named, "target", "left")
    wrong = F.col("found").isNull() | (F.col("found") != F.col("declared")) | (F.col("found_size") != F.col("size"))
    digest_ = F.when(wrong, F.raise_error(F.concat(F.lit("a revisit does not fit its response: "), "target"))).otherwise(F.col("found"))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if payloads else [])]
    out = responses.select("page_id", "size", "declared", "record_type", F.lit(None).cast("long"), *(["block"] if payloads else [])).toDF(*names)
    return out.union(revisits.select("page_id", "found_size", digest_, "record_type", "refers_to", *(["found_block"] if payloads else [])).toDF(*names))


def _checked(payload: bytes, declared: str | None) -> str:
    made = digest(payload)
    if declared is not None and declared != made:
        raise ValueError(f"the payload has digest {made}, its record {declared}")
    return made


def _row(fields: dict[str, str], block: bytes) -> tuple | None:
    """The values of _FIELDS for a response, a segment of one, or a revisit."""
    kind, own = fields.get("warc-type"), fields.get("warc-record-id")
    page = fields.get("x-page-id")
    page_id = int(page) if page not in (None, "None") else None
    declared = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    number = fields.get("warc-segment-number")
    if kind in ("response", "continuation") and number is not None:
        total = fields.get("warc-segment-total-length")
        first = kind == "response"
        return own if first else fields["warc-segment-origin-id"], int(number), int(total) if total else None, own, page_id if first else None, declared, kind if first else None, None, None, block
    if kind == "response":
        payload, _ = payload_of(block)
        return None, None, None, own, page_id, _checked(payload, declared), kind, None, len(payload), payload
    if kind == "revisit":
        return None, None, None, own, page_id, declared, kind, fields["warc-refers-to"], int(payload_of(block)[1]["content-length"]), None
    return None


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write pages to archives in the shared folder and read them back.

    One row per page: page_id, payload_bytes, payload_digest, record_type,
    refers_to. A null html is an empty payload; a null or odd url is left out
    or percent-encoded. Rows that share payload and smallest page_id are responses all.
    A null page_id is never the smallest: it revisits where it can. Other columns are not
    read; an empty table gives none.
    """
    path = fresh_path(pages.sparkSession, "archives")
    write_archives(pages, path, least)
    return read_archives(pages.sparkSession, path)


def _base32_sql(sha1: str) -> str:
    """DuckDB SQL for the base32 text of 40 hexadecimal digits."""
    digits = f"('0x' || substr({sha1}, (i // 4) * 5 + 1, 5))::BIGINT"
    return f"list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({digits} >> (5 * (3 - i % 4))) & 31)::INT + 1, 1)), 'string_agg', '')"


ROUND_TRIP_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, strlen(html) AS payload_bytes, {_base32_sql("sha1(html)")} AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM p"""
