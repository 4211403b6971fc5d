"""Web archives without repeated payloads: revisit records that point to the first response."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demoflux.llm.common import store
from demoflux.session import scratch_path

LEAST_BYTES = 100  # smaller payloads are always written whole

#: Fixed values of the archive format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
DATE = "2000-01-01T00:00:00Z"
MARK = b"WARC/1."
HEADER = b"\x1f\x8b\x08\0\0\0\0\0\0\xff"  # of a gzip member that begins a record
NEXT_HEADER = HEADER[:-1] + b"\x03"  # of one that goes on with it

PIECE = (1 << 24) - 1  # bytes in a member at most: its size then ends with a zero byte


def record_id(key: Column) -> Column:
    """An identifier in UUID form that is fixed by the key."""
    digest = F.md5(F.concat(F.lit("record:"), F.coalesce(key.cast("string"), F.lit("none"))))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def resolve_revisits(headers: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """The records that repeat an earlier payload: (page_id, digest, refers_to, refers_url), one row per page and digest.

    `headers` has page_id, url, digest and bytes. Of the records with a digest, that with the smallest
    page_id is the original; the smallest url decides between repeated ids. Originals are found by
    a grouping that combines before the shuffle, so a payload may be as frequent as it likes.
    """
    large = headers.filter(F.col("bytes") >= least)
    originals = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("records"))
    originals = originals.filter("records > 1").drop("records")
    repeats = large.select("page_id", "digest").distinct().join(originals, "digest").filter(
        ~F.col("page_id").eqNullSafe(F.col("refers_to")))
    urls = large.groupBy("page_id", "digest").agg(F.min("url").alias("refers_url"))
    return repeats.alias("r").join(
        urls.alias("u"), (F.col("r.refers_to") == F.col("u.page_id")) & (F.col("r.digest") == F.col("u.digest")), "left"
    ).select("r.page_id", "r.digest", "refers_to", "refers_url")


def _line(name: str, value: Column) -> Column:
    """A header line. Line breaks in a value are written as blanks; a missing value gives no line."""
    clean = F.regexp_replace(value, r"[\r\n]+", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def records(pages: DataFrame, revisits: DataFrame) -> DataFrame:
    """One archive record per page as text. `pages` has page_id, url, payload, digest."""
    joined = pages.alias("p").join(
        revisits.alias("r"),
        F.col("p.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("p.digest") == F.col("r.digest")), "left")
    again = F.col("r.digest").isNotNull()
    http = F.concat(F.lit(HTTP), F.octet_length("p.payload").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(again, http).otherwise(F.concat(http, F.col("p.payload")))
    return joined.select(F.concat(
        F.lit(f"{VERSION}\r\n"), _line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", record_id(F.col("p.page_id"))), _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", F.col("p.url")), _line("Page-ID", F.col("p.page_id").cast("string")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("p.digest"))),
        _line("WARC-Profile", F.when(again, F.lit(PROFILE))),
        _line("WARC-Refers-To", F.when(again, record_id(F.col("refers_to")))),
        _line("WARC-Refers-To-Target-URI", F.when(again, F.col("refers_url"))),
        _line("WARC-Refers-To-Date", F.when(again, F.lit(DATE))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block, F.lit("\r\n\r\n")).alias("value"))


def packed(record: bytes, piece: int = PIECE) -> bytes:
    """A record as one gzip member, which can be fetched alone; as several in a row if it is longer than `piece`."""
    out = []
    for begin in range(0, len(record), piece):
        part = record[begin:begin + piece]
        pack = zlib.compressobj(6, zlib.DEFLATED, -zlib.MAX_WBITS)
        out += [HEADER if begin == 0 else NEXT_HEADER, pack.compress(part), pack.flush(), struct.pack("<2L", zlib.crc32(part), len(part))]
    return b"".join(out)


def unpacked(members: bytes) -> bytes:
    out = []
    while members:
        unpack = zlib.decompressobj(zlib.MAX_WBITS + 16)
        out.append(unpack.decompress(members))
        if not unpack.eof:
            raise ValueError("an archive ends within a record")
        members = unpack.unused_data
    return b"".join(out)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: the members of one file, less the zero that each ends with. The first describes the file."""
    about = f"software: demoflux\r\nformat: {VERSION}\r\n"
    first = True
    for batch in batches:
        rows = [packed(text.as_buffer().to_pybytes())[:-1] for text in batch.column(0)]
        if rows and first:
            info = (
                f"{VERSION}\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\n"
                f"Content-Type: application/warc-fields\r\nContent-Length: {len(about)}\r\n\r\n{about}\r\n\r\n")
            rows.insert(0, packed(info.encode())[:-1])
            first = False
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["value"])


def write_archives(pages: DataFrame, path: str, html: str = "html", least: int = LEAST_BYTES) -> None:
    """Write the pages as archives without repeated payloads, one file per task and one gzip member per record.

    A missing page text is an empty payload. Repeated rows are written each, with equal
    identifiers. Payloads travel once, by page; everything else is done on headers. Spark's text writer ends each row with
    a zero, which is the last byte of every gzip member whose content is below 16 MB.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    full = pages.select("page_id", "url", body.alias("payload"), F.sha2(body, 256).alias("digest"))
    headers = full.select("page_id", "url", "digest", F.octet_length("payload").cast("bigint").alias("bytes"))
    members = records(full, resolve_revisits(headers, least)).mapInArrow(_pack, "value binary")
    members.select(F.col("value").cast("string")).write.option("lineSep", "\0").text(path)


def parsed(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """The header fields (names in lower case) and the block of a record; nothing if it goes on after the data.

    The block is as long as its Content-Length says, whatever it holds.
    """
    head, end, rest = data.partition(b"\r\n\r\n")
    if not end:
        return None
    fields: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields.setdefault(name.strip().lower(), value.strip())
    size = int(fields["content-length"])
    return (fields, rest[:size]) if len(rest) >= size else None


FOUND = "record_type string, record_id string, url string, page_id bigint, refers_to string, digest string, payload binary"


def _found(fields: dict[str, str], block: bytes) -> tuple:
    http = fields.get("content-type", "").startswith("application/http")
    page = fields.get("page-id")
    return (
        fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-target-uri"), int(page) if page else None,
        fields.get("warc-refers-to"), fields.get("warc-payload-digest", "").removeprefix("sha256:") or None,
        block.partition(b"\r\n\r\n")[2] if http else block)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 3 + [pa.int64()] + [pa.string()] * 2 + [pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in FOUND.split(", ")])


def _read_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: rows are members without their header."""
    for batch in batches:
        rows = []
        for member in batch.column(0):
            if len(member.as_buffer()):
                record = parsed(unpacked(HEADER + member.as_py()))
                if record is None:
                    raise ValueError("a record is shorter than its length says")
                rows.append(_found(*record))
        yield _batch(rows)


def _read_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: rows (path, piece) in file order. Pieces begin after what looks like the beginning of a record.

    If a record lacks bytes of its length, what looked like the next one was part of it.
    """
    place, waiting = None, b""
    for batch in batches:
        rows = []
        for path, piece in zip(*batch.columns):
            path, piece = path.as_py(), piece.as_py()
            if path != place:
                if waiting:
                    raise ValueError(f"{place} ends within a record")
                place = path
                if not piece:
                    continue
            waiting += MARK + piece
            record = parsed(waiting)
            if record:
                rows.append(_found(*record))
                waiting = b""
        yield _batch(rows)
    if waiting:
        raise ValueError(f"{place} ends within a record")


def read_archives(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The page records of archives: fields of the header, and the payload as bytes (empty in revisit records).

    Reads what `write_archives` wrote: files are split at their members, whose header of ten bytes is always the same.
    """
    raw = spark.read.option("encoding", "ISO-8859-1").option("lineSep", HEADER.decode("latin-1")).text(path)
    return raw.select(F.col("value").cast("binary")).mapInArrow(_read_members, FOUND).filter("record_type <> 'warcinfo'")


def read_gzip_archives(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The records of any archives whose names end in .gz, in one stream or in members, as `read_archives` gives them.

    Each file is read by one task as a stream, held record by record. Bytes before the first record are not allowed;
    records without Page-ID have none, and digests of other kinds stay as they are.
    """
    raw = spark.read.option("lineSep", MARK.decode()).text(path)
    pieces = raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary"))
    return pieces.mapInArrow(_read_stream, FOUND).filter("record_type <> 'warcinfo'")


def resolved(found: DataFrame) -> DataFrame:
    """Every record with the length and digest of its full payload: a response's own, a revisit's by the record it refers to.

    A revisit's original is the response of that identifier and digest, as an identifier may be repeated with other
    payloads. Only revisits are joined; all of a payload meet one row.
    """
    lean = store(found.select(
        "record_type", "record_id", "page_id", "refers_to", "digest", F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest")), "records")
    responses = lean.filter("record_type = 'response'")
    originals = responses.groupBy(F.col("record_id").alias("refers_to"), F.col("payload_digest").alias("digest")).agg(
        F.min("page_id").alias("source_id"), F.first("payload_bytes").alias("payload_bytes"))
    revisits = lean.filter("record_type = 'revisit'").select("page_id", "refers_to", "digest").join(
        originals, ["refers_to", "digest"], "left")
    own = responses.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("bigint").alias("refers_to"))
    return own.unionAll(revisits.select(
        "page_id", "payload_bytes", F.when(F.col("payload_bytes").isNotNull(), F.col("digest")).alias("payload_digest"),
        F.lit("revisit").alias("record_type"), F.col("source_id").alias("refers_to")))


def warc_query(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    return resolved(read_archives(spark, path))


WARC_SQL = """
with p as (select page_id, coalesce(html, '') as body from pages),
d as (select page_id, octet_length(encode(body))::bigint as payload_bytes, sha256(body) as payload_digest from p),
m as (select *, min(page_id) over (partition by payload_digest) as first_id from d)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to
from m
"""
