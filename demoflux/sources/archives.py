"""Zip archives of CSV layers: written by Spark's text writer, read member by member in splits of any size.

Every member of an archive begins with the same four bytes. Taking them as the line separator, Spark's text
source cuts an archive at its members, so that one archive is read by many tasks and a row holds one
member. Its content is decompressed as a stream, written to the shared folder as plain text, and read by Spark's CSV reader.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demoflux.session import scratch_path

# Fixed values of the archive format: marks of a member, a directory entry and the directory's end.
MEMBER, ENTRY, END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
MEMBER_FIELDS, ENTRY_FIELDS, END_FIELDS = "<5H3L2H", "<6H3L5H2L", "<4H2LH"
STORED, DEFLATED = 0, 8
SIZE_FOLLOWS, ENCRYPTED, UTF8 = 0x8, 0x1, 0x800
DAY = 0x21  # the first day that the format can name
LONG = 0xFFFFFFFF

CHUNK = 1 << 20  # bytes of plain text in a row, about


class Member:
    """One member as it is read: gives whole lines of its text in chunks, without the header record."""

    def __init__(self, record: bytes):
        _, self.flags, self.method, _, _, self.crc, self.packed, _, n_name, n_extra = struct.unpack_from(MEMBER_FIELDS, record)
        begin = struct.calcsize(MEMBER_FIELDS)
        self.name = record[begin:begin + n_name].decode("utf-8", "replace")
        self.begin = begin + n_name + n_extra
        extra = record[begin + n_name:self.begin]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<2H", extra)
            if kind == 1 and self.packed == LONG:  # a long size: after the plain size, which is long as well
                self.packed = struct.unpack_from("<Q", extra, 12)[0]
            extra = extra[4 + n:]
        self.sized = not self.flags & SIZE_FOLLOWS
        self.left = self.packed if self.sized else 0
        self.inflate = zlib.decompressobj(-zlib.MAX_WBITS)
        self.seen, self.rest, self.header, self.quotes = 0, b"", True, 0
        self.done = False

    def skip(self, n: int) -> None:
        self.left -= n
        self.done = self.left <= 0

    def feed(self, data: bytes) -> Iterator[str]:
        if self.flags & ENCRYPTED or self.method not in (STORED, DEFLATED) or (self.method == STORED and not self.sized):
            raise ValueError(f"{self.name} is packed in a way that cannot be read")
        if self.sized:
            data = data[:self.left]
            self.left -= len(data)
        for i in range(0, len(data), CHUNK):
            part = data[i:i + CHUNK]
            while part:
                plain = self.inflate.decompress(part, CHUNK) if self.method == DEFLATED else part
                part = self.inflate.unconsumed_tail if self.method == DEFLATED else b""
                yield from self._lines(plain)
        self.done = self.inflate.eof if self.method == DEFLATED else self.left <= 0
        if self.done:
            if self.sized and self.crc != self.seen:
                raise ValueError(f"{self.name} is damaged")
            if self.rest:
                yield from self._lines(b"\n")

    def _lines(self, plain: bytes) -> Iterator[str]:
        if plain != b"\n" or not self.done:
            self.seen = zlib.crc32(plain, self.seen)
        self.rest += plain
        while self.header:
            # the header record ends at the first line break outside quotes
            cut = self.rest.find(b"\n")
            if cut < 0:
                return
            self.quotes += self.rest.count(b'"', 0, cut)
            self.rest = self.rest[cut + 1:]
            self.header = self.quotes % 2 == 1
        cut = self.rest.rfind(b"\n")
        if cut >= 0:
            yield self.rest[:cut].decode("utf-8")
            self.rest = self.rest[cut + 1:]


UNPACKED = "archive string, chunk bigint, value string, broken boolean"


def _unpack(layer: str):
    """Task: rows (path, start of the split, record) in file order, to chunks of the layer's text.

    What looks like the mark of a member may lie inside packed data. Then the next row goes on with it; if that row is in
    another split, the archive is reported as broken.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(path: str, chunk: int, value: str | None, broken: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([chunk], pa.int64()), pa.array([value], pa.string()), pa.array([broken])],
                names=["archive", "chunk", "value", "broken"])

        place, member, number = None, None, 0
        for batch in batches:
            for path, start, record in zip(*(c for c in batch.columns)):
                path, here, record = path.as_py(), (path.as_py(), start.as_py()), record.as_py()
                if here != place:
                    if member and not member.done and member.name == layer:
                        yield out(place[0], 0, None, True)
                    place, member = here, None
                if member and not member.done:
                    data = MEMBER + record
                elif len(record) >= struct.calcsize(MEMBER_FIELDS) and not record.startswith(MEMBER[:2]):
                    member = Member(record)
                    data = record[member.begin:]
                else:
                    continue
                if member.name != layer:
                    member.skip(len(data))
                    continue
                for text in member.feed(data):
                    yield out(path, number, text, False)
                    number += 1
        if member and not member.done and member.name == layer:
            yield out(place[0], 0, None, True)

    return run


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: whole archives, cut at the marks of members."""
    for batch in batches:
        for path, content in zip(*batch.columns):
            parts = content.as_py().split(MEMBER)
            for part in parts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path.as_py()]), pa.array([0], pa.int64()), pa.array([part], pa.binary())], names=["path", "start", "value"])


def read_archive_layer(spark: SparkSession, path: str | list[str], layer: str, schema: T.StructType) -> DataFrame:
    """The rows of one CSV member of each zip archive under the path.

    Members are unpacked by one task each, whatever archive they are in, and their plain text lies in the shared folder before
    it is parsed, so that neither an archive nor a plain member is ever held whole. A quoted field
    may hold line breaks; a value that does not fit the schema fails the read, as does a damaged member. Archives
    in which a member's packed bytes look like the beginning of another one where two splits meet are read again, whole.
    """
    rows = spark.read.option("lineSep", MEMBER.decode()).text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary"))
    plain = scratch_path(spark, "layer")
    _write_plain(rows, layer, f"{plain}/split")
    split = spark.read.schema("value string").text(f"{plain}/split")
    if "broken" not in split.columns:  # no archive has the layer
        return spark.createDataFrame([], schema)
    broken = [r["archive"] for r in split.filter("broken = 'true'").select("archive").distinct().collect()]
    places = [f"{plain}/split"]
    if broken:
        again = spark.read.format("binaryFile").load([unquote(b) for b in broken]).select("path", "content")
        _write_plain(again.mapInArrow(_records, "path string, start bigint, value binary"), layer, f"{plain}/whole")
        places.append(f"{plain}/whole")
    layout = T.StructType([*schema.fields, T.StructField("broken", T.StringType()), T.StructField("archive", T.StringType())])
    read = None
    for place in places:
        part = spark.read.schema(layout).option("multiLine", True).option("escape", '"').option(
            "mode", "FAILFAST").csv(place).filter("broken = 'false'")
        if place.endswith("split") and broken:
            part = part.filter(~F.col("archive").isin(broken))
        read = part if read is None else read.unionByName(part)
    return read.select(*schema.fieldNames())


def _write_plain(rows: DataFrame, layer: str, path: str) -> None:
    """Chunks as text files, one folder per archive; the rows of one file keep their order."""
    chunks = rows.mapInArrow(_unpack(layer), UNPACKED).sortWithinPartitions("broken", "archive", "chunk")
    chunks.select("value", "broken", "archive").write.partitionBy("broken", "archive").text(path)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: lines (archive, member, line) sorted by archive and member, to the parts of archives between the marks of members."""

    def out(archive: str, nth: int, value: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([archive]), pa.array([nth], pa.int64()), pa.array([value], pa.binary())], names=["archive", "nth", "value"])

    archive, member, directory, at, nth = None, None, [], 0, 0
    deflate = packed = size = crc = None

    def close_member() -> bytes:
        nonlocal at
        data = b"".join([*packed, deflate.flush()])
        name = member.encode()
        sizes = crc, len(data), size
        head = struct.pack(MEMBER_FIELDS, 20, UTF8, DEFLATED, 0, DAY, *sizes, len(name), 0) + name
        directory.append(ENTRY + struct.pack(ENTRY_FIELDS, 20, 20, UTF8, DEFLATED, 0, DAY, *sizes, len(name), 0, 0, 0, 0, 0, at) + name)
        at += len(MEMBER) + len(head) + len(data)
        return head + data

    def close_archive() -> bytes:
        # the writer adds one more mark after every row: between the last member and the directory, and as the archive's comment
        entries = b"".join(directory)
        n = len(directory)
        return entries + END + struct.pack(END_FIELDS, 0, 0, n, n, len(entries), at + len(MEMBER), len(MEMBER))

    for batch in batches:
        for next_archive, next_member, line in zip(*(c.to_pylist() for c in batch.columns)):
            if (next_archive, next_member) != (archive, member):
                if member is not None:
                    yield out(archive, nth, close_member())
                    nth += 1
                if next_archive != archive:
                    if archive is not None:
                        yield out(archive, nth, close_archive())
                    yield out(next_archive, 0, b"")
                    directory, at, nth = [], 0, 1
                archive, member = next_archive, next_member
                deflate, packed, size, crc = zlib.compressobj(wbits=-zlib.MAX_WBITS), [], 0, 0
            plain = line.encode() + b"\n"
            packed.append(deflate.compress(plain))
            size += len(plain)
            crc = zlib.crc32(plain, crc)
    if archive is not None:
        yield out(archive, nth, close_member())
        yield out(archive, nth + 1, close_archive())


def csv_lines(df: DataFrame, archive: str, member: str) -> DataFrame:
    """(archive, member, place, line): the other columns as CSV, with a header line in front of each member."""
    names = [c for c in df.columns if c not in (archive, member)]
    lines = df.select(archive, member, F.lit(1).alias("place"), F.to_csv(F.struct(*names), {"escape": '"'}).alias("line"))
    heads = df.select(archive, member).distinct().select(archive, member, F.lit(0).alias("place"), F.lit(",".join(names)).alias("line"))
    return lines.unionAll(heads).toDF("archive", "member", "place", "line")


def write_archives(lines: DataFrame, path: str) -> None:
    """One zip archive for each `archive`, under the path, with its members; rows are (archive, member, place, line), all but place text.

    Lines are sorted by place, packed as they come, and a member's packed bytes are one row.
    """
    dealt = lines.repartition("archive").sortWithinPartitions("archive", "member", "place", "line")
    parts = dealt.select("archive", "member", "line").mapInArrow(_pack, "archive string, nth bigint, value binary")
    ordered = parts.sortWithinPartitions("archive", "nth").select(F.col("value").cast("string"), "archive")
    ordered.write.partitionBy("archive").option("lineSep", MEMBER.decode()).text(path)
